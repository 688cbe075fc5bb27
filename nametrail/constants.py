"""Watch lists, word list, technique names and format constants.

Everything in this module is data whose exact content decides the results.
Each detector takes the lists it uses as parameters; these are the defaults.
"""

# Brand domains watched for look-alikes, in tie-break order.
BRAND_WATCHLIST = [
    "google.com", "paypal.com", "microsoft.com", "apple.com", "amazon.com",
    "facebook.com", "github.com", "netflix.com", "chase.com", "dropbox.com",
]

# Host names of public DNS-over-HTTPS resolvers.
KNOWN_DOH_PROVIDERS = [
    "cloudflare-dns.com", "dns.google", "doh.opendns.com",
    "mozilla.cloudflare-dns.com", "dns.quad9.net", "doh.cleanbrowsing.org",
]

# Public suffixes made of two labels.
MULTI_PART_TLDS = [
    "co.uk", "org.uk", "gov.uk", "ac.uk", "co.in", "co.jp", "com.au",
    "com.br", "com.cn", "com.mx", "net.au", "org.au", "co.nz", "co.za",
]

# ATT&CK technique id -> public technique name.
MITRE_TECHNIQUES = {
    "T1568.002": "Dynamic Resolution: Domain Generation Algorithms",
    "T1568.001": "Dynamic Resolution: Fast Flux DNS",
    "T1071.004": "Application Layer Protocol: DNS",
    "T1590.002": "Gather Victim Network Information: DNS Information",
    "T1583.001": "Acquire Infrastructure: Domains",
}

# ATT&CK technique id -> public tactic name.
MITRE_TACTIC = {
    "T1568.002": "Command and Control",
    "T1568.001": "Command and Control",
    "T1071.004": "Command and Control",
    "T1590.002": "Reconnaissance",
    "T1583.001": "Resource Development",
}

# Order in which tactics are reported.
TACTIC_ORDER = ["Reconnaissance", "Resource Development", "Command and Control"]
OTHER_TACTIC = "Other"
OTHER_TACTIC_RANK = 99

# Lowest score of each severity label, and the sort rank.
SEVERITY_FLOORS = {"Critical": 85, "High": 65, "Medium": 40}
LOWEST_SEVERITY = "Low"
SEVERITY_ORDER = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}

# Word list that defines which letter pairs count as common.
VOCABULARY = """
the and for are but not you all can her was one our out day get has him his how
new now old see two way who did its let put say she too use google microsoft
amazon facebook apple github office cloud service account secure login mail
support update system network server client admin portal internal backup storage
stream video photo share drive docs sheet slide search browser mobile download
upload content media player shop store payment bank finance invoice order
delivery news weather sports travel hotel flight booking ticket social friend
message chat group event calendar meeting project team task report dashboard
monitor alert status
""".split()

# Ground-truth label -> detector expected to find it.
SCENARIO_TO_DETECTOR = {
    "dga": "dga",
    "tunneling": "tunneling",
    "beaconing": "beaconing",
    "nxdomain_flood": "nxdomain_spike",
    "typosquat": "typosquat",
    "fast_flux": "fast_flux",
    "newly_registered": "newly_registered",
    "doh_evasion": "doh_evasion",
}
HOST_GRANULAR_SCENARIOS = ["nxdomain_flood"]
BENIGN_LABEL = "benign"

# Risk added per additional detector, and the score ceiling.
CORRELATION_BONUS_PER_DETECTOR = 8
MAX_SCORE = 100.0

# Separator of multi-valued cells, hosts kept per alert.
LIST_SEPARATOR = ";"
MAX_HOSTS_PER_ALERT = 5

# Query types that carry free text.
CARRIER_TYPES = ["TXT", "NULL"]
