"""DuckDB statements that give the same rows as the registered queries.

Written against the driver's views only, with other means than the Spark code
(list functions, the ``entropy`` aggregate, range frames, list slices).
"""

from collections.abc import Sequence


def _quoted(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


VIEW = """
p as (
  select page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1),
                                 '[.]example[.]', '.') as query_name
  from pages),
raw as (
  select e.ts, epoch_us(e.ts) as us,
    concat('10.0.', cast(floor(user_id / 256) as bigint), '.', user_id % 256) as src_ip,
    p.query_name,
    case event_type when 'signup' then 'TXT' when 'purchase' then 'NULL' else 'A' end as query_type,
    case when event_type = 'error' then 'NXDOMAIN' else 'NOERROR' end as response_code,
    case when event_type = 'error' then ''
         else concat('203.0.113.', regexp_extract(props, '"k": *([0-9]+)', 1)) end as response_ip,
    cast(floor(value * 10) as bigint) as ttl,
    cast(17 + length(p.query_name) as bigint) as query_size_bytes,
    cast(case when p.page_id % 3 = 0 then null else p.page_id % 30 end as double)
      as first_registered_days_ago,
    case when user_id % 4 = 0 then 'benign' when p.page_id % 5 = 0 then 'dga'
         when p.page_id % 5 = 1 then 'tunneling' when p.page_id % 5 = 2 then 'fast_flux'
         else 'benign' end as ground_truth_label
  from events e join p on p.page_id = e.event_id % (select count(*) from pages)),
cut as (
  select *, string_split(query_name, '.') as labels,
    array_to_string(string_split(query_name, '.')[-2:], '.') in ({suffixes}) as long_suffix
  from raw),
sized as (
  select *, case when len(labels) <= 2 then len(labels)
                 when long_suffix then 3 else 2 end as keep
  from cut),
ev as (
  select us, ts, src_ip, query_name, query_type, response_code, response_ip, ttl,
    query_size_bytes, first_registered_days_ago, ground_truth_label,
    array_to_string(labels[len(labels) - keep + 1:], '.') as registrable_domain,
    coalesce(array_to_string(labels[1:len(labels) - keep], '.'), '') as subdomain,
    cast(len(labels) - keep as bigint) as subdomain_label_count,
    cast(length(coalesce(array_to_string(labels[1:len(labels) - keep], '.'), '')) as bigint)
      as subdomain_len
  from sized)
"""

TEXT = """
texts as (
  select query_name as s from ev union select string_split(query_name, '.')[1] from ev
  union select string_split(registrable_domain, '.')[1] from ev
  union select replace(subdomain, '.', '') from ev),
ent as (
  select s, coalesce(entropy(ch), 0) as h
  from (select s, unnest(string_split(s, '')) as ch from texts where s <> '') group by s
  union all select '', 0.0 where exists (select 1 from texts where s = '')),
words as (select unnest([{words}]) as w),
common as (
  select distinct substring(w, i, 2) as pair
  from (select w, unnest(range(1, length(w))) as i from words)),
segments as (select s, unnest(string_split(s, '-')) as seg from texts),
pairs as (select s, substring(seg, i, 2) as pair
          from (select s, seg, unnest(range(1, length(seg))) as i from segments)),
rare as (
  select texts.s, coalesce(avg(case when pairs.pair is null then null
                                    when pairs.pair in (select pair from common) then 0.0
                                    else 1.0 end), 0.0) as r
  from texts left join pairs on pairs.s = texts.s group by texts.s),
digits as (
  select s, case when s = '' then 0.0
    else length(regexp_replace(s, '[^0-9]', '', 'g')) * 1.0 / length(s) end as g
  from texts)
"""

HOSTS = "array_to_string(list_sort(list(distinct src_ip))[1:5], ';')"

FEATURES = """
dga_f as (
  select d.*, ent.h as entropy, rare.r as rare_ratio, digits.g as digit_ratio,
    100 * (0.45 * least(ent.h / 5.17, 1) + 0.40 * rare.r + 0.15 * digits.g)
      * (case when contains(d.label, '-') then 0.7 else 1.0 end) as score
  from (select registrable_domain, string_split(registrable_domain, '.')[1] as label,
          count(*) as n_queries, max(us) as last_us,
          avg(case when response_code = 'NXDOMAIN' then 1.0 else 0.0 end) as nxdomain_ratio,
          {hosts} as hosts
        from ev group by registrable_domain) d
  join ent on ent.s = d.label join rare on rare.s = d.label join digits on digits.s = d.label
  where length(d.label) >= 6),
tunnel_f as (
  select *, 100 * (0.25 * least(avg_len / 50, 1) + 0.2 * txt_null_ratio + 0.2 * least(rate / 10, 1)
                   + 0.2 * unique_ratio + 0.15 * least(avg_entropy / 4.5, 1)) as score
  from (select *, n_queries / duration_min as rate
        from (select src_ip, registrable_domain, count(*) as n_queries, max(us) as last_us,
                greatest((max(us) - min(us)) / 60000000.0, 1.0 / 60) as duration_min,
                avg(subdomain_len) as avg_len,
                avg(case when query_type in ('TXT', 'NULL') then 1.0 else 0.0 end)
                  as txt_null_ratio,
                count(distinct subdomain) / count(*) as unique_ratio,
                avg(ent.h) as avg_entropy
              from ev join ent on ent.s = replace(ev.subdomain, '.', '')
              where subdomain_label_count > 0
              group by src_ip, registrable_domain
              having count(*) >= {tunnel[min_queries]}))),
beacon_f as (
  select *, std_interval_sec / mean_interval_sec as coefficient_of_variation,
    100 * (0.7 * greatest(0, 1 - std_interval_sec / mean_interval_sec / {beacon[cv_threshold]})
           + 0.3 * least(n_queries / 50, 1)) as score
  from (select src_ip, query_name, count(*) as n_queries, max(us) as last_us,
          avg(gap) as mean_interval_sec, stddev_pop(gap) as std_interval_sec
        from (select src_ip, query_name, us,
                (us - lag(us) over (partition by src_ip, query_name order by us)) / 1e6 as gap
              from ev)
        group by src_ip, query_name
        having count(*) >= {beacon[min_queries]} and avg(gap) > 0)),
nx as (select src_ip, query_name, us from ev where response_code = 'NXDOMAIN'),
nx_end as (
  select src_ip, us as end_us, cnt as max_nxdomain_in_window
  from (select *, row_number() over (partition by src_ip order by cnt desc, us) as rn
        from (select src_ip, us, count(*) over (
                partition by src_ip order by us
                range between {width} preceding and current row) as cnt from nx))
  where rn = 1 and cnt >= {burst[count_threshold]}),
nx_names as (
  select src_ip, string_agg(query_name, ';' order by rn) as names
  from (select src_ip, query_name, row_number() over (
          partition by src_ip order by count(*) desc, min(us), query_name) as rn
        from nx join nx_end using (src_ip)
        where nx.us between end_us - {width} and end_us
        group by src_ip, query_name)
  where rn <= 3 group by src_ip),
nx_f as (
  select nx_end.src_ip, max_nxdomain_in_window, total_nxdomain_events, host_total,
    total_nxdomain_events / host_total as host_nxdomain_ratio, end_us, names,
    100 * least(1, 0.6 * max_nxdomain_in_window / (2.0 * {burst[count_threshold]})
                   + 0.4 * total_nxdomain_events / host_total) as score
  from nx_end join nx_names using (src_ip)
  join (select src_ip, count(*) as host_total,
          count(*) filter (where response_code = 'NXDOMAIN') as total_nxdomain_events
        from ev group by src_ip) using (src_ip)
  where total_nxdomain_events >= {burst[min_total]}),
brands as (select unnest([{brands}]) as brand, unnest(range({n_brands})) as pos),
squat_f as (
  select registrable_domain, edit_distance, matched_brand, n_queries, last_us, hosts,
    92.0 - 24 * (edit_distance - 1) as score
  from (select d.*, brand as matched_brand, levenshtein(registrable_domain, brand) as edit_distance,
          row_number() over (partition by registrable_domain
            order by levenshtein(registrable_domain, brand), pos) as rn
        from (select registrable_domain, count(*) as n_queries, max(us) as last_us,
                {hosts} as hosts from ev group by registrable_domain) d
        join brands on levenshtein(registrable_domain, brand) <= 2
        where length(registrable_domain) >= 4
          and registrable_domain not in (select brand from brands))
  where rn = 1),
flux_f as (
  select *, 100 * (0.4 * least(1.5 * ip_ratio, 1)
      + 0.3 * (case when avg_ttl <= 300 then 1 else greatest(0, 1 - (avg_ttl - 300) / 3600) end)
      + 0.3 * least(distinct_ips / 10, 1)) as score
  from (select registrable_domain, count(distinct response_ip) as distinct_ips,
          count(*) as n_resolved, count(distinct response_ip) / count(*) as ip_ratio,
          avg(ttl) as avg_ttl, max(us) as last_us, {hosts} as hosts
        from ev where response_code = 'NOERROR' and response_ip <> ''
        group by registrable_domain
        having count(*) >= 8 and count(distinct response_ip) >= 4)),
aged as (
  select *, row_number() over (partition by registrable_domain
    order by us, first_registered_days_ago) as rn
  from ev where first_registered_days_ago is not null),
young_f as (
  select *, 100 * (0.75 * (1 - age_days / 7.0) + 0.25 * least(n_queries / 15, 1)) as score
  from (select registrable_domain, max(case when rn = 1 then first_registered_days_ago end)
            as age_days,
          count(*) as n_queries, max(us) as last_us, {hosts} as hosts
        from aged group by registrable_domain)),
doh_f as (
  select src_ip, array_to_string(list_sort(list(distinct registrable_domain)), ';') as providers,
    count(*) as n_queries, max(us) as last_us
  from ev where query_name in ({providers}) group by src_ip)
"""

ALERTS = """
found as (
  select 0 as pos, 'dga' as detector, last_us as us, score, hosts as src_ip,
         registrable_domain as domain, 'T1568.002' as mitre_id
  from dga_f where score >= {dga_score}
  union all
  select 1, 'tunneling', last_us, score, src_ip, registrable_domain, 'T1071.004'
  from tunnel_f where score >= {tunnel[score_threshold]}
  union all
  select 2, 'beaconing', last_us, score, src_ip, query_name, 'T1071.004'
  from beacon_f where coefficient_of_variation <= {beacon[cv_threshold]}
    and score >= {beacon[score_threshold]}
  union all
  select 3, 'nxdomain_spike', end_us, score, src_ip, names, 'T1590.002' from nx_f
  union all
  select 4, 'typosquat', last_us, score, hosts, registrable_domain, 'T1583.001' from squat_f
  union all
  select 5, 'fast_flux', last_us, score, hosts, registrable_domain, 'T1568.001'
  from flux_f where score >= 45
  union all
  select 6, 'newly_registered', last_us, score, hosts, registrable_domain, 'T1583.001'
  from young_f where age_days <= 7 and score >= 40
  union all
  select 7, 'doh_evasion', last_us, 55.0, src_ip, providers, 'T1071.004' from doh_f),
alerts as (
  select *, case when severity_score >= 85 then 'Critical' when severity_score >= 65 then 'High'
                 when severity_score >= 40 then 'Medium' else 'Low' end as severity_label,
    row_number() over (order by severity_score desc, pos, domain, src_ip, us) as alert_no,
    case mitre_id when 'T1590.002' then 'Reconnaissance'
                  when 'T1583.001' then 'Resource Development'
                  else 'Command and Control' end as tactic,
    case mitre_id when 'T1568.002' then 'Dynamic Resolution: Domain Generation Algorithms'
                  when 'T1568.001' then 'Dynamic Resolution: Fast Flux DNS'
                  when 'T1071.004' then 'Application Layer Protocol: DNS'
                  when 'T1590.002' then 'Gather Victim Network Information: DNS Information'
                  else 'Acquire Infrastructure: Domains' end as mitre_name
  from (select *, cast(round(greatest(0, least(100, score)), 1) as double) as severity_score
        from found)),
per_host as (
  select * exclude (src_ip), src_ip as hosts, unnest(string_split(src_ip, ';')) as src_ip
  from alerts),
host_scores as (
  select *, least(100.0, top + 8 * (n_detectors - 1)) as risk
  from (select src_ip, max(severity_score) as top, count(*) as n_alerts,
          count(distinct detector) as n_detectors,
          array_to_string(list_sort(list(distinct detector)), ', ') as detectors,
          arg_min(detector, alert_no) as top_detector
        from per_host group by src_ip)),
host_risk as (
  select src_ip, cast(round(risk, 1) as double) as risk_score,
    case when risk >= 85 then 'Critical' when risk >= 65 then 'High'
         when risk >= 40 then 'Medium' else 'Low' end as risk_label,
    n_alerts, n_detectors, detectors, top_detector
  from host_scores),
per_name as (
  select * exclude (domain), domain as listed,
    array_to_string(string_split(name, '.')[
      case when array_to_string(string_split(name, '.')[-2:], '.') in ({suffixes})
           then -3 else -2 end:], '.') as domain
  from (select *, unnest(string_split(domain, ';')) as name from per_host)),
benign as (select src_ip from ev group by src_ip
           having min(ground_truth_label) = 'benign' and max(ground_truth_label) = 'benign')
"""

# The same with every host of an alert instead of the listed ones.
LISTED_HOSTS = """per_host as (
  select * exclude (src_ip), src_ip as hosts, unnest(string_split(src_ip, ';')) as src_ip
  from alerts)"""
COMPLETE_HOSTS = """per_host as (
  select a.* exclude (src_ip), a.src_ip as hosts, unnest(string_split(a.src_ip, ';')) as src_ip
  from alerts a
  where detector not in ('dga', 'typosquat', 'fast_flux', 'newly_registered')
  union all
  select a.* exclude (src_ip), a.src_ip as hosts, e.src_ip
  from alerts a join (
    select registrable_domain, src_ip,
      count(*) filter (where response_code = 'NOERROR' and response_ip <> '') as n_resolved,
      count(first_registered_days_ago) as n_aged
    from ev group by registrable_domain, src_ip) e on e.registrable_domain = a.domain
  where detector in ('dga', 'typosquat') or detector = 'fast_flux' and n_resolved > 0
    or detector = 'newly_registered' and n_aged > 0)"""
assert LISTED_HOSTS in ALERTS
ALL_HOSTS = ALERTS.replace(LISTED_HOSTS, COMPLETE_HOSTS)

def _facts(detector: str, domain: str, host: str, source: str, facts: dict[str, str]) -> str:
    return (f"select '{detector}' as detector, {domain} as domain, {host} as src_ip, "
            f"unnest([{', '.join(map(repr, facts))}]) as name, "
            f"unnest([{', '.join(facts.values())}]::double[]) as number, null as text from {source}")


def _shown(value: str, places: int) -> str:
    """A value as evidence shows it: the nearest decimal, ties up."""
    return f"round(cast({value} as decimal(24, 9)), {places})"


#: What the detectors put into their evidence; two facts are text.
EVIDENCE = " union all ".join([
    _facts("dga", "registrable_domain", "hosts", "dga_f where score >= {dga_score}", {
        "entropy_bits_per_char": _shown("entropy", 2), "rare_bigram_ratio": _shown("rare_ratio", 2),
        "digit_ratio": _shown("digit_ratio", 2), "n_queries": "n_queries",
        "nxdomain_ratio": _shown("nxdomain_ratio", 2)}),
    _facts("tunneling", "registrable_domain", "src_ip",
           "tunnel_f where score >= {tunnel[score_threshold]}", {
        "n_queries": "n_queries", "avg_subdomain_len_chars": _shown("avg_len", 1),
        "queries_per_min": _shown("rate", 2), "unique_label_ratio": _shown("unique_ratio", 2),
        "txt_null_ratio": _shown("txt_null_ratio", 2),
        "avg_subdomain_entropy": _shown("avg_entropy", 2)}),
    _facts("beaconing", "query_name", "src_ip",
           "beacon_f where coefficient_of_variation <= {beacon[cv_threshold]} "
           "and score >= {beacon[score_threshold]}", {
        "n_queries": "n_queries", "mean_interval_sec": _shown("mean_interval_sec", 1),
        "std_interval_sec": _shown("std_interval_sec", 2),
        "coefficient_of_variation": _shown("coefficient_of_variation", 3)}),
    _facts("nxdomain_spike", "names", "src_ip", "nx_f", {
        "max_nxdomain_in_window": "max_nxdomain_in_window",
        "window_minutes": "{burst[window_minutes]}",
        "host_nxdomain_ratio": _shown("host_nxdomain_ratio", 2),
        "total_nxdomain_events": "total_nxdomain_events"}),
    _facts("typosquat", "registrable_domain", "hosts", "squat_f", {
        "edit_distance": "edit_distance", "n_queries": "n_queries"}),
    "select 'typosquat', registrable_domain, hosts, 'matched_brand', null, matched_brand from squat_f",
    _facts("fast_flux", "registrable_domain", "hosts", "flux_f where score >= 45", {
        "distinct_ips": "distinct_ips", "n_resolved_queries": "n_resolved",
        "unique_ip_ratio": _shown("ip_ratio", 2), "avg_ttl_sec": _shown("avg_ttl", 1)}),
    _facts("newly_registered", "registrable_domain", "hosts",
           "young_f where age_days <= 7 and score >= 40", {
        "age_days": _shown("age_days", 1), "n_queries": "n_queries"}),
    _facts("doh_evasion", "providers", "src_ip", "doh_f", {"n_queries": "n_queries"}),
    "select 'doh_evasion', providers, src_ip, 'providers', null, "
    "'[\"' || replace(providers, ';', '\",\"') || '\"]' from doh_f",
])

SELECTS = {
    "alert_evidence": ("tf", EVIDENCE),
    "normalize_domains": ("", """
        select us, src_ip, query_name, query_type, response_code, response_ip, ttl,
          query_size_bytes, first_registered_days_ago, ground_truth_label, registrable_domain,
          subdomain, subdomain_label_count, subdomain_len from ev"""),
    "label_entropy": ("t", """
        select query_name, n_queries, round(a.h, 6) as name_entropy, round(b.h, 6) as label_entropy
        from (select query_name, count(*) as n_queries from ev group by query_name) n
        join ent a on a.s = query_name join ent b on b.s = string_split(query_name, '.')[1]"""),
    "rare_bigrams": ("t", """
        select query_name, n_queries, round(r, 6) as rare_ratio, round(g, 6) as digit_ratio
        from (select query_name, count(*) as n_queries from ev group by query_name) n
        join rare on rare.s = query_name join digits on digits.s = query_name"""),
    "levenshtein_pairs": ("", """
        select query_name, registrable_domain, d as distance,
          case when d <= 4 then d else -1 end as distance_up_to_4
        from (select distinct query_name, registrable_domain,
                cast(levenshtein(query_name, registrable_domain) as bigint) as d from ev)"""),
    "sql_functions": ("t", """
        select query_name, registrable_domain as domain, subdomain as sub,
          subdomain_label_count as n_labels, round(h, 6) as entropy, round(r, 6) as rare_ratio,
          round(g, 6) as digit_ratio,
          case when h * 25 >= 85 then 'Critical' when h * 25 >= 65 then 'High'
               when h * 25 >= 40 then 'Medium' else 'Low' end as severity
        from (select distinct query_name, registrable_domain, subdomain, subdomain_label_count
              from ev) n
        join ent on ent.s = query_name join rare on rare.s = query_name
        join digits on digits.s = query_name"""),
    "bind_lines": ("", """
        select us // 1000 * 1000 as us, src_ip, query_name, query_type,
          case when response_code = 'NXDOMAIN' then 'NXDOMAIN' else '' end as response_code,
          '' as response_ip, cast(0 as bigint) as ttl, query_size_bytes, registrable_domain
        from ev"""),
    "zeek_lines": ("", """
        select us, src_ip, query_name, query_type, response_code, response_ip, ttl,
          query_size_bytes, registrable_domain from ev"""),
    "dga_features": ("tf", """
        select registrable_domain, label, n_queries, last_us,
          round(nxdomain_ratio, 6) as nxdomain_ratio, round(entropy, 6) as entropy,
          round(rare_ratio, 6) as rare_ratio, round(digit_ratio, 6) as digit_ratio,
          round(score, 6) as score from dga_f"""),
    "tunneling_features": ("tf", """
        select src_ip, registrable_domain, n_queries, last_us,
          round(duration_min, 6) as duration_min, round(rate, 6) as rate,
          round(avg_len, 6) as avg_len, round(txt_null_ratio, 6) as txt_null_ratio,
          round(unique_ratio, 6) as unique_ratio, round(avg_entropy, 6) as avg_entropy,
          round(score, 6) as score from tunnel_f"""),
    "beaconing_features": ("tf", """
        select src_ip, query_name, n_queries, last_us,
          round(mean_interval_sec, 3) as mean_interval_sec,
          round(std_interval_sec, 3) as std_interval_sec,
          round(coefficient_of_variation, 6) as coefficient_of_variation,
          round(score, 6) as score from beacon_f"""),
    "nxdomain_burst": ("tf", """
        select src_ip, max_nxdomain_in_window, total_nxdomain_events, host_total,
          round(host_nxdomain_ratio, 6) as host_nxdomain_ratio, end_us, names,
          round(score, 6) as score from nx_f"""),
    "typosquat": ("tf", """
        select registrable_domain, edit_distance, matched_brand, n_queries, last_us,
          cast(score as double) as score from squat_f"""),
    "typosquat_brand_table": ("", """
        select a.registrable_domain, min(levenshtein(a.registrable_domain, b.registrable_domain))
            as edit_distance, any_value(a.n) as n_queries,
          cast(92.0 - 24 * (min(levenshtein(a.registrable_domain, b.registrable_domain)) - 1)
            as double) as score
        from (select registrable_domain, count(*) as n from ev group by registrable_domain) a
        join (select distinct registrable_domain from ev where length(registrable_domain) % 2 = 0) b
          on levenshtein(a.registrable_domain, b.registrable_domain) <= 2
        where length(a.registrable_domain) % 2 = 1 and length(a.registrable_domain) >= 4
        group by a.registrable_domain"""),
    "fast_flux": ("tf", """
        select registrable_domain, distinct_ips, n_resolved, round(ip_ratio, 6) as ip_ratio,
          round(avg_ttl, 6) as avg_ttl, last_us, round(score, 6) as score from flux_f"""),
    "newly_registered": ("tf", """
        select registrable_domain, round(age_days, 6) as age_days, n_queries, last_us,
          round(score, 6) as score from young_f"""),
    "doh_hosts": ("tf", "select src_ip, providers, n_queries, last_us from doh_f"),
    "host_lists": ("", """
        select registrable_domain, {hosts} as hosts from ev group by registrable_domain"""),
    "kpi_sketches": ("", """
        select count(*) as total_queries, count(distinct registrable_domain) as unique_domains,
          count(distinct src_ip) as unique_hosts, true as hosts_close from ev"""),
    "domain_sketches": ("", """
        select registrable_domain, count(*) as n_queries,
          count(*) filter (where response_code = 'NXDOMAIN') as n_nx,
          count(distinct src_ip) as unique_hosts, true as hosts_close
        from ev group by registrable_domain"""),
    "alerts_union": ("tfa", """
        select 'ALT-' || case when alert_no < 10000
            then right('000' || cast(alert_no as varchar), 4)
            else cast(alert_no as varchar) end as alert_id, us, detector, severity_score, severity_label,
          src_ip, domain, mitre_id, mitre_name from alerts"""),
    "host_risk": ("tfa", "select * from host_risk"),
    "risk_leaderboard": ("tfa", """
        select * from host_risk order by risk_score desc, src_ip limit 8"""),
    "tactic_summary": ("tfa", """
        select src_ip, tactic, count(*) as n_alerts, max(severity_score) as max_severity,
          array_to_string(list_sort(list(distinct detector)), ', ') as detectors
        from per_host group by src_ip, tactic"""),
    "host_tactics": ("tfa", """
        select tactic, count(*) as n_alerts, max(severity_score) as max_severity,
          array_to_string(list_sort(list(distinct detector)), ', ') as detectors
        from per_host where src_ip = '{host}' group by tactic"""),
    "timeline": ("tfa", """
        select us, detector, severity_score, severity_label, hosts as src_ip, domain, mitre_id
        from per_host where src_ip = '{host}'"""),
    "kill_chain": ("tfa", """
        select h.src_ip, t.position, t.tactic, s.max_severity,
          case when s.max_severity >= 85 then 'Critical' when s.max_severity >= 65 then 'High'
               when s.max_severity >= 40 then 'Medium' when s.max_severity is not null then 'Low'
               end as severity_label
        from (select distinct src_ip from per_host) h
        cross join (select unnest(['Reconnaissance', 'Resource Development',
                      'Command and Control']) as tactic, unnest(range(3)) as position) t
        left join (select src_ip, tactic, max(severity_score) as max_severity
                   from per_host group by src_ip, tactic) s
          on s.src_ip = h.src_ip and s.tactic = t.tactic"""),
    "summary_metrics": ("tfa", """
        select (select count(*) from ev) as n_events,
          (select count(distinct src_ip) from ev) as n_hosts,
          (select count(*) from alerts) as n_alerts,
          (select count(distinct detector) from alerts) as n_detectors_fired,
          (select count(*) from host_risk) as n_flagged_hosts,
          (select count(*) from host_risk where risk_label = 'Critical') as n_critical_hosts,
          (select count(*) from host_risk where n_detectors > 1) as n_multi_detector_hosts"""),
    "recall_by_scenario": ("tfa", """
        select scenario, scenario as detector, '(host, domain) pairs' as unit,
          count(*) as ground_truth_total, count(hit) as caught,
          cast(round(count(hit) / count(*), 2) as double) as recall
        from (select distinct ground_truth_label as scenario, src_ip,
                registrable_domain as domain from ev where ground_truth_label <> 'benign') t
        left join (select distinct detector as scenario, src_ip, domain, 1 as hit
                   from per_name) f using (scenario, src_ip, domain)
        group by scenario"""),
    "false_positives": ("tfa", """
        select count(*) as benign_hosts_total,
          count(*) filter (where src_ip in (select src_ip from per_host)) as false_positive_hosts,
          cast(round(avg(case when src_ip in (select src_ip from per_host) then 1.0 else 0.0 end),
                     3) as double) as false_positive_rate
        from benign"""),
    "false_positive_hosts": ("tfa", """
        select src_ip from benign where src_ip in (select src_ip from per_host)"""),
    "kpis": ("tfa", """
        select count(*) as total_queries, count(distinct src_ip) as unique_hosts,
          count(distinct registrable_domain) as unique_domains,
          (select count(*) from alerts) as alerts_raised from ev"""),
    "traffic_15min": ("", """
        select b as bucket_us, (select count(*) from ev where us // 900000000 * 900000000 = b)
          as n_queries
        from (select unnest(range(min(us) // 900000000 * 900000000, max(us) + 1, 900000000)) as b
              from ev)"""),
    "top_talkers": ("", """
        select src_ip, count(*) as n from ev group by src_ip order by n desc, src_ip limit 10"""),
    "top_domains": ("", """
        select registrable_domain, count(*) as n from ev group by registrable_domain
        order by n desc, registrable_domain limit 10"""),
    "response_codes": ("", """
        select response_code, count(*) as n from ev group by response_code"""),
    "alerts_by_detector": ("tfa", """
        select detector, count(*) as n from alerts group by detector"""),
    "alert_search": ("tfa", """
        select us, detector, severity_score, severity_label, src_ip, domain from alerts
        where severity_label in ('Critical', 'High')
          and (regexp_matches(domain, '^th.*[.](com|org)$', 'i')
               or regexp_matches(src_ip, '^th.*[.](com|org)$', 'i'))"""),
    "critical_status": ("tfa", """
        select (select count(*) from alerts where severity_label = 'Critical') as critical_alerts,
          exists (select 1 from host_risk where risk_label = 'Critical') as any_critical_host"""),
    "top_critical_alerts": ("tfa", """
        select detector, severity_score, domain, src_ip from alerts
        where severity_label = 'Critical' order by alert_no limit 3"""),
    "domain_detail": ("tfa", """
        select count(*) as total_queries, count(distinct src_ip) as unique_hosts,
          coalesce(round(avg(case when response_code = 'NXDOMAIN' then 1.0 else 0.0 end), 6), 0)
            as nxdomain_rate,
          (select count(distinct detector) from per_name where domain = '{domain}') as n_detectors
        from ev where registrable_domain = '{domain}'"""),
    "domain_alerts": ("tfa", """
        select distinct detector, severity_score, hosts as src_ip, listed as domain
        from per_name where domain = '{domain}'"""),
    "domain_history": ("", """
        select us, src_ip, query_type, response_code, response_ip, ttl from ev
        where registrable_domain = '{domain}'"""),
    "flagged_domains": ("tfa", """
        select distinct registrable_domain from ev
        where registrable_domain in (select domain from per_name)"""),
    "default_domain": ("tfa", """
        select domain as registrable_domain from per_name
        where alert_no = 1 and starts_with(listed, name) limit 1"""),
    "alert_hosts": ("tfh", """
        select 'ALT-' || case when alert_no < 10000
            then right('000' || cast(alert_no as varchar), 4)
            else cast(alert_no as varchar) end as alert_id, src_ip from per_host"""),
    "typosquat_cut_brands": ("", """
        select * exclude (place) from (
          select registrable_domain, d as edit_distance, brand as matched_brand, n_queries, last_us,
            cast(92.0 - 24 * (d - 1) as double) as score,
            row_number() over (partition by registrable_domain order by d, brand) as place
          from (select *, levenshtein(registrable_domain, brand) as d
                from (select registrable_domain, count(*) as n_queries, max(us) as last_us
                      from ev group by registrable_domain)
                cross join (select distinct substr(registrable_domain, 2) as brand from ev))
          where d between 1 and 2 and length(registrable_domain) >= 4
            and registrable_domain not in (select substr(registrable_domain, 2) from ev))
        where place = 1"""),
    "timestamp_layouts": ("", """
        select src_ip, query_name, count(*) as n, min(t) as first_us, max(t) as last_us
        from (select src_ip, query_name, host % 6 as layout,
                us // 1000000 * 1000000 - case when host % 6 = 3 then 7200000000 else 0 end as t
              from (select *, cast(string_split(src_ip, '.')[3] as bigint) * 256
                      + cast(string_split(src_ip, '.')[4] as bigint) as host from ev))
        where layout <> 5 group by src_ip, query_name"""),
    "alert_list": ("tfa", """
        select 'ALT-' || case when alert_no < 10000
            then right('000' || cast(alert_no as varchar), 4)
            else cast(alert_no as varchar) end as alert_id, severity_label, detector, src_ip, domain,
          mitre_id, row_number() over (order by case severity_label when 'Critical' then 0
            when 'High' then 1 when 'Medium' then 2 else 3 end, alert_no) as position
        from alerts"""),
    "alert_preview": ("tfa", """
        select 'ALT-' || right('000' || cast(alert_no as varchar), 4) as alert_id, us, detector,
          severity_score, severity_label, src_ip, domain, mitre_id
        from alerts where alert_no <= 15"""),
}

#: Queries whose statement is another's over every host of an alert.
OVER_ALL_HOSTS = {
    "host_risk_all_hosts": "host_risk", "tactic_summary_all_hosts": "tactic_summary",
    "host_tactics_all_hosts": "host_tactics", "timeline_all_hosts": "timeline",
    "kill_chain_all_hosts": "kill_chain", "recall_all_hosts": "recall_by_scenario",
    "false_positives_all_hosts": "false_positives",
}
SELECTS.update({name: ("tfh", SELECTS[same][1]) for name, same in OVER_ALL_HOSTS.items()})

SAME_AS = {
    "beaconing_heavy_pairs": "beaconing_features",
    "nxdomain_burst_heavy_hosts": "nxdomain_burst",
    "csv_files": "normalize_domains", "bind_files": "bind_lines", "zeek_files": "zeek_lines",
    "alert_files": "alerts_union",
}


def build(*, words, suffixes, brands, providers, dga_score, tunnel, beacon, burst, host,
          domain) -> dict[str, str]:
    values = {
        "words": _quoted(words), "suffixes": _quoted(suffixes), "brands": _quoted(brands),
        "n_brands": len(brands), "providers": _quoted(providers), "dga_score": dga_score,
        "tunnel": tunnel, "beacon": beacon, "burst": burst, "host": host, "domain": domain,
        "width": round(burst["window_minutes"] * 60_000_000), "hosts": HOSTS,
    }
    blocks = {"t": TEXT, "f": FEATURES, "a": ALERTS, "h": ALL_HOSTS}
    statements = {}
    for name, (needs, select) in SELECTS.items():
        tables = ",".join([VIEW, *[blocks[b] for b in needs]])
        statements[name] = f"with {tables}\n{select}".format(**values)
    statements.update({name: statements[same] for name, same in SAME_AS.items()})
    return statements
