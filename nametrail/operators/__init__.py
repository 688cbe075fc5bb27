"""Detectors: each has a feature table and an alert table."""

from nametrail.operators.beaconing import beaconing_features, detect_beaconing
from nametrail.operators.dga import detect_dga, dga_features
from nametrail.operators.doh import detect_doh_evasion, doh_features
from nametrail.operators.fast_flux import detect_fast_flux, fast_flux_features
from nametrail.operators.newly_registered import (
    detect_newly_registered_domain,
    newly_registered_features,
)
from nametrail.operators.nxdomain import detect_nxdomain_spike, nxdomain_features
from nametrail.operators.rollup import bounded_hosts, pair_rollup
from nametrail.operators.tunneling import detect_tunneling, tunneling_features
from nametrail.operators.typosquat import detect_typosquatting, typosquat_features

__all__ = [
    "beaconing_features", "bounded_hosts", "detect_beaconing", "detect_dga",
    "detect_doh_evasion", "detect_fast_flux", "detect_newly_registered_domain",
    "detect_nxdomain_spike", "detect_tunneling", "detect_typosquatting", "dga_features",
    "doh_features", "fast_flux_features", "newly_registered_features",
    "nxdomain_features", "pair_rollup", "tunneling_features", "typosquat_features",
]
