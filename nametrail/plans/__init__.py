"""Whole-log plans: all detectors, risk, evaluation and analytics."""

from nametrail.plans.evaluation import evaluate_against_ground_truth
from nametrail.plans.pipeline import (
    DETECTOR_FUNCS,
    number_alerts,
    run_all_detectors,
    union_alerts,
)
from nametrail.plans.risk import (
    alert_hosts,
    compute_host_risk,
    generate_executive_summary,
    host_alert_timeline,
    host_tactic_summary,
)

__all__ = [
    "DETECTOR_FUNCS", "alert_hosts", "compute_host_risk", "evaluate_against_ground_truth",
    "generate_executive_summary", "host_alert_timeline", "host_tactic_summary",
    "number_alerts", "run_all_detectors", "union_alerts",
]
