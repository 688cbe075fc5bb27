"""Column expressions and SQL functions."""

from nametrail.functions.scoring import (
    severity_label,
    severity_rank,
    tactic_of,
    tactic_rank,
    technique_name,
)
from nametrail.functions.text import (
    common_bigrams,
    digit_ratio,
    levenshtein,
    rare_bigram_ratio,
    register_sql_functions,
    registrable_domain,
    shannon_entropy,
    split_domain_labels,
    subdomain,
)

__all__ = [
    "common_bigrams", "digit_ratio", "levenshtein", "rare_bigram_ratio",
    "register_sql_functions", "registrable_domain", "severity_label",
    "severity_rank", "shannon_entropy", "split_domain_labels", "subdomain",
    "tactic_of", "tactic_rank", "technique_name",
]
