"""Severity, technique look-ups and the sort ranks derived from them."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nametrail.constants import (
    LOWEST_SEVERITY,
    MAX_SCORE,
    MITRE_TACTIC,
    MITRE_TECHNIQUES,
    OTHER_TACTIC,
    OTHER_TACTIC_RANK,
    SEVERITY_FLOORS,
    SEVERITY_ORDER,
    TACTIC_ORDER,
)

SEVERITY_LABEL = (
    "case "
    + " ".join(f"when {{x}} >= {floor} then '{name}'" for name, floor in SEVERITY_FLOORS.items())
    + f" else '{LOWEST_SEVERITY}' end"
)


def severity_label(x: str) -> Column:
    return F.expr(SEVERITY_LABEL.format(x=x))


def clamp_score(score: Column) -> Column:
    """Into [0, 100], one decimal."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(MAX_SCORE), score)), 1)


def lookup(key: Column, mapping: Mapping, default) -> Column:
    """Value of a small constant mapping, ``default`` for unknown keys."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def technique_name(mitre_id: Column) -> Column:
    return lookup(mitre_id, MITRE_TECHNIQUES, "")


def tactic_of(mitre_id: Column) -> Column:
    return lookup(mitre_id, MITRE_TACTIC, OTHER_TACTIC)


def tactic_rank(tactic: Column, order: Sequence[str] = TACTIC_ORDER) -> Column:
    return lookup(tactic, {t: i for i, t in enumerate(order)}, OTHER_TACTIC_RANK)


def severity_rank(label: Column) -> Column:
    return lookup(label, SEVERITY_ORDER, len(SEVERITY_ORDER))


def capped(x: Column, full: float) -> Column:
    """``x / full``, at most 1."""
    return F.least(x / F.lit(float(full)), F.lit(1.0))
