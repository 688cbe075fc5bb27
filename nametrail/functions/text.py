"""Text and domain features as Catalyst expressions.

Each feature is one SQL expression template over ``{x}``; the Column helper and
the SQL function registered by :func:`register_sql_functions` share it. Helpers
take a column name or SQL expression text, e.g. ``shannon_entropy("label")``.
No Python runs per row.
"""

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from nametrail.constants import MULTI_PART_TLDS, VOCABULARY

WHITESPACE = r" \t\n\r\u000b\u000c"


def _in_list(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def common_bigrams(words: Iterable[str] = VOCABULARY) -> list[str]:
    """Distinct adjacent letter pairs of a word list."""
    return sorted({a + b for w in words for a, b in zip(w, w[1:])})


# Trailing dots go first, then case, then outer white space.
CLEAN_NAME = "btrim(lower(rtrim('.', coalesce({x}, ''))), '" + WHITESPACE + "')"

# Of a cleaned name: the last two labels, or three below a two-label suffix.
REGISTRABLE_OF_CLEAN = (
    f"if(substring_index({{x}}, '.', -2) in ({_in_list(MULTI_PART_TLDS)}), "
    "substring_index({x}, '.', -3), substring_index({x}, '.', -2))"
)

REGISTRABLE_DOMAIN = REGISTRABLE_OF_CLEAN.format(x=CLEAN_NAME)

SHANNON_ENTROPY = (
    "aggregate(array_distinct(split({x}, '')), 0D, (acc, ch) -> if(ch = '', acc, "
    "acc - (length({x}) - length(replace({x}, ch, ''))) / length({x}) "
    "* log2((length({x}) - length(replace({x}, ch, ''))) / length({x}))))"
)

DIGIT_RATIO = (
    "coalesce((length({x}) - length(translate({x}, '0123456789', ''))) "
    "/ nullif(length({x}), 0), 0D)"
)


def _rare_bigram_template(bigrams: Iterable[str]) -> str:
    return (
        "aggregate(flatten(transform(filter(split({x}, '-'), seg -> length(seg) >= 2), "
        "seg -> transform(sequence(1, length(seg) - 1), i -> substring(seg, i, 2)))), "
        "named_struct('n', 0, 'rare', 0), "
        "(acc, pair) -> named_struct('n', acc.n + 1, 'rare', "
        f"acc.rare + if(pair in ({_in_list(bigrams)}), 0, 1)), "
        "acc -> if(acc.n = 0, 0D, acc.rare / acc.n))"
    )


RARE_BIGRAM_RATIO = _rare_bigram_template(common_bigrams())


def computed_once(value: Column) -> Column:
    """Keep later filters from repeating a costly expression.

    Catalyst copies the expression into every filter it pushes below the
    projection. It does not push filters below a generator, so a one-element
    array is exploded: same rows, one evaluation.
    """
    return F.explode(F.array(value))


def clean_name(x: str) -> Column:
    return F.expr(CLEAN_NAME.format(x=x))


def registrable_of_clean(x: str) -> Column:
    """Registrable domain of a name that :func:`clean_name` already cleaned."""
    return F.expr(REGISTRABLE_OF_CLEAN.format(x=x))


def registrable_domain(x: str) -> Column:
    return F.expr(REGISTRABLE_DOMAIN.format(x=x))


def subdomain(x: str) -> Column:
    """Labels in front of the registrable domain, joined with dots."""
    return F.expr(_subdomain_sql(x))


def _subdomain_sql(x: str) -> str:
    clean = CLEAN_NAME.format(x=x)
    registrable = REGISTRABLE_OF_CLEAN.format(x=clean)
    return f"left({clean}, length({clean}) - length({registrable}) - 1)"


def _labels_sql(x: str) -> str:
    clean = CLEAN_NAME.format(x=x)
    registrable = REGISTRABLE_OF_CLEAN.format(x=clean)
    return (
        f"if(length({clean}) = length({registrable}), cast(array() as array<string>), "
        rf"split({_subdomain_sql(x)}, '[.]'))"
    )


def split_domain_labels(x: str) -> Column:
    """Subdomain labels as ``array<string>``."""
    return F.expr(_labels_sql(x))


def second_level_label(x: str) -> Column:
    """Text before the first dot."""
    return F.expr(f"substring_index({x}, '.', 1)")


def shannon_entropy(x: str) -> Column:
    """Bits per character; 0 for an empty string."""
    return F.expr(SHANNON_ENTROPY.format(x=x))


def digit_ratio(x: str) -> Column:
    """Share of ASCII digits."""
    return F.expr(DIGIT_RATIO.format(x=x))


def rare_bigram_ratio(x: str, bigrams: Iterable[str] | None = None) -> Column:
    """Share of letter pairs outside the common set, per hyphen segment."""
    template = RARE_BIGRAM_RATIO if bigrams is None else _rare_bigram_template(bigrams)
    return F.expr(template.format(x=x))


def levenshtein(left: str, right: str, threshold: int | None = None) -> Column:
    """Edit distance; -1 beyond ``threshold`` when one is given."""
    if threshold is None:
        return F.levenshtein(F.expr(left), F.expr(right))
    return F.levenshtein(F.expr(left), F.expr(right), threshold)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names.

    The bodies are plain SQL, so Catalyst inlines them into the calling query.
    """
    from nametrail.functions.scoring import SEVERITY_LABEL

    bodies = {
        "split_domain_labels": ("x STRING", "ARRAY<STRING>", _labels_sql("x")),
        "registrable_domain": ("x STRING", "STRING", REGISTRABLE_DOMAIN.format(x="x")),
        "subdomain": ("x STRING", "STRING", _subdomain_sql("x")),
        "shannon_entropy": ("x STRING", "DOUBLE", SHANNON_ENTROPY.format(x="x")),
        "rare_bigram_ratio": ("x STRING", "DOUBLE", RARE_BIGRAM_RATIO.format(x="x")),
        "digit_ratio": ("x STRING", "DOUBLE", DIGIT_RATIO.format(x="x")),
        "severity_label": ("x DOUBLE", "STRING", SEVERITY_LABEL.format(x="x")),
    }
    for name, (args, returns, body) in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}"
        )
    return list(bodies)
