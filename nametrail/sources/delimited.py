"""CSV event files."""

from pyspark.sql import DataFrame, SparkSession

REQUIRED = [
    "timestamp", "src_ip", "query_name", "query_type", "response_code",
    "response_ip", "ttl",
]


def read_csv(spark: SparkSession, path) -> DataFrame:
    """Raw rows, every column as text, columns found by header name.

    Only an empty field is null: the texts ``NULL`` and ``NA`` stay, since NULL
    is a DNS record type. With ``enforceSchema`` off, a file whose header differs
    from that of the first file raises instead of being read by position.
    """
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"CSV log lacks the columns {missing}")
    return raw
