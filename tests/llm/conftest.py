import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size string, "
          "rank string, start string, s int, u string, rep string, key string, copies string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns of clashing names."""

    def build(rows):
        full = [(row[0], row[1], "en", row[2] if len(row) > 2 else "src", 1, "x", "x", "x", 7, "x",
                 "x", "x", "x") for row in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space, one word, marks, very long ones, repeated rows."""
    long = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
    return [
        (0, None), (1, ""), (2, "   \t\n"), (3, "one"), (4, "one two  three\n\nfour"), (5, long),
        (6, long), (7, "été 日本語 \U0001f600 <|endoftext|> it's ▁x"), (8, "x" * 70_000),
        (9, "same text in five words"), (9, "same text in five words"), (10, "same text in five words"),
        (11, "a\r\nb\x00c 　 d"), (12, "\n"),
    ]
