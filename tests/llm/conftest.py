import pytest

SF = "/root/testdata/sf0.001"
#: Extra columns whose names clash with those the operators add.
CLASHES = ("id", "size", "kept", "score", "shard", "slot", "piece", "start", "length", "labels", "predicted", "p", "chunk", "quality", "toxic", "cls", "bands", "n", "copies", "target", "n_words", "h", "part", "stratum", "signals")


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in any column, ids that doubles cannot hold, one id for several texts, empty, blank and very long texts, ties, repeated rows and clashing columns."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    prose = " ".join(f"token{k}" for k in range(80))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\r ", "en", "a"), (4, long, "en", "a"), (5, prose, "en", None), (5, prose, "en", None), (6, prose, None, "b"),
        (7, prose + " extra", "de", "b"), (8, "é́ 中文 \U0001d573 a b", "fr", "a"), (9, "one", "en", "b"), (10, "MIT License, apache license; General Public License", "en", "\U0001d573"),
        (None, prose + " without an id", "en", "a"), (None, prose + " without an id", "en", "a"), (None, "another text", "en", "a"), (None, None, None, None),
        (2**60 + 1, prose + " large", "en", "a"), (2**60 + 3, prose.replace("token", "other"), "en", "a"), (2**60 + 5, "large three", "en", "b"), (5, "another text of id five", "en", "a"),
    ]
    rows = [(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def table(spark):
    return lambda name, sf=SF: spark.read.parquet(f"{sf}/{name}.parquet")
