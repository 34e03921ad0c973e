import pytest

#: Rows that every operator on documents must bear: nulls, empty and blank texts, repeats, ties, one very long text.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "src0"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "src0"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "src0"),
    (3, None, None, None),
    (4, "", "en", "src1"),
    (5, " \t\n ", "en", "src1"),
    (None, "a text whose id is missing, of nine words", "en", "src1"),
    (6, "two words", "de", "src2"),
    (7, "ÄÖÜ ß été ́x   <|endoftext|> it's 1234 日本語", "fr", "src2"),
    (8, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "src3"),
    (9, "spam!! SPAM!! $$$ ### spam spam spam spam spam", "en", "src3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
LABELS = [(1, 1, 0), (2, 1, 0), (4, 1, 0), (6, 1, 1), (8, 1, 0), (9, 0, 0), (7, None, None), (None, 1, 0), (2, 1, 0)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """The documents with extra columns named like those that operators add or use."""
    from pyspark.sql import functions as F

    out = documents
    for c in ("score", "shard", "slot", "fp", "id", "key", "n", "run", "rate", "copies", "tokens", "posterior", "length", "sequence_id", "offset", "held_out", "row", "component_id", "bands"):
        out = out.withColumn(c, F.lit(None).cast("string"))
    return out
