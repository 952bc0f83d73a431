import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing columns."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four "
    rows = [
        (1, base, "en", "src0", 1), (2, base, "en", "src1", 1), (2, base, "en", "src1", 1), (3, None, None, None, None), (4, "", "en", "src2", 0), (None, base, "en", "src0", 1), (None, None, None, None, None),
        (5, "é" * 3000, "fr", "src1", 1), (6, "word " * 4000, "en", "src2", 1), (7, "tiny", "de", "src0", 1), (8, "!!! 123 ...", "es", "src1", 1), (9, base + base, "en", "src0", 1), (10, " \t\n", "en", "src0", 1), (11, "x" * 20000, "en", "src2", 1),
    ]
    d = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F

    clashing = "row body epoch mix_tokens score label bands anchor content start n copies toxic kind end".split()
    return d.withColumns({c: F.lit(1) for c in clashing}).withColumn("__spans", F.lit("x"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
