import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of the smallest scale factor with edge rows: nulls in every column, empty
    and blank texts, a very long word and text, repeated rows, ties."""
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = given.collect()
    long_text = " ".join(r.text for r in rows[:40])
    edge = [(9000, None, "en", "src0", None), (9001, "", "en", "src0", 0), (9002, " \t\n\x0b\x0c\r ", None, None, None),
            (9003, "x" * 30000, "de", None, 30000), (9004, long_text, "en", "src1", len(long_text)),
            (9005, "one two", "en", "src2", 7), (9006, "12 345 6", "fr", "src2", 8),
            (9007, "Été \U0001f600 中文 naïve", "fr", "src3", 10),
            (rows[3].doc_id, rows[3].text, rows[3].lang, rows[3].source, rows[3].n_chars),  # a repeated row
            (9009, rows[5].text, rows[5].lang, rows[5].source, 1), (9010, rows[5].text, "en", "src0", 1)]
    return spark.createDataFrame([tuple(r) for r in rows] + edge, given.schema).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def clash(df, *names):
    """The frame with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("extra") for n in names})
