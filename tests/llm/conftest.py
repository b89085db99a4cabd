import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents() -> list[tuple]:
    """Nulls in any column, empty and white-space texts, repeated rows, equal
    texts, and one very long text."""
    prose = "The quick brown fox jumps over the lazy dog while seven wizards\nwatch from a distant hill and count the stars. "
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    rows = [
        (1, prose, "en", "b", 10),
        (2, prose, "en", "a", 10),
        (2, prose, "en", "a", 10),  # repeated row
        (3, None, "de", "a", None),
        (4, "", None, None, 0),
        (5, " \t\r\n\x0b\x0c ", "fr", "é", 6),
        (6, "drei kleine Wörter", "de", None, 18),
        (None, prose + "and one more", "en", "a", 1),
        (None, None, None, None, None),
        (7, long, "en", "b", len(long)),
        (8, long + " tail", None, "z", len(long)),
        (9, "naïve café — 日本語 \U0001f600 ok", "fr", "\U0001f600", 5),
        (10, "the same words the same words the same words the same words", "en", "c", 1),
    ]
    return [(*r,) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names helpers might want."""
    schema = T.StructType([*T.StructType.fromDDL(DOCS).fields, *(T.StructField(c, T.StringType()) for c in ("key", "node", "part", "row", "h", "size", "rank", "copies", "threshold", "_score", "_lang_pred", "leak", "bucket"))])
    return spark.createDataFrame([(*r, *["x"] * 13) for r in odd_documents()], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """One document's rows of the smallest table, as a plain list too."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [tuple(r) for r in df.collect()]


@pytest.fixture
def duck():
    def run(sql: str, **tables) -> list[tuple]:
        con = duckdb.connect()
        for name, pdf in tables.items():
            con.register(name, pdf)
        return con.execute(sql).fetchall()

    return run
