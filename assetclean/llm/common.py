"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new path under the shared folder that ``spark.checkpoint.dir`` names.
    Only a local master with no such setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="assetclean-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`cut` and the path it wrote."""
    path = f"{shared_dir(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the rows are
    fixed, the lineage ends, and column pruning still works."""
    return cut_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`cut_at` that nothing will read again: what was
    made from it must be written, not planned."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is written in this block goes to Python in batches of so many rows
    at most: for rows with whole texts or sets, of which a usual batch fills
    tens of MB in the JVM and as much in the Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column, lower: bool = False) -> Column:
    """The words of a text (null: none), optionally with A-Z lowered."""
    t = F.coalesce(text, F.lit(""))
    if lower:
        t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), "")


def id_hash(key: Column) -> Column:
    """60 even bits of a key's decimal text (null as empty text), the same in
    any engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that no helper column can clash
    with them; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
