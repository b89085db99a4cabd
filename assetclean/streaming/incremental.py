"""Incremental enrichment: each new inventory file is one run that reuses the
caches of the previous runs (the source's between-run cache reuse).

A file stream feeds ``foreachBatch``; every micro-batch is enriched against
the caches that the batches before it left, and writes under its own batch id:
its output, the cache buckets that its entries fall into and, last of all, a
marker that names for every bucket the batch which wrote it last. A batch reads
the marker before its own, so a batch that is run again after a failure sees
what it saw before and overwrites only its own folders.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetclean.plans.enrich import csv_writer, enrich
from assetclean.sources import caches

CACHES = {
    "types": ("type_key", caches.TYPE_CACHE_SCHEMA),
    "dates": ("date_key", caches.DATE_CACHE_SCHEMA),
    "manufacturers": ("mfr_key", caches.MFR_CACHE_SCHEMA),
}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def finished(spark: SparkSession, state_dir: str, before: int) -> list[int]:
    """Ids below ``before`` whose marker is there, in order."""
    fs, done = _fs(spark, os.path.join(state_dir, "done"))
    if not fs.exists(done):
        return []
    names = (st.getPath().getName() for st in fs.listStatus(done))
    return sorted(int(n) for n in names if n.isdigit() and int(n) < before)


def bucket_versions(spark: SparkSession, state_dir: str, batch_id: int) -> dict[str, dict[int, int]]:
    """Of each cache, which batch wrote each bucket last, as batch
    ``batch_id`` must see it."""
    ids = finished(spark, state_dir, batch_id)
    if not ids:
        return {name: {} for name in CACHES}
    text = spark.read.text(os.path.join(state_dir, "done", str(ids[-1])), wholetext=True).first()[0]  # a few numbers for each bucket
    return {name: {int(b): v for b, v in of.items()} for name, of in json.loads(text).items()}


def cache_before(spark: SparkSession, state_dir: str, name: str, batch_id: int) -> DataFrame | None:
    """The cache as batch ``batch_id`` must see it."""
    versions = bucket_versions(spark, state_dir, batch_id)[name]
    return caches.read_buckets(spark, os.path.join(state_dir, name), versions, CACHES[name][1]) if versions else None


def process_batch(df: DataFrame, batch_id: int, out_dir: str, state_dir: str, **answers: DataFrame | None) -> None:
    """One run. ``answers``: the resolvers' answers that ``enrich`` takes."""
    spark = df.sparkSession
    raw = df.withColumn("_ord", F.monotonically_increasing_id())
    versions = bucket_versions(spark, state_dir, batch_id)
    before = {name: cache_before(spark, state_dir, name, batch_id) for name in CACHES}
    res = enrich(raw, types=before["types"], dates=before["dates"], mfr_cache=before["manufacturers"], **answers)
    csv_writer(res.enriched.drop("_ord")).csv(os.path.join(out_dir, f"batch={batch_id}"))
    for name, (key, schema) in CACHES.items():
        after = getattr(res, name)
        if before[name] is not None:  # what is new or changed
            values = [c for c in before[name].columns if c != "entry_pos"]
            old = before[name].select(*values)
            after = after.join(old, [after[c].eqNullSafe(old[c]) for c in values], "left_anti")
        versions[name] = caches.write_buckets(after, os.path.join(state_dir, name), batch_id, versions[name], key, schema)
    mark(spark, state_dir, batch_id, versions)


def mark(spark: SparkSession, state_dir: str, batch_id: int, versions: dict[str, dict[int, int]]) -> None:
    """Write the marker aside and move it in place, so that it is whole or not there."""
    fs, marker = _fs(spark, os.path.join(state_dir, "done", str(batch_id)))
    _, aside = _fs(spark, os.path.join(state_dir, "done", f"_{batch_id}"))
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(versions), "utf-8"))
    out.close()
    fs.delete(marker, False)
    if not fs.rename(aside, marker):
        raise OSError(f"could not write {marker}")


def start(
    spark: SparkSession,
    input_dir: str,
    schema: str,
    out_dir: str,
    state_dir: str,
    checkpoint_dir: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the incremental job over CSV files arriving in ``input_dir``.
    One file per micro-batch, so each file is one run."""
    stream = spark.readStream.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    stream = stream.option("maxFilesPerTrigger", 1).schema(schema).csv(input_dir)
    w = stream.writeStream.foreachBatch(lambda df, bid: process_batch(df, bid, out_dir, state_dir)).option(
        "checkpointLocation", checkpoint_dir
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
