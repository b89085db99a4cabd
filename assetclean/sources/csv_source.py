"""Inventory CSV scan (header, UTF-8, every value a string) plus ``_ord``."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# the line scan's functions go to the workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows of one split: the low bits of monotonically_increasing_id
ROW_BITS = 33
#: ``file:///x`` and ``file:/x`` name the same file
SLASHES = "^([a-z]+):/+"


def read_inventory_csv(spark: SparkSession, path: str | list[str], order_col: str = "_ord", multi_line: bool = True) -> DataFrame:
    """Read RFC 4180 CSV (doubled quotes, quoted commas and newlines) as
    strings and number the rows.

    Files are read in splits either way. With ``multi_line`` a first pass finds
    out which line breaks are quoted (see :func:`records`);
    ``multi_line=False`` saves that pass for input without quoted newlines.

    ``_ord`` follows file path, place in the file, row. Spark packs files into
    tasks by size, so the number of the task says nothing about that order.
    """
    options = {"header": True, "encoding": "UTF-8", "inferSchema": False, "quote": '"', "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE"}
    df = spark.read.options(**options).csv(path)
    if multi_line:
        row = F.from_csv("text", _ddl([c.removesuffix("\r") for c in df.columns]), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
        return records(spark, path).select(row.alias("row"), F.col("number").alias("_number")).select("row.*", F.col("_number").alias(order_col))
    names = [F.col(f"`{c}`") for c in df.columns]
    split = df.select("*", F.regexp_replace("_metadata.file_path", SLASHES, "$1:/").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    split = split.withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1))
    order = split.select("_path", "_start").distinct()
    order = order.withColumn("_split", F.row_number().over(Window.orderBy("_path", "_start")).cast("long"))  # one row per split
    joined = split.join(order, ["_path", "_start"])
    return joined.select(*names, F.shiftleft("_split", ROW_BITS).bitwiseOR(F.col("_row")).alias(order_col))


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that starts inside
    a quoted field, or at the start of a field. A quote opens a field only as
    its first character; what follows a closing quote up to the comma belongs
    to the field."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            end = line.find('"', at)
            if end < 0:
                return True
            if line.startswith('"', end + 1):
                at = end + 2
                continue
            inside, at = False, end + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


EFFECTS = "path string, start long, end_out boolean, n_out long, end_in boolean, n_in long, cr boolean"
PIECES = "path string, number long, piece long, whole boolean, text string"


def _split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, path, start) -> per split what it does to the quoting: the state
    it ends in and the records that start in it, for both states before it,
    and whether its first line ends in a carriage return."""
    effects: dict[tuple[str, int], list] = {}
    for b in batches:
        for line, path, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            e = effects.setdefault((path, start), [False, 0, True, 0, line.endswith("\r")])
            blank = not line.rstrip("\r")
            for k, inside in ((0, e[0]), (2, e[2])):
                if not inside and not blank:
                    e[k + 1] += 1
                e[k] = open_after(line, inside)
    rows = [(*k, *v) for k, v in effects.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "start", "end_out", "n_out", "end_in", "n_in", "cr"])


def _split_records(batches: Iterator[pa.RecordBatch], before: dict) -> Iterator[pa.RecordBatch]:
    """(value, path, start) -> records, whole ones and the pieces of those that
    cross the edges of a split. ``before`` has for each split the state, the
    number of records and the kind of line end that come with it. Holds one
    batch and one record."""
    split: tuple | None = None
    inside = first = cr = False
    number = 0
    held: list[str] = []
    out: list[tuple] = []

    def flush(done: bool) -> None:
        """The record held; ``first`` says that its beginning is in an earlier split."""
        text = "\n".join(held)
        if held and (text or not done or first):
            out.append((split[0], number, split[1], done and not first, text))
        held.clear()

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "number", "piece", "whole", "text"])
        out.clear()
        return got

    for b in batches:
        for line, *place in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if split != tuple(place):
                if split is not None:
                    flush(False)
                split = tuple(place)
                inside, number, cr = before[split]
                first = inside
                number -= 1  # of the record that goes on
            if cr and line.endswith("\r"):
                line = line[:-1]
            if not inside and line:
                number += 1
            held.append(line)
            inside = open_after(line, inside)
            if not inside:
                flush(True)
                first = False
        yield batch()
    if split is not None:
        flush(False)
        yield batch()


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(number, text) of the records of CSV files, headers and empty lines left
    out; ``number`` is (rank of the file by path, row in the file).

    Two passes over the lines, each split on its own. Whether a line break is
    quoted depends on all lines before it, but what a split does to that is
    two cases: the state it ends in if it starts outside of a quoted field, and
    if inside. The first pass finds these and the records that start in the
    split; chained over the splits of a file (one short row each: 800,000 for
    100 TB) they tell where each split stands. The second pass puts the lines
    of a record together; only the pieces of records that cross the edge of a
    split are shuffled.

    Lines end with a newline, or with carriage return and newline if the first
    line of the file does; these become newlines inside quoted fields."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.regexp_replace("_metadata.file_path", SLASHES, "$1:/").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    effects = sorted(tuple(r) for r in lines.mapInArrow(_split_effects, EFFECTS).collect())
    before: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    files: list[str] = []
    for name, start, end_out, n_out, end_in, n_in, cr in effects:
        if name not in files[-1:]:
            files.append(name)
            inside, number, line_end = False, 0, cr
        before[name, start] = inside, number, line_end
        inside, number = (end_in, number + n_in) if inside else (end_out, number + n_out)
    known = spark.sparkContext.broadcast(before)
    pieces = lines.mapInArrow(lambda b: _split_records(b, known.value), PIECES)
    parts = pieces.where(~F.col("whole")).groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("p"))
    parts = parts.select("path", "number", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    rows = pieces.where("whole").select("path", "number", "text").union(parts).where("number > 0")  # 0 is the header
    order = spark.createDataFrame([(p, i) for i, p in enumerate(files)], "path string, rank long")
    joined = rows.join(F.broadcast(order), "path")  # one row per file
    return joined.select(F.shiftleft("rank", ROW_BITS).bitwiseOR(F.col("number") - 1).alias("number"), "text")
