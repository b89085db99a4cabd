"""Search, sort, page and export of an enriched table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGE_SIZE = 15
# The columns the search box looks at, by exact name.
SEARCH_COLUMNS = ("manufacturer", "model", "serial number", "manufactured_date", "device_type")


def search_condition(df: DataFrame, term: str):
    """P6 predicate: case-insensitive substring match over the search columns
    (OR). A blank term matches every row; the term itself is not trimmed, and
    ``%`` or ``_`` are literal characters."""
    if not term.strip():
        return F.lit(True)
    t = term.lower()
    cond = F.lit(False)
    for c in SEARCH_COLUMNS:
        if c in df.columns:
            cond = cond | F.coalesce(F.lower(F.col(f"`{c}`")).contains(F.lit(t)), F.lit(False))
    return cond


def search_rows(df: DataFrame, term: str) -> DataFrame:
    """Rows matching :func:`search_condition`."""
    return df.where(search_condition(df, term))


def sort_key(c: str):
    return F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))


def sort_rows(df: DataFrame, key: str | None, direction: str = "asc", order_col: str = "_ord") -> DataFrame:
    """O3: sort by the lower-cased text of one column (missing -> ''), stable:
    ties keep input order in both directions."""
    if not key:
        return df.orderBy(order_col)
    k = sort_key(key)
    return df.orderBy(k.desc() if direction == "desc" else k.asc(), F.col(order_col).asc())


def page(df: DataFrame, number: int, key: str | None = None, direction: str = "asc", size: int = PAGE_SIZE, order_col: str = "_ord") -> DataFrame:
    """One page (1-based) of the sorted view. Spark runs this as a
    per-partition top-(offset+size) followed by one merge, not a full sort."""
    return sort_rows(df, key, direction, order_col).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("pages"))


INDEX = "_range long, before long, n long"


class PageIndex:
    """A sorted view stored in key ranges, one folder each, with the place of
    every row in its range, and an index of (range, rows before, rows). A page
    reads the one or two ranges it lies in, and of these the row groups with
    its places, however deep it is."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, size: int = PAGE_SIZE):
        """``schema``: of the stored rows, ``_range`` and ``_place`` included."""
        self.rows, self.index, self.size = spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.schema(INDEX).parquet(f"{path}/index"), size

    def page_count(self) -> DataFrame:
        return self.index.agg(F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / self.size).cast("long").alias("pages"))

    def page(self, number: int) -> DataFrame:
        """One page (1-based); beyond the last one, no rows."""
        first = (number - 1) * self.size
        last = first + self.size
        met = self.index.where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).collect()  # as many ranges as a page has rows, at most
        of = [(F.col("_range") == r["_range"]) & F.col("_place").between(first - r["before"], last - r["before"] - 1) for r in met]
        rows = self.rows.where(F.col("_range").isin([r["_range"] for r in met]) & reduce(lambda a, b: a | b, of, F.lit(False)))
        return rows.orderBy("_range", "_place").drop("_range", "_place")


def index_pages(df: DataFrame, path: str, key: str | None = None, direction: str = "asc", size: int = PAGE_SIZE, order_col: str = "_ord") -> PageIndex:
    """O4/W8 for many pages: sort once (as :func:`sort_rows`), in as many
    ranges as shuffle partitions, under ``path``. Rows of equal text are told
    apart by ``order_col``, so a common value is spread over ranges too."""
    spark = df.sparkSession
    k = sort_key(key) if key else F.lit("")
    keys = [k.desc() if direction == "desc" else k.asc(), F.col(order_col).asc()]
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    # after the sort this id is (partition, place in it)
    at = ranged.withColumn("_at", F.monotonically_increasing_id())
    placed = at.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")
    placed.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    counts = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")  # one row per range
    counts.select("_range", before.alias("before"), "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return PageIndex(spark, path, placed.schema, size)


def export_lines(df: DataFrame, order_col: str = "_ord") -> DataFrame:
    """S9 as ``pos, line``: a bare header, then every cell as a JSON string
    (quoted, quotes and backslashes escaped, a newline as the two characters
    ``\\n``), blanks as ``""``. Rows keep the order of ``order_col``."""
    cols = [c for c in df.columns if c != order_col]

    def cell(c: str):
        text = F.to_json(F.array(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))))
        return text.substr(F.lit(2), F.length(text) - 2)

    body = df.select(F.struct(F.lit(1).alias("s"), F.col(order_col).alias("o")).alias("pos"), F.concat_ws(",", *[cell(c) for c in cols]).alias("line"))
    kind = df.schema[order_col].dataType
    head = df.sparkSession.range(1).select(F.struct(F.lit(0).alias("s"), F.lit(None).cast(kind).alias("o")).alias("pos"), F.lit(",".join(cols)).alias("line"))
    return head.unionByName(body)


def export_csv(df: DataFrame, path: str, order_col: str = "_ord") -> None:
    """S9 to a text sink; the range-partitioned sort keeps part files in order."""
    export_lines(df, order_col).orderBy("pos").select("line").write.mode("overwrite").text(path)
