"""Quality rules by compression bands.

The zstandard ratio (bytes / compressed bytes) of a whole document and of its
fixed chunks must lie within limits that depend on the length: above the upper
limit the text repeats itself, below the lower one it is noise (random
characters, encoded data). A document is rejected if its own ratio is outside
its band, or if more than a given share of its chunks are outside the chunk
band. Beside the ratios, plain counts give the base rules.

Defined results: null text counts as no words and is rejected by the base
rules; texts of any length are read whole; ties and repeated rows get equal
results; extra columns are ignored; an empty table gives no rows. Work is per
row; a task holds one Arrow batch and one document's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (from so many bytes, least ratio, greatest ratio); short texts carry the
#: frame's fixed bytes, so their ratios are lower.
BANDS = ((0, 0.0, 3.0), (128, 0.9, 3.2), (256, 1.1, 3.5), (512, 1.25, 4.0), (1024, 1.4, 4.5), (4096, 1.5, 5.0), (16384, 1.5, 6.0), (65536, 1.5, 8.0))
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    bands: tuple[tuple[int, float, float], ...] = BANDS
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = (1.4, 5.0)
    #: greatest share of chunks outside the chunk band
    bad_chunks: float = 0.3
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


def word_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of UTF-8
    text; ``bytes.split`` splits at the six ASCII white-space characters."""
    words = raw.split()
    packed = b"".join(words)
    chars = len(packed) if packed.isascii() else len(packed.decode())
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    v = len(code)
    if v < 1 << 20:
        three = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        _, two = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        three = two[:-1] * v + ids[2:]
    _, inverse, counts = np.unique(three, return_inverse=True, return_counts=True)
    again = counts[inverse] >= 2
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def band_verdict(raw: bytes, rules: Rules, pack: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(whole ratio, chunks, chunks outside their band, kept). A last short
    chunk is judged by the band of its own length."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(raw) / len(pack.compress(raw))
    _, low, high = max(b for b in rules.bands if b[0] <= len(raw))
    bad = n = 0
    if len(raw) > rules.chunk_bytes:
        for at in range(0, len(raw), rules.chunk_bytes):
            chunk = raw[at : at + rules.chunk_bytes]
            least, most = rules.chunk_band if len(chunk) == rules.chunk_bytes else max(b for b in rules.bands if b[0] <= len(chunk))[1:]
            n += 1
            bad += not least <= len(chunk) / len(pack.compress(chunk)) <= most
    return ratio, n, bad, low <= ratio <= high and bad <= rules.bad_chunks * n


def _judge(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=rules.level)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "n_chunks", "bad_chunks", "in_band"]
    types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        rows = []
        for text in batch.column(1):
            raw = (text.as_py() or "").encode()
            rows.append((*word_counts(raw), *band_verdict(raw, rules, pack)))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["key", *names])


def compression_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: key, counts, ratios, base_failed, kept."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(lambda b: _judge(b, rules), "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, bad_chunks long, in_band boolean")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))


def op4_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
