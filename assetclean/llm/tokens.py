"""Token ids in bit-plane shuffled blocks.

Texts are encoded in key order. Each task writes one run of ids (a shard) cut
into blocks of a fixed number of ids. A block is transposed: plane k holds
byte k (or bit k) of every id, and each plane is compressed with zstandard on
its own, so the almost constant high planes cost next to nothing. The file
rows are blocks with their index entry:

    shard, block         place of the block; first = its first id in the shard
    n_ids, width         ids in the block; planes: bytes (8) or bits (1) wide
    planes array<binary> compressed planes, lowest first; planes of zeros at
                         the top are left out
    docs                 documents that begin in the block: key, first id in
                         the shard, number of ids

The index columns can be read without the planes. Blocks are held in Parquet
files, written and committed by Spark, so lost executors leave no half files
and any store that Spark can write works.

Defined results: null text is empty; an empty text is the end id alone; a null
key comes first; rows of one key are ordered by a hash of their text, and may
lie in several shards; repeated rows are repeated documents; extra columns are ignored; an empty table writes no block.
One text, one block and the cache of words are all that a task holds.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

BLOCK = 1 << 15
END_ID = 1
#: Words that a Python worker remembers, twice; results don't depend on it.
CACHE_WORDS = 400_000
#: Latin letters that NFC and lower case leave one letter each, so that no mark
#: of theirs can join the stop after them; and digits
PLAIN = "0-9" + "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c) in ("Lu", "Ll") and len(unicodedata.normalize("NFC", c).lower()) == 1)
#: ASCII marks but the apostrophe, with which the model's own cuts may begin
MARKS = r"!-&(-/:-@\[-`{-~"
END_MARK = re.compile(rf"[{MARKS}](?<=[{PLAIN}].)[{MARKS}]*(?=[ \n]|$)")
LETTERS = re.compile(f"[{PLAIN[3:]}]+")

FORMAT = "shard int, block int, first long, n_ids int, width int, planes array<binary>, docs array<struct<key:long,first:long,n_ids:long>>"


def shuffle_block(ids: np.ndarray, width: int, level: int = 3) -> list[bytes]:
    """uint32 ids -> compressed planes, lowest first, without zero planes on
    top."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if width == 1:
        raw = np.packbits(_bits(raw), axis=1, bitorder="little")
    used = len(raw)
    while used and not raw[used - 1].any():
        used -= 1
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in raw[:used]]


def _bits(bytes_: np.ndarray) -> np.ndarray:
    """(4, n) bytes -> (32, n) bits, lowest first."""
    return ((bytes_[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1).reshape(32, -1)


def restore_block(planes: list[bytes], n_ids: int, width: int) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    size = n_ids if width == 8 else -(-n_ids // 8)
    rows = [np.frombuffer(unpack.decompress(p, max_output_size=size), np.uint8) for p in planes]
    if width == 1:
        bits = np.zeros((32, n_ids), np.uint8)
        for k, r in enumerate(rows):
            bits[k] = np.unpackbits(r, count=n_ids, bitorder="little")
        whole = (bits.reshape(4, 8, n_ids) << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    else:
        whole = np.zeros((4, n_ids), np.uint8)
        for k, r in enumerate(rows):
            whole[k] = r
    return np.ascontiguousarray(whole.T).reshape(-1).view("<u4")


def latin(text: str) -> bool:
    """Whether all characters are Latin-1, where case is plain."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Encodes with a tokenizers file that lowers case and never joins text
    across white space, or a letter with the marks at the end of a word: a
    text is cut there and the ids of each word are remembered. The words last
    met are kept in two generations of CACHE_WORDS."""

    def __init__(self, model: str):
        """``model`` is the text of the tokenizers file, not its path."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        vocab = self.model.get_vocab() if suffix else {}
        #: whether an id ends a piece of text that the model encodes on its own
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    @staticmethod
    def of_worker(model: str) -> WordEncoder:
        """The encoder of this Python worker, which outlives its tasks."""
        kept = sys.modules.setdefault("_assetclean_worker", types.ModuleType("_assetclean_worker")).__dict__
        if model not in kept:
            kept[model] = WordEncoder(model)
        return kept[model]

    def __call__(self, text: str) -> bytes:
        if "<|" not in text:  # such text may hold special tokens, which are not cut
            if latin(text):
                text = text.lower()  # as the model's own normalizer does
            text = END_MARK.sub(r" \g<0>", text)
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        ids = list(map(known.get, words))
        gaps = [k for k, i in enumerate(ids) if i is None]
        new = []
        for w in {words[k] for k in gaps}:
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        if new:
            letters = [w for w in new if LETTERS.fullmatch(w)]
            known.update(zip(letters, self.encode_letters(letters), strict=True))
            others = [w for w in new if w not in known]
            known.update(zip(others, self.encode_each(others), strict=True))
        for k in gaps:
            ids[k] = known[words[k]]
        return b"".join(ids)

    def encode_each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, encoded as one text. A word has at
        least one id that ends a piece, so if there are as many of these as
        words, they show where each word's ids end; otherwise one by one."""
        encoded = self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)  # fast: without offsets
        ids = np.array(encoded[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1) if len(ids) and ids.max() < len(self.ends) else ids[:0]
        if len(ends) != len(words) or not words or ends[-1] != 4 * len(ids):
            return self.encode_each(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[s:e] for s, e in zip([0, *ends], ends)]


def _encode(batches: Iterator[pa.RecordBatch], model: str, block: int, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = WordEncoder.of_worker(model), np.array([end_id], "<u4").tobytes()
    shard = TaskContext.get().partitionId()
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(pa.struct([("key", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64())])))])
    held, number, done, docs = bytearray(), 0, 0, []

    def flush(n: int) -> pa.RecordBatch:
        nonlocal number, done, docs
        planes = shuffle_block(np.frombuffer(bytes(held[: 4 * n]), "<u4"), width)
        starts = [d for d in docs if d["first"] < done + n]
        row = {"shard": shard, "block": number, "first": done, "n_ids": n, "width": width, "planes": planes, "docs": starts}
        docs = docs[len(starts) :]
        del held[: 4 * n]
        number, done = number + 1, done + n
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "") + end
            docs.append({"key": key, "first": done + len(held) // 4, "n_ids": len(ids) // 4})
            held += ids
            while len(held) >= 4 * block:
                yield flush(block)
    if held:
        yield flush(len(held) // 4)


def write_ids(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", block: int = BLOCK, width: int = 8, end_id: int = END_ID) -> None:
    """Encode all texts in ascending key order into blocks under ``path``. The
    tokenizers file, a few MB, is read by the driver and sent to the workers.
    Shards are ranges of (key, hash of the text, place in the input), so many
    rows of one key, equal ones too, are dealt over several shards."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("key", "h", "at").sortWithinPartitions("key", "h", "text").select("key", "text")
    ordered.mapInArrow(lambda b: _encode(b, model.value, block, width, end_id), FORMAT).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of (shard, block) -> one row per document."""
    names = ["key", "shard", "first", "n_tokens", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    open_: list = []  # documents that began and are not complete: key, shard, first, ids, ids still to come, crc
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for row in batch.to_pylist():
            ids = restore_block(row["planes"], row["n_ids"], row["width"])
            open_ += [[d["key"], row["shard"], d["first"], d["n_ids"], d["n_ids"], 0] for d in row["docs"]]
            at, closed = 0, 0
            for d in open_:
                if at >= len(ids):
                    break
                n = min(d[4], len(ids) - at)
                d[5] = zlib.crc32(ids[at : at + n].tobytes(), d[5])
                d[4] -= n
                at += n
                if d[4] == 0:
                    closed += 1
                    for column, value in zip(out, (*d[:4], d[5]), strict=True):
                        column.append(value)
            open_ = open_[closed:]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: key, start (ids of all documents
    before it), n_tokens, ids_crc32. A task streams through the blocks of its
    shards in order."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    rows = blocks.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(_documents, "key long, shard int, first long, n_tokens long, ids_crc32 long")
    # one row per shard, from the index columns alone
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(before, F.col("shard") == F.col("s")).select("key", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op1_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark) + "-ids"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path).withColumnRenamed("key", "doc_id")
