"""Language-model scoring by cross-entropy difference.

Two n-gram models of tokens are estimated from the whole corpus: one of the
target documents, one of all documents as background. They are matched: one
vocabulary, one order, one smoothing, and background counts scaled to the
target's size. A document's score is its mean loss per token (bits) under the
target model minus that under the background model; the lower it is, the more
the document is like the target.

Tokens are lower-case runs of letters and digits, single other characters, and
single characters of scripts that are written without spaces. Every token of
the corpus is in the vocabulary; the first token of a text follows a begin mark.
p(w | h) = (count(h w) + PRIOR * p(w)) / (count(h) + PRIOR), and p(w) =
(count(w) + PRIOR / size of the vocabulary) / (count of tokens + PRIOR).

The models are never joined with the documents. Texts are read once and written
as chunks of CHUNK tokens. Each chunk asks for the counts of its different
words, histories and pairs: sorted 64-bit keys with the chunk's own counts, cut
into buckets by key range. The task of a bucket adds the counts of equal keys
and answers each chunk in the order it asked, so an answer needs no keys and
takes about a byte a gram. A chunk then scores its documents from its answers.
What a bucket holds grows with the input, as do all counts. However frequent a
word or pair is, a chunk names it once, so no key is hot. A bucket holds some
BUCKET grams. A question row holds about CHUNK / buckets grams: beyond 10^11
tokens raise ``chunk`` with the memory of a task (60 bytes a token).

Tokens and grams are 64-bit hashes; counts are exact up to collisions of these.

Defined results: null text or text of white space alone has 0 tokens and null
losses; a key that is null or not among the target's is background alone; a
target without text makes both models uniform, and all scores 0; repeated rows
count as often as they occur and get equal scores; a text of many chunks is
scored in pieces that are summed; extra columns are ignored; empty tables give
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from .common import cut, table

PRIOR = 20.0
#: tokens of a chunk; a text is read in pieces of as many characters
CHUNK = 1 << 20
#: grams of a bucket, before equal ones are added
BUCKET = 1 << 21
LEAST_BUCKETS = 64
#: scripts without spaces: Thai to Myanmar, Khmer, CJK and kana
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W_{UNSPACED}]+|\S")
SPACE = re.compile(r"\s")
#: target keys are broadcast up to so many (16 MB), and joined beyond
BROADCAST_KEYS = 1_000_000
ENCODED = "chunk long, ids array<long>, keys array<long>, target array<boolean>, sizes array<long>, vocabulary binary, codes binary, tokens long, mine long"
ASKED = "chunk long, bucket long, grams binary, target binary, every binary"
ANSWERED = "chunk long, bucket long, target binary, every binary, words long"
SCORED = "id long, key long, n_tokens long, target_sum double, background_sum double"


class Hashes(dict):
    """64-bit hashes of tokens, remembered; 0 is the begin mark."""

    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) or 1
        return h


def pieces(text: str, known: Hashes, chunk: int) -> Iterator[np.ndarray]:
    """Hashes of a text's tokens, some ``chunk`` characters up to white space
    at a time; one empty piece for a text without tokens."""
    at, any_yet = 0, False
    while at < len(text):
        space = SPACE.search(text, at + chunk)
        end = space.end() if space else len(text)
        found = TOKEN.findall(text[at:end].lower())
        if len(known) > 1_000_000:
            known.clear()
        if found:
            any_yet = True
            yield np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        at = end
    if not any_yet:
        yield np.zeros(0, np.uint64)


def pack(values: np.ndarray) -> bytes:
    """An integer array as byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def _row(at: int, held: list[tuple]) -> pa.RecordBatch:
    """The row of a chunk: held (id, key, target, token before, tokens)."""
    ids, keys, target, before, tokens = zip(*held, strict=True)
    sizes = [len(w) for w in tokens]
    vocabulary, codes = np.unique(np.concatenate((np.array(before, np.uint64), *tokens)), return_inverse=True)
    mine = sum(n for n, t in zip(sizes, target, strict=True) if t)
    columns = [[at], [ids], [keys], [target], [sizes], [pack_sorted(vocabulary)], [pack(codes.astype(np.uint32))], [sum(sizes)], [mine]]
    lists = {1: pa.list_(pa.int64()), 2: pa.list_(pa.int64()), 3: pa.list_(pa.bool_()), 4: pa.list_(pa.int64()), 5: pa.binary(), 6: pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, lists.get(i, pa.int64())) for i, c in enumerate(columns)], [c.split()[0] for c in ENCODED.split(", ")])


def _encode(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """(key, target, text) -> the chunks of a task."""
    known, held, size = Hashes(), [], 0
    at = doc = TaskContext.get().partitionId() << 33
    for b in batches:
        for key, target, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
            key, target, before = key.as_py(), target.as_py(), 0
            for w in pieces(text.as_py() or "", known, chunk):
                held.append((doc, key, target, before, w))
                size += len(w) + 16
                if size >= chunk:
                    yield _row(at, held)
                    at, held, size = at + 1, [], 0
                if len(w):
                    before = w[-1]
            doc += 1
    if held:
        yield _row(at, held)


class Grams:
    """The different words, histories and pairs of a chunk, as sorted keys: odd
    ones for words, even ones for histories and pairs."""

    def __init__(self, row: dict) -> None:
        self.sizes = np.array(row["sizes"], np.int64)
        docs = len(self.sizes)
        vocabulary = unpack_sorted(row["vocabulary"])
        codes = unpack(row["codes"], np.uint32).astype(np.int64)
        before, self.w = codes[:docs], codes[docs:]
        self.h = np.concatenate((codes[:1], self.w[:-1])) if len(self.w) else self.w
        some = self.sizes > 0
        self.h[(np.cumsum(self.sizes) - self.sizes)[some]] = before[some]
        self.n = n = len(vocabulary)
        pairs, self.of = np.unique(self.h * n + self.w, return_inverse=True)
        self.first, self.second = pairs // n, pairs % n
        turned = (vocabulary << np.uint64(17)) | (vocabulary >> np.uint64(47))
        even = ~np.uint64(1)
        history = vocabulary * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        keys = np.concatenate((vocabulary | np.uint64(1), history & even, (vocabulary[self.first] ^ turned[self.second]) & even))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, weights: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs in the chunk, in order of the keys."""
        each = (np.bincount(self.w, weights, self.n), np.bincount(self.h, weights, self.n), np.bincount(self.of, weights, len(self.first)))
        return np.concatenate(each).astype(np.uint64)[self.order]

    def parts(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals in order of the keys, for words, histories and pairs."""
        back = np.empty(len(totals))
        back[self.order] = totals
        return back[: self.n], back[self.n : 2 * self.n], back[2 * self.n :]


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Chunks -> a row for each bucket that some keys of a chunk lie in."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    for b in batches:
        for row in b.to_pylist():
            g = Grams(row)
            if not len(g.w):
                continue
            mine, every = g.counts(np.repeat(np.array(row["target"], np.float64), g.sizes)), g.counts()
            bucket = np.searchsorted(bounds, g.keys, side="right")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            out = [[], [], [], [], []]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for column, v in zip(out, (row["chunk"], int(bucket[lo]), pack_sorted(g.keys[lo:hi]), pack(mine[lo:hi]), pack(every[lo:hi])), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(out)], [c.split()[0] for c in ASKED.split(", ")])


def _answer(asked: pa.Table) -> pa.Table:
    """The rows of a bucket -> the totals of each row's keys, in its order, and
    (once) the number of different words."""
    keys = [unpack_sorted(k) for k in asked["grams"].to_pylist()]
    different, of = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    totals = [np.bincount(of, np.concatenate([unpack(x, np.uint64) for x in asked[c].to_pylist()]), len(different)).astype(np.uint64) for c in ("target", "every")]
    words = int(np.count_nonzero((different & np.uint64(1) == 1) & (totals[1] > 0)))
    packed = [pa.array([pack(x) for x in np.split(t[of], ends)], pa.binary()) for t in totals]
    return pa.table([asked["chunk"], asked["bucket"], *packed, pa.array([words] + [0] * (len(keys) - 1), pa.int64())], ["chunk", "bucket", "target", "every", "words"])


def _score(chunk: pa.Table, answers: pa.Table, tokens: int, mine: int, words: int) -> pa.Table:
    """A chunk and its answers -> the sums of losses of its documents."""
    if not chunk.num_rows:
        return pa.table({c.split()[0]: pa.array([], pa.int64() if c.endswith("long") else pa.float64()) for c in SCORED.split(", ")})
    row, answers = chunk.to_pylist()[0], answers.sort_by("bucket")
    g, sums = Grams(row), []
    of = np.repeat(np.arange(len(g.sizes)), g.sizes)
    for side, scale in (("target", 1.0), ("every", mine / max(tokens, 1))):
        if not len(g.w):
            sums.append(np.zeros(len(g.sizes)))
            continue
        word, before, pair = g.parts(np.concatenate([unpack(x, np.uint64) for x in answers[side].to_pylist()]) * scale)
        p = (word + PRIOR / max(words, 1)) / (mine + PRIOR)
        loss = -np.log2((pair + PRIOR * p[g.second]) / (before[g.first] + PRIOR))
        sums.append(np.bincount(of, loss[g.of], len(g.sizes)))
    return pa.table([pa.array(row["ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(g.sizes), *map(pa.array, sums)], [c.split()[0] for c in SCORED.split(", ")])


def score_rows(rows: DataFrame, chunk: int = 0, bucket: int = 0) -> DataFrame:
    """rows (key, target boolean, text) -> key, n_tokens, target_loss,
    background_loss, score."""
    chunk, bucket = chunk or CHUNK, bucket or BUCKET
    encoded = cut(rows.select("key", "target", "text").mapInArrow(lambda b: _encode(b, chunk), ENCODED), "chunks")
    total = encoded.agg(F.sum("tokens").alias("tokens"), F.sum("mine").alias("mine")).first()
    tokens, mine = total["tokens"] or 0, total["mine"] or 0
    buckets = max(LEAST_BUCKETS, -(-tokens // bucket))
    asked = encoded.mapInArrow(lambda b: _ask(b, buckets), ASKED)
    answers = cut(asked.groupBy("bucket").applyInArrow(_answer, ANSWERED), "answers")
    words = answers.agg(F.sum("words")).first()[0] or 0
    both = encoded.groupBy("chunk").cogroup(answers.drop("words").groupBy("chunk"))
    done = both.applyInArrow(lambda left, right: _score(left, right, tokens, mine, words), SCORED)
    sums = done.groupBy("id").agg(F.max("key").alias("key"), *[F.sum(c).alias(c) for c in ("n_tokens", "target_sum", "background_sum")])
    some = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    means = sums.select("key", "n_tokens", (F.col("target_sum") / some).alias("target_loss"), (F.col("background_sum") / some).alias("background_loss"))
    return means.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def score(docs: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = 0) -> DataFrame:
    """key, n_tokens, target_loss, background_loss, score for every document;
    ``target_keys`` holds the target's keys in its first column."""
    wanted = target_keys.select(F.col(target_keys.columns[0]).cast("long").alias("key")).filter("key is not null").distinct().withColumn("_target", F.lit(True))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    if wanted.count() <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(wanted), "key", "left")
    else:
        marked = salted_join(rows, wanted, ["key"], "left")
    return score_rows(marked.select("key", F.coalesce("_target", F.lit(False)).alias("target"), "text"), chunk)


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return score(table(spark, sf_dir, "documents"), good).withColumnRenamed("key", "doc_id")
