"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has the 64 bits that are set in over half of the
XXH64 hashes (seed 42) of its three-word shingles, repeats included. Documents
link when their fingerprints differ in three bits or fewer; the operator finds
the connected components of all links, exactly.

The fingerprint is cut into segments of 23, 23 and 18 bits, read as words of
the perfect Golay code of length 23. A word is at most 3 bits from one codeword,
its nearest; words exactly 3 bits off have 5 more codewords at 4 bits. So a
segment decodes to one or six codeword indices, and of two segments that differ
in one bit or none, the nearest codeword of one is always among the indices of
the other. Pigeonhole over three errors in three segments: either a segment
agrees exactly and another differs by one bit at most, or each differs in
exactly one. The first case gives keys (exact segment, indices of another), the
second keys of three indices, where the sides take turns in giving one index
or all. Fingerprints that share a key are verified by their distance.

Equal fingerprints are one node, so copies are never paired. The nodes of a
key give a spanning forest of their links, not all pairs; keys with more than
RUN nodes are cut into blocks of RUN, and every two blocks meet in a task of
their own. Component ids return to the documents by a salted join.

Defined results: A-Z is lowered; fewer than three words are one shingle; null
or empty texts have fingerprint zero and link like any other; a component's id
is the least non-null key in it; texts are hashed whole, in pieces of bounded
size; repeated rows are kept; only key and text are read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from .common import cut, table
from .set_join import LOWER, SPACES, components

WORDS = 3
SEED = 42
DISTANCE = 3
#: first bit and width of each segment
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: generator polynomial of the Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1
GENERATOR = 0b110001110101
CHECK_BITS = 11
CODE_BITS = 12
PIECE = 1 << 20
#: nodes of one key that are compared in one go
RUN = 4096


def shingle_hashes(raw: bytes) -> Iterator[np.ndarray]:
    """Hashes of the shingles of lowered UTF-8 text, in pieces."""
    carry: list[bytes] = []
    at, some = 0, False
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in SPACES:
            end += 1
        words = carry + raw[at:end].split()
        at = end
        if len(words) >= WORDS:
            some = True
            line = b" ".join(words)
            start = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=start[1:])
            slices = map(line.__getitem__, map(slice, start[: -WORDS].tolist(), (start[WORDS:] - 1).tolist()))
            yield np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), np.uint64, len(words) - WORDS + 1)
        carry = words[1 - WORDS :]
    if carry and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit number."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes((text or "").encode().translate(LOWER)):
        for k in range(0, len(h), 1 << 16):
            part = h[k : k + (1 << 16)].astype("<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], ["key", "fp"])


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each bit, and for each syndrome the error patterns of up to
    four bits that lead to a codeword, fewest bits first, -1 where none."""

    def remainder(x: int) -> int:
        for i in range(22, CHECK_BITS - 1, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - CHECK_BITS)
        return x

    unit = np.array([remainder(1 << i) for i in range(23)], np.int64)
    patterns = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    used = [0] * len(patterns)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(unit[list(bits)])) if bits else 0
            if weight < 4 or used[s] and int(patterns[s, 0]).bit_count() == 3:
                patterns[s, used[s]] = sum(1 << i for i in bits)
                used[s] += 1
    return unit, patterns


def indices(words: np.ndarray, unit: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices within four bits of 23-bit words, the nearest
    first, -1 where there is none."""
    s = np.zeros(len(words), np.int64)
    for i, u in enumerate(unit):
        s ^= np.where(words >> i & 1, u, 0)
    p = patterns[s]
    return np.where(p >= 0, (words[:, None] ^ p) >> CHECK_BITS, -1)


def bucket_keys(fp: np.ndarray, unit: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) for all keys of the fingerprints (int64 arrays)."""
    bits = fp.view(np.uint64)
    exact = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [indices(x, unit, patterns) for x in exact]
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def add(tag: int, *parts: tuple[np.ndarray, int]) -> None:
        key, ok = np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        for part, width in parts:
            ok &= part >= 0
            key = key << width | np.maximum(part, 0)
        out.append((key[ok] | (tag << 40), fp[ok]))

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                tag += 1
                for c in range(6):
                    add(tag, (exact[i], 23), (near[j][:, c], CODE_BITS))
    first = [x[:, 0] for x in near]
    for c in range(6):
        add(0, (first[0], CODE_BITS), (near[1][:, c], CODE_BITS), (first[2], CODE_BITS))
    for a in range(6):
        for b in range(6):
            if a or b:  # (0, 0) is a key of the other side's turn
                add(0, (near[0][:, a], CODE_BITS), (first[1], CODE_BITS), (near[2][:, b], CODE_BITS))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit, patterns = golay_tables()
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in bucket_keys(fps[k : k + 8192].copy(), unit, patterns)], ["key", "fp"])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which signed fingerprints differ."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, edges = fps, []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            parent = np.zeros(len(left), np.int64)
            hit = np.zeros(len(left), bool)
            for f in frontier:
                new = ~hit & (apart(left, f) <= DISTANCE)
                parent[new] = f
                hit |= new
            edges.extend(zip(parent[hit].tolist(), left[hit].tolist(), strict=True))
            frontier, left = left[hit], left[~hit]
    return edges


FOUND = "a long, b long, key long, block int"


def _found(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(edges, np.int64).reshape(-1, 2)
    ends = np.unique(np.sort(ends, axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy()), pa.nulls(len(ends), pa.int64()), pa.nulls(len(ends), pa.int32())], ["a", "b", "key", "block"])


def _blocks(fps: np.ndarray, key: int, block: int) -> pa.RecordBatch:
    n = len(fps)
    return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), pa.array(np.full(n, block, np.int32))], ["a", "b", "key", "block"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) sorted -> links (a, b) among the fingerprints of a key. A key
    with more than RUN of them comes out in blocks instead: (a, key, block).
    Holds one batch and RUN fingerprints."""
    key = np.zeros(0, np.int64)
    fp = np.zeros(0, np.int64)
    blocks = 0  # of the key that goes on, already given out

    def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole keys; the first may be the rest of one given out in blocks."""
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.append(start[1:], len(key))
        edges: list[tuple[int, int]] = []
        size = end - start
        two = start[size == 2]
        linked = two[apart(fp[two], fp[two + 1]) <= DISTANCE]
        edges.extend(zip(fp[linked].tolist(), fp[linked + 1].tolist(), strict=True))
        for s, e in zip(start[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            if e - s <= RUN:
                edges.extend(forest(fp[s:e]))
            else:
                for k, at in enumerate(range(s, e, RUN)):
                    yield _blocks(fp[at : min(at + RUN, e)], int(key[s]), k)
            if len(edges) > 1 << 16:
                yield _found(edges)
                edges = []
        if edges:
            yield _found(edges)

    for b in batches:
        key = np.concatenate((key, b.column(0).to_numpy()))
        fp = np.concatenate((fp, b.column(1).to_numpy()))
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp = key[fresh], fp[fresh]
        if blocks and key[0] != key[-1]:  # the key given out in blocks ends here
            last = int(np.flatnonzero(key != key[0])[0])
            yield _blocks(fp[:last], int(key[0]), blocks)
            key, fp, blocks = key[last:], fp[last:], 0
        at = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        yield from done(key[:at], fp[:at])
        key, fp = key[at:], fp[at:]
        while len(key) > RUN:  # keeps at least one row, so the key stays known
            yield _blocks(fp[:RUN], int(key[0]), blocks)
            key, fp, blocks = key[RUN:], fp[RUN:], blocks + 1
    if blocks:
        yield _blocks(fp, int(key[0]), blocks)
    else:
        yield from done(key, fp)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, p, q, fp) sorted by (key, p, q): two blocks of a key at a time."""
    held = np.zeros((4, 0), np.int64)
    for b in batches:
        held = np.concatenate((held, np.stack([c.to_numpy().astype(np.int64) for c in b.columns])), axis=1)
        if held.shape[1]:
            other = np.flatnonzero((held[:3] != held[:3, -1:]).any(axis=0))
            at = int(other[-1]) + 1 if len(other) else 0
            yield from _pairs_of(held[:, :at])
            held = held[:, at:]
    yield from _pairs_of(held)


def _pairs_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    change = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
    for part in np.split(rows[3], change):
        edges = forest(np.unique(part))
        if edges:
            yield _found(edges)


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect the same
    components as all pairs within DISTANCE bits."""
    keys = fps.select("fp").mapInArrow(_keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = cut(keys.mapInArrow(_runs, FOUND), "found")
    near = found.filter("b is not null").select("a", "b")
    large = found.filter("b is null")
    blocks = cut(large.select("key", "block").distinct(), "blocks")  # a RUN-th of the rows
    if blocks.isEmpty():
        return near
    pairs = blocks.alias("x").join(blocks.alias("y"), "key").select("key", F.col("x.block").alias("block"), F.least("x.block", "y.block").alias("p"), F.greatest("x.block", "y.block").alias("q")).distinct()
    rows = large.join(pairs, ["key", "block"]).select("key", "p", "q", F.col("a").alias("fp"))
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return near.union(cut(rows.mapInArrow(_block_pairs, FOUND), "block-links").select("a", "b"))


def simhash_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component) for each document."""
    rows = cut(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_fingerprints, "key long, fp long"), "fingerprints")
    fps = cut(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    parts = cut(components(links(fps)), "parts")  # only of fingerprints that have a link
    linked = parts.join(fps.withColumnRenamed("fp", "node"), "node")
    ids = cut(linked.groupBy("part").agg(F.min("least").alias("component")), "ids")
    linked = cut(salted_join(parts, ids, ["part"]).select("node", "component"), "linked")
    of = fps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
    return salted_join(rows, of, ["fp"])


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_classes(table(spark, sf_dir, "documents"))
    return d.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
