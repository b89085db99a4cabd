"""N-gram Jaccard join with set-relation skipping.

Documents are sets of distinct five-word shingles; two link when their Jaccard
similarity is at least 80 %. The join is exact and finds the connected
components of the links.

1. Shingles get a global order, rare first. It comes from a table of COUNTERS
   counts by hash; any order is exact, this one keeps common passages out of
   the prefixes.
2. Index lists: a set enters the list of each shingle of its prefix (the least
   n - ceil(0.8 n) + 1) with its size and the position. Lists with one set are
   dropped.
3. Answers of leaders: in a list sorted by size, the first set leads those
   that its size and position allow; each set is also tried with the one
   before it, and with some neighbours in an order by hash. Pairs whose parity
   sketches prove them too far apart go; each other pair is verified by exact
   overlap, and the links found join sets into groups.
4. Answers of members: a set that is linked to others takes over their
   answers, so only pairs of different groups are left. They are found in the
   lists by blocks of equal (size, position): blocks that cannot reach the
   overlap are skipped whole, and so are lists of a single group. What passes
   these and the sketches is verified by exact overlap, too; with it every
   link is found or lies inside a group.

``join_components`` ends there and gives no links, as components need no more.
``join_links`` gives every link: it tests and verifies all pairs of the lists.
Neither derives a set's overlaps from a similar set's by the elements in which
the two differ.

Equal sets are one node (by a 64-bit digest of the set), so copies are never
paired. Shingles are 64-bit hashes; exactness is up to collisions of these.

Defined results: A-Z is lowered; a text of fewer than five words is one
shingle, its word sequence; null or empty texts have no set, link with nothing
and are their own component; a component's id is the least non-null key in it;
rows that repeat a text are one node; extra columns are ignored; an empty
table gives no rows. Nothing is capped: the counters, the bitmap that
preselects sets and the caches are of fixed size and do not change results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import salted_join
from .common import WORD, cut, cut_at, packed, remove, short_batches, table

WORDS = 5
PERCENT = 80
COUNTER_BITS = 18
BITMAP_BITS = 24
#: each set of a list is tried with so many before it in an order by hash
NEIGHBOURS = 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WORD = np.ones(256, np.int8)
IS_WORD[list(SPACES)] = 0
BASE = 0x2545F4914F6CDD1D
BYTE_CODES = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)
POWERS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
SEGMENT = 1 << 20
SKETCH_BITS = 1024
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
OUT_ROWS = 1 << 18
PAIRS_AT_ONCE = 1 << 14
#: lists of so many rows at most are paired many at once
SHORT_LIST = 64
#: (node, part) rows that may be broadcast, some 50 bytes each
BROADCAST_ROWS = 1_000_000


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text: differences of a running sum
    of byte codes times powers of BASE, shifted back by the inverse power."""
    if len(raw) > SEGMENT:  # in parts that end at white space, so memory stays small
        parts, at = [], 0
        while at < len(raw):
            end = min(at + SEGMENT, len(raw))
            while end < len(raw) and raw[end] not in SPACES:
                end += 1
            if end - at > 2 * SEGMENT:  # one word longer than a part
                parts.append(np.array([xxhash.xxh64_intdigest(w) for w in raw[at:end].split()], np.uint64))
            else:
                parts.append(word_hashes_of(raw[at:end]))
            at = end
        return np.concatenate(parts)
    return word_hashes_of(raw)


def word_hashes_of(raw: bytes) -> np.ndarray:
    codes = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = IS_WORD[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(BYTE_CODES[codes] * power[: len(codes)], out=total[1:])
    return spread((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, n at least."""
    if len(POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            POWERS[k] = np.cumprod(factors)
    return POWERS[0], POWERS[1]


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64); empty without words."""
    raw = (text or "").encode().translate(LOWER)
    w = word_hashes(raw) if raw else np.zeros(0, np.uint64)
    n = len(w)
    if n < WORDS:
        return spread((w * MULTIPLIERS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else w
    h = w[: n - 4] * MULTIPLIERS[0]
    for k in range(1, WORDS):
        h = h + w[k : n - 4 + k] * MULTIPLIERS[k]
    h = np.sort(spread(h))  # several times as fast as np.unique
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def parity(s: np.ndarray) -> bytes:
    """For each of SKETCH_BITS slots whether the set has an odd number of
    hashes there. Two sets differ in at least as many elements as their
    parities differ in bits."""
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def most_apart(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most elements in which linked sets of these sizes can differ."""
    return na + nb - 2 * needed(na, nb)


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def pack_set(s: np.ndarray) -> bytes:
    """A sorted set as byte planes of its differences, compressed: the high
    planes are nearly empty."""
    return zstandard.compress(np.diff(s, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_set(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _new(node: int, seen: set[int]) -> bool:
    """Whether this task has not had the node yet (or has forgotten it)."""
    if node in seen:
        return False
    if len(seen) > 1_000_000:
        seen.clear()
    seen.add(node)
    return True


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, node, n, parity) for each row (the parity once a
    task and node), and at the end of the task its counters (slot, count) with
    node null."""
    seen: set[int] = set()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    names = ["key", "node", "n", "parity", "slot", "count"]
    for b in batches:
        nodes, sizes, slots, parities, held = [], [], [], [], 0
        for text in b.column(1):
            s = shingle_set(text.as_py())
            nodes.append(digest(s) if len(s) else None)
            sizes.append(len(s))
            parities.append(None)
            if len(s) and _new(nodes[-1], seen):
                parities[-1] = parity(s)
                slots.append((s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
                held += len(s)
            if held >= OUT_ROWS:
                counts += np.bincount(np.concatenate(slots), minlength=len(counts))
                slots, held = [], 0
        if slots:
            counts += np.bincount(np.concatenate(slots), minlength=len(counts))
        none = pa.nulls(len(nodes), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), none, none], names)
    full = np.flatnonzero(counts)
    none = pa.nulls(len(full), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(full), pa.binary()), pa.array(full), pa.array(counts[full])], names)


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """text -> (token, node, size, pos): the prefix of each set."""
    seen: set[int] = set()
    tokens, rows, held = [], [], 0
    names = ["token", "node", "size", "pos"]

    def out() -> pa.RecordBatch:
        nodes, sizes, lengths = (np.array(x) for x in zip(*rows, strict=True))
        pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        return pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), pa.array(np.repeat(nodes.astype(np.int64), lengths)), pa.array(np.repeat(sizes.astype(np.int32), lengths)), pa.array(pos)], names)

    for b in batches:
        for text in b.column(0):
            s = shingle_set(text.as_py())
            n = len(s)
            if not n or not _new(node := digest(s), seen):
                continue
            p = n - -(-PERCENT * n // 100) + 1
            first = s[np.lexsort((s, counts[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))[:p]]
            tokens.append(first)
            rows.append((node, n, p))
            held += p
            if held >= OUT_ROWS:
                yield out()
                tokens, rows, held = [], [], 0
    if rows:
        yield out()


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def may_link(na, i, nb, j):
    """Size and position filters for sets whose first common shingle is at
    positions i and j."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * small >= PERCENT * large) & (1 + np.minimum(na - i - 1, nb - j - 1) >= needed(na, nb))


def _may_link(na: Column, i: Column, nb: Column, j: Column) -> Column:
    """:func:`may_link` for columns."""
    close = 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)
    return close & ((100 + PERCENT) * F.least(na - i, nb - j) >= PERCENT * (na + nb))


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, size, node) -> those whose list has several sets,
    each with the set that leads it (null for leaders) and the one before it
    (null if the two can't link here). Holds one batch and the last row of the
    one before."""
    names = ["token", "node", "size", "pos", "leader", "before"]
    waiting: tuple | None = None  # last row, not yet given out
    began = False  # whether its list had a row before it
    leader: tuple | None = None  # of the current list
    before: tuple | None = None  # the row before the waiting one

    def partners(token: int, node: int, size: int, pos: int) -> tuple[int | None, int | None]:
        nonlocal leader, before
        led = next_to = None
        if before is not None and before[0] == token and _leads(before, size, pos):
            next_to = before[1]
        if leader is not None and leader[0] == token and _leads(leader, size, pos):
            led = leader[1]
        else:
            leader = (token, node, size, pos)
        before = (token, node, size, pos)
        return led, next_to

    for b in batches:
        c = [b.column(i).to_numpy() for i in range(4)]
        if waiting is not None:
            c = [np.concatenate(([w], x)).astype(x.dtype) for w, x in zip(waiting, c, strict=True)]
        if not len(c[0]):
            continue
        keep = np.ones(len(c[0]), bool)
        keep[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])  # a node that several tasks gave
        c = [x[keep] for x in c]
        same = c[0][1:] == c[0][:-1]
        shared = np.zeros(len(c[0]), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= began
        waiting, began = tuple(x[-1] for x in c), bool(same[-1]) if len(same) else began
        rows = np.flatnonzero(shared[:-1])
        if len(rows):
            out = [partners(*r) for r in zip(*(x[rows].tolist() for x in c), strict=True)]
            lead = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in c), *lead], names)
    if waiting is not None and began:
        row = tuple(int(x) for x in waiting)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*row, *partners(*row)), types, strict=True)], names)


def _leads(leader: tuple, size: int, pos: int) -> bool:
    _, _, n, i = leader
    return 100 * n >= PERCENT * size and 1 + min(n - i - 1, size - pos - 1) >= -(-PERCENT * (n + size) // (100 + PERCENT))


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, node, size, pos, part, parity) sorted by token -> pairs of
    nodes of different parts that may link by size, position and parity. All
    pairs of many short lists are tried at once; longer lists go by blocks.
    Holds one batch and the rows of one list."""
    held: list[list[np.ndarray]] = []
    found: list[np.ndarray] = []
    n_found = 0

    def out(least: int = 1) -> Iterator[pa.RecordBatch]:
        nonlocal n_found
        if n_found >= least or len(found) >= 2048:
            p = np.unique(np.concatenate(found, axis=1), axis=1)
            found.clear()
            n_found = 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in p], ["a", "b"])

    def keep(c: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of rows x, y that pass what the list knows of them."""
        nonlocal n_found
        _, node, size, pos, part, bits = c
        ok = (part[x] != part[y]) & may_link(size[x], pos[x], size[y], pos[y])
        x, y = x[ok], y[ok]
        ok = near(bits[x], bits[y], size[x], size[y])
        x, y = node[x[ok]], node[y[ok]]
        if len(x):
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            n_found += len(x)

    def short(c: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each row of the short lists with the later ones of its list."""
        few = np.repeat(ends - starts <= SHORT_LIST, ends - starts)
        after = np.where(few, np.repeat(ends, ends - starts) - np.arange(len(few)) - 1, 0)
        upto = np.cumsum(after)
        at = 0
        while at < len(few):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            n = after[at:end]
            x = np.repeat(np.arange(at, end), n)
            keep(c, x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n))
            yield from out(OUT_ROWS)
            at = end

    def blocks(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((c[3], c[2]))
        c = [x[order] for x in c]
        _, _, size, pos, _, _ = c
        first = np.flatnonzero(np.concatenate(([True], (size[1:] != size[:-1]) | (pos[1:] != pos[:-1]))))
        ends = np.append(first[1:], len(order))
        of = np.repeat(np.arange(len(first)), ends - first)
        for k, (at, end) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
            reach = may_link(size[first[k:]], pos[first[k:]], size[at], pos[at])  # whole blocks are skipped
            y = at + np.flatnonzero(reach[of[at:] - k])
            for x in range(at, end):
                for part in range(0, len(y), PAIRS_AT_ONCE):
                    z = y[part : part + PAIRS_AT_ONCE]
                    z = z[z > x]
                    keep(c, np.full(len(z), x), z)
                    yield from out(OUT_ROWS)

    def work(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], c[0][1:] != c[0][:-1])))
        ends = np.append(starts[1:], len(c[0]))
        yield from short(c, starts, ends)
        long = ends - starts > SHORT_LIST
        for s, e in zip(starts[long], ends[long], strict=True):
            yield from blocks([x[s:e] for x in c])
        yield from out()

    for b in batches:
        c = [b.column(i).to_numpy().astype(np.int64) for i in range(5)] + [parities(b.column(5))]
        if held:
            c = [np.concatenate((h, x)) for h, x in zip(held.pop(), c, strict=True)]
        if not len(c[0]):
            continue
        last = np.flatnonzero(c[0] != c[0][-1])
        at = last[-1] + 1 if len(last) else 0  # the last list may go on
        if at:
            yield from work([x[:at] for x in c])
        held.append([x[at:] for x in c])
    if held and len(held[0][0]):
        yield from work(held.pop())


def parities(column: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def near(p: np.ndarray, q: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets with these parities and sizes may link."""
    return np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= most_apart(na, nb)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, parity_a, parity_b) -> (a, b) that may link."""
    for b in batches:
        na, nb = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
        ok = near(parities(b.column(4)), parities(b.column(5)), na, nb) if len(na) else np.zeros(0, bool)
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """text -> (node, set) of the nodes that the bitmap may hold."""
    seen: set[int] = set()
    nodes, sets, held = [], [], 0
    for b in batches:
        for text in b.column(0):
            s = shingle_set(text.as_py())
            if not len(s):
                continue
            node = digest(s)
            slot = bitmap_slot(node)
            if (int(bitmap[slot >> 6]) >> (slot & 63)) & 1 and _new(node, seen):
                nodes.append(node)
                sets.append(pack_set(s))
                held += len(s)
                if held >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])
                    nodes, sets, held = [], [], 0
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])


def bitmap_slot(node: int) -> int:
    return (node >> 20) & ((1 << BITMAP_BITS) - 1)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) -> the pairs that link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = unpack_set(x.as_py()), unpack_set(y.as_py())
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verified(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The linked pairs (a, b) among candidates (a, b)."""
    sets, path = sets_of(docs, pairs, name)
    links = linked(pairs, sets, name)
    remove(docs.sparkSession, path)
    return links


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def sets_of(docs: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The sets of the nodes of candidates, and some others, as written under
    the path: built again from the texts; a bitmap of fixed size (2 MB) keeps
    most others out."""
    spark = docs.sparkSession
    nodes = ends_of(pairs)
    slot = F.shiftright("node", 20).bitwiseAND((1 << BITMAP_BITS) - 1)
    words = nodes.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)
    with short_batches(spark):
        return cut_at(docs.select("text").mapInArrow(lambda b: _sets(b, shared.value), "node long, set binary"), f"{name}-sets")


def linked(pairs: DataFrame, built: DataFrame, name: str) -> DataFrame:
    """Those of the pairs that link, by exact overlap of the sets built."""
    # an equal set may come from several tasks: any of them will do
    sets = built.join(ends_of(pairs), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))
    one = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    with short_batches(pairs.sparkSession):
        return cut(both.mapInArrow(_overlaps, "a long, b long"), f"{name}-links")


def spanning_links(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Pairs with the components that all links among candidates (a, b), a < b,
    have: first each node with the least that it is paired with is verified,
    then the pairs whose ends these links leave apart. So of a group of near
    copies some sets travel, not one for each pair."""
    sets, path = sets_of(docs, pairs, name)
    one = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), f"{name}-one")
    links = linked(one, sets, f"{name}-one")
    parts = components(links)
    of_a = parts.select(F.col("node").alias("n_a"), F.col("part").alias("part_a"))
    of_b = parts.select(F.col("node").alias("n_b"), F.col("part").alias("part_b"))
    rest = pairs.join(one, ["a", "b"], "left_anti").join(of_a, F.col("a") == F.col("n_a"), "left").join(of_b, F.col("b") == F.col("n_b"), "left")
    rest = rest.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
    links = stars(parts).union(linked(cut(rest, f"{name}-rest"), sets, f"{name}-rest"))
    remove(docs.sparkSession, path)
    return links


def stars(parts: DataFrame) -> DataFrame:
    """The components (node, part) as pairs, in the place of the links that
    they come from: with new links, fewer rounds are left to go."""
    return parts.filter(F.col("node") != F.col("part")).select(F.col("part").alias("a"), F.col("node").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, part) for every node with a link; part is the least node of its
    component. Alternating large and small stars: every round hooks the
    neighbours of a node to the least of them; sums of few numbers tell when
    nothing changes."""
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = cut_at(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        least = least.select("x", F.least("x", "m").alias("m"))
        # large star: greater neighbours hook to the least neighbour
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lesser neighbours hook to the least
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()
        (edges, path), last = cut_at(small, "edges"), path
        remove(edges.sparkSession, last)
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).union(edges.select(F.col("v"), F.col("v"))).distinct()
        state = now


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def index_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows (key, text), (key, node, n) for each document, (node, parity, n)
    for each node, and the index lists that hold several sets."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    with short_batches(spark):
        first = cut(rows.mapInArrow(_nodes, "key long, node long, n long, parity binary, slot long, count long"), "nodes")
    nodes = first.filter(F.col("slot").isNull()).select("key", "node", "n")
    sketch = first.filter(F.col("parity").isNotNull()).groupBy("node").agg(F.first("parity").alias("parity"), F.first("n").alias("n"))
    counters = first.filter(F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("count").alias("count")).toPandas()  # 2^18 at most
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[counters["slot"].to_numpy(np.int64)] = counters["count"].to_numpy(np.int64)
    order = spark.sparkContext.broadcast(counts)
    index = rows.select("text").mapInArrow(lambda b: _prefixes(b, order.value), "token long, node long, size int, pos int")
    lists = index.repartition("token").sortWithinPartitions("token", "size", "node")
    lists = cut(lists.mapInArrow(_shared_lists, "token long, node long, size int, pos int, leader long, before long"), "lists")
    return rows, nodes, sketch, lists


def join_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, node, n) for each document, and every link (a, b), a < b, between
    different nodes, those inside a component included. Rows of one node are
    copies. The number of links grows with the square of a group's size."""
    rows, nodes, sketch, lists = index_lists(docs, key, text)
    # with each node a part of its own no pair is left out
    every = lists.join(sketch.select("node", "parity"), "node").select("token", "node", "size", "pos", F.col("node").alias("part"), "parity")
    pairs = every.repartition("token").sortWithinPartitions("token").mapInArrow(_open_pairs, "a long, b long").distinct()
    return nodes, verified(rows, cut(pairs, "pairs"), "links")


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, node, n) for each document, and (node, part) for the nodes that
    have a link."""
    rows, nodes, sketch, lists = index_lists(docs, key, text)
    by_hash = Window.partitionBy("token").orderBy(F.xxhash64("node"), "node")
    other = [F.lag(F.struct("node", "size", "pos"), k).over(by_hash) for k in range(1, NEIGHBOURS + 1)]
    near_by = [F.when(_may_link(F.col("size"), F.col("pos"), F.col(f"o{k}.size"), F.col(f"o{k}.pos")), F.col(f"o{k}.node")) for k in range(NEIGHBOURS)]
    led = lists.withColumns({f"o{k}": o for k, o in enumerate(other)})
    led = led.select(F.explode(F.array("leader", "before", *near_by)).alias("a"), F.col("node").alias("b")).filter(F.col("a").isNotNull())
    led = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a = sketch.select(F.col("node").alias("a"), F.col("parity").alias("parity_a"), F.col("n").alias("na"))
    b = sketch.select(F.col("node").alias("b"), F.col("parity").alias("parity_b"), F.col("n").alias("nb"))
    led = led.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "parity_a", "parity_b")
    links = spanning_links(rows, cut(led.mapInArrow(_near_pairs, "a long, b long"), "led"), "led")
    parts = components(links)
    of = Window.partitionBy("token")
    mixed = lists.join(parts.withColumnRenamed("node", "p_node"), F.col("node") == F.col("p_node"), "left").select("token", "node", "size", "pos", F.coalesce("part", "node").alias("part"))
    mixed = mixed.withColumns({"least": F.min("part").over(of), "most": F.max("part").over(of)}).filter("least < most")
    mixed = mixed.join(sketch.select("node", "parity"), "node").select("token", "node", "size", "pos", "part", "parity")
    left = mixed.repartition("token").sortWithinPartitions("token").mapInArrow(_open_pairs, "a long, b long").distinct()
    links = stars(parts).union(verified(rows, cut(left, "open"), "open"))
    return nodes, cut(components(links), "parts")


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest, text) -> (key, digest, node)."""
    for b in batches:
        nodes = [digest(shingle_set(t.as_py())) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64())], ["key", "digest", "node"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of least key (null
    last), then of least MD5 of the text; of rows equal in both any one. Rows
    without words all stay.

    Only key, digest and text go through Python, and only (key, digest) of
    each component's row are chosen from; whole rows are met once, by a salted
    join with these."""
    _, parts = join_components(docs, key, text)
    parts = parts.withColumnRenamed("node", "p_node")
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    named = F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull(), F.md5(F.col(text))
    words = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    some = docs.filter(words)
    narrow = some.select(F.col(key).alias("key"), F.md5(F.col(text)).alias("digest"), F.col(text).alias("text"))
    schema = T.StructType([*narrow.schema.fields[:2], T.StructField("node", T.LongType())])
    equal = narrow.mapInArrow(_with_node, schema).groupBy("node", "key", "digest").agg(F.count("*").alias("m"))
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest", "m")).alias("w")
    chosen = equal.join(parts, F.col("node") == F.col("p_node"), "left").groupBy(F.coalesce("part", "node").alias("part")).agg(least)
    with short_batches(docs.sparkSession):
        chosen = cut(chosen.select(F.coalesce(F.col("w.key").cast("string"), F.lit("")).alias("k"), F.col("w.none").alias("none"), F.col("w.digest").alias("digest"), F.col("w.m").alias("m")), "chosen")
    rows = some.select(packed(docs), *[c.alias(n) for c, n in zip(named, ("k", "none", "digest"), strict=True)])
    kept = salted_join(rows, chosen, ["k", "none", "digest"])
    repeated = kept.filter("m > 1").groupBy("k", "none", "digest").agg(F.first("row").alias("row"))
    return kept.filter("m = 1").select("row.*").union(repeated.select("row.*")).union(docs.filter(~words))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, parts = join_components(table(spark, sf_dir, "documents"))
    rows = nodes.join(parts.withColumnRenamed("node", "p_node"), F.col("node") == F.col("p_node"), "left").select("key", "n", "node", F.coalesce("part", "node").alias("part"))
    least = rows.filter(F.col("part").isNotNull()).groupBy(F.col("part").alias("l_part")).agg(F.min("key").alias("least"))
    return rows.join(least, F.col("part") == F.col("l_part"), "left").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("part").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


#: All pairs of documents that share a shingle, then the least reachable id.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
