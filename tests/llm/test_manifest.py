"""Merkle manifest, SimHash classes and whitening against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from conftest_llm import by_key, duck_docs
from pyspark.sql import functions as F

from assetclean.llm import merkle, simhash, whitening

# --- Merkle manifest


def digest(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves: list[str], fanout: int) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def steps_of(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def brute_manifest(rows, fanout=2):
    """(doc_id, source, lang, n_chars, text) -> the contract's rows."""
    groups = by_key((r[2], r) for r in rows)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted((leaf_of(*r), r) for r in groups[g]) for g in order}
    for g in order:
        trees[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    levels = {g: levels_of([x[0] for x in trees[g]], fanout) for g in order}
    top = levels_of([levels[g][-1][0] for g in order], fanout)
    for k, g in enumerate(order):
        for i, (leaf, r) in enumerate(trees[g]):
            path = steps_of(levels[g], i, fanout) + steps_of(top, k, fanout)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf_of(*r[:3], r[3] + 1, r[4]) if changed else leaf
            for left, right in path:
                h = digest(left, h, right)
            yield (r[0], leaf, levels[g][-1][0], top[-1][0], digest(*(left + right for left, right in path)), h, h == top[-1][0])


def same(a, b):
    assert sorted(map(str, a)) == sorted(map(str, b))


def contract(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).collect()]


def test_merkle_odd_rows(spark, odd, duck, tmp_path):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = contract(spark, odd, tmp_path)
    same(got, brute_manifest(rows))
    same(got, duck(merkle.ORACLE, documents=duck_docs(odd)))


def test_merkle_given_table(spark, small):
    rows = [tuple(r) for r in small[0].select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in merkle.op11_merkle(spark, "/root/testdata/sf0.001").collect()]
    same(got, brute_manifest(rows))
    tampered = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r[0] for r in got if not r[-1]} == tampered and tampered


def test_merkle_large_group_repeats_and_one_leaf(spark, tmp_path):
    """Several strides, a third of all rows equal, a third with null keys, and
    groups of one leaf."""
    rows = [(i, f"t{i}", "en", "a", i) for i in range(700)] + [(None, f"n{i % 350}", "en", "a", None) for i in range(700)] + [(-1, "same", "en", "b", 4)] * 700
    rows += [(9000 + i, "alone", f"l{i}", None, 5) for i in range(5)] + [(9100, "", None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = contract(spark, docs, tmp_path)
    same(got, brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))


def test_merkle_one_group_one_row_and_none(spark, tmp_path):
    docs = spark.createDataFrame([(5, "only", "en", "a", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    same(contract(spark, docs, tmp_path), brute_manifest([(5, "a", "en", 4, "only")]))
    assert contract(spark, docs.limit(0), tmp_path) == []


def test_merkle_other_fanouts(spark):
    keys = [(f"={g}", i, digest(f"{g}{i}")) for g, n in (("x", 300), ("y", 17), ("z", 1)) for i in range(n)]
    rows = spark.createDataFrame(keys, "g string, key long, leaf string")
    for fanout in (3, 16):
        levels = {g: levels_of([k[2] for k in keys if k[0] == g], fanout) for g in ("=x", "=y", "=z")}
        top = levels_of([levels[g][-1][0] for g in sorted(levels)], fanout)
        for r in merkle.manifest(rows, fanout).collect():
            want = steps_of(levels[r["g"]], r["key"], fanout) + steps_of(top, sorted(levels).index(r["g"]), fanout)
            assert [tuple(s) for s in r["path"]] == want
            assert (r["subroot"], r["root"]) == (levels[r["g"]][-1][0], top[-1][0])


def test_merkle_positions_spread_a_repeated_row(spark, monkeypatch):
    written, cut = {}, merkle.cut
    monkeypatch.setattr(merkle, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    rows = spark.createDataFrame([("=a", 1, "h")] * 6000 + [("=a", i, "x") for i in range(3000)], "g string, key long, leaf string").repartition(4)
    placed, most = merkle.positions(rows, ["key", "leaf"])
    assert most == 9000 and sorted(r["pos"] for r in placed.select("pos").collect()) == list(range(9000))
    assert max(r["count"] for r in written["leaves"].groupBy(F.input_file_name()).count().collect()) < 5000


# --- SimHash


def brute_fingerprint(text) -> int:
    w = (text or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_classes(rows):
    prints = [(k, brute_fingerprint(t)) for k, t in rows]
    nodes = sorted({p for _, p in prints})
    part = {p: p for p in nodes}

    def root(p):
        while part[p] != p:
            p = part[p]
        return p

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                part[root(b)] = root(a)
    least = {}
    for k, p in prints:
        if k is not None:
            least[root(p)] = min(k, least.get(root(p), k))
    return [(k, f"{p:016x}", least.get(root(p))) for k, p in prints]


def classes(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in simhash.op12_simhash(spark, str(tmp_path)).collect()]


def test_simhash_odd_rows(spark, odd, none, tmp_path, monkeypatch):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    same(classes(spark, odd, tmp_path), brute_classes(rows))
    for _, text in rows:  # pieces end where they may
        monkeypatch.setattr(simhash, "PIECE", 37)
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)
    assert classes(spark, none, tmp_path) == []


def test_simhash_near_texts(spark, tmp_path):
    """Long texts with a few words changed: some link, some do not."""
    rng = random.Random(7)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(900)]
        for _ in range(25):
            w = list(words)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows += [(None, rows[0][1]), (None, "all alone here now"), (3, None), (2, ""), (4, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = classes(spark, docs, tmp_path)
    same(got, brute_classes(rows))
    prints = {r[1] for r in got}
    assert len({r[2] for r in got}) < len(prints) < len(rows)


def test_golay_code_decodes_every_word():
    unit, patterns = simhash.golay_tables()
    of = (patterns >= 0).sum(axis=1)
    assert sorted(set(of.tolist())) == [1, 6] and (of == 6).sum() == 1771  # the cosets of three errors
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    keys = simhash.indices(words, unit, patterns)
    # the codeword of an index: its 12 bits and the rest that makes the syndrome vanish
    book = np.arange(1 << 12) << simhash.CHECK_BITS
    book ^= [np.bitwise_xor.reduce(unit[[i for i in range(23) if x >> i & 1]], initial=0) for x in book.tolist()]
    for w, row in zip(words.tolist(), keys, strict=True):
        near = np.flatnonzero(np.bitwise_count(book ^ w) <= 4)
        assert sorted(row[row >= 0].tolist()) == near.tolist() or (row[1:] < 0).all() and row[0] in near


def test_fingerprints_within_three_bits_share_a_key():
    unit, patterns = simhash.golay_tables()
    rng = random.Random(3)
    for _ in range(3000):
        a = b = rng.getrandbits(64)
        for i in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << i
        keys = [set(simhash.bucket_keys(np.array([x], np.uint64).view(np.int64), unit, patterns)[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_simhash_links_of_full_keys(spark, monkeypatch):
    """Keys with more fingerprints than a run holds go by pairs of blocks."""
    rng = random.Random(5)
    base = rng.getrandbits(63)
    some = {base ^ sum(1 << i for i in rng.sample(range(30), rng.randrange(6))) for _ in range(900)} | {rng.getrandbits(63) for _ in range(200)}
    fps = spark.createDataFrame([(f,) for f in some], "fp long").repartition(3)

    def parts():
        part = {f: f for f in some}

        def root(p):
            while part[p] != p:
                p = part[p]
            return p

        for r in simhash.links(fps).collect():
            assert (r["a"] ^ r["b"]).bit_count() <= 3 and r["a"] != r["b"]
            part[root(r["a"])] = root(r["b"])
        return sorted(sorted(v) for v in by_key((root(f), f) for f in some).values())

    whole = parts()
    monkeypatch.setattr(simhash, "RUN", 16)
    assert parts() == whole
    nodes = sorted(some)
    linked = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 3]
    of = {f: k for k, p in enumerate(whole) for f in p}
    assert linked and all(of[a] == of[b] for a, b in linked)


# --- Whitening


def brute_whitening(rows, wanted=8):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    z = x * n - s
    c = z.astype(float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    return rows, n, (z * z).sum(axis=1), c, e, q


def vectors(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, key string, x string").repartition(3)
    df.write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return whitening.op13_whitening(spark, str(tmp_path)).collect()


def check_whitening(got, rows):
    rows, n, dev, c, e, q = brute_whitening(rows)
    out = {(r["vec_id"], r["component"]): r for r in got}
    assert len(out) == len(got) == len(rows) * len(e)
    for k in range(len(e)):
        y = c @ q[:, k] / np.sqrt(e[k])
        mine = np.array([out[i, k + 1]["whitened"] for i, _ in rows])
        assert np.abs(mine - np.sign(mine @ y) * y).max() < 1e-7
        assert all(out[i, k + 1]["deviation"] == v and out[i, k + 1]["n"] == n for (i, _), v in zip(rows, dev, strict=True))
        assert out[rows[0][0], k + 1]["explained"] == pytest.approx(e[k] / (np.square(c).sum() / n), rel=1e-9)
    assert got[0]["identity_error"] < 1e-6


def test_whitening_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((200, 12)) * np.geomspace(1, 0.05, 12)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base.tolist())]
    odd = [(1000, None), (1001, [None, *rows[0][1][1:]]), (1002, [float("nan"), *rows[0][1][1:]]), (1003, [float("inf"), *rows[0][1][1:]]), (1004, [float("-inf")] * 12)]
    got = vectors(spark, rows + odd, tmp_path)
    check_whitening(got, rows + odd)
    other = [(1005, []), (1006, rows[0][1][:3]), (1007, [1e30] * 12)]  # lengths and entries that have no place
    assert sorted(map(str, vectors(spark, rows + other, tmp_path)))[0][:8] == sorted(map(str, got))[0][:8]
    assert {r["vec_id"] for r in vectors(spark, rows + other, tmp_path)} == {i for i, _ in rows}


def test_whitening_low_rank_and_nothing(spark, tmp_path):
    rng = np.random.default_rng(2)
    plane = (rng.integers(-2000, 2000, (60, 3)) @ rng.integers(-3, 4, (3, 10))) / 1024
    got = vectors(spark, list(enumerate(plane.tolist())), tmp_path)
    assert {r["component"] for r in got} == {1, 2, 3} and got[0]["identity_error"] < 1e-9
    assert sum(r["explained"] for r in got if r["vec_id"] == 0) == pytest.approx(1)
    assert vectors(spark, [(1, [0.5] * 10)] * 4, tmp_path) == []  # repeated rows, no deviation
    assert vectors(spark, [(1, None)], tmp_path) == []


def test_whitening_equal_deviations(spark, tmp_path):
    """Directions of equal deviation: the Krylov space ends early and goes on
    in a fresh direction, so none is missed."""
    cross = [(2 * i + k, [(2 - 4 * k) * float(i == j) * (3 if i < 2 else 1) for j in range(10)]) for i in range(10) for k in range(2)]
    got = vectors(spark, cross, tmp_path)
    share = {r["component"]: r["explained"] for r in got}
    assert len(share) == 8 and got[0]["identity_error"] < 1e-9
    assert [round(share[k] / share[8]) for k in range(1, 9)] == [9, 9, 1, 1, 1, 1, 1, 1]


def test_whitening_deviation_beyond_a_long(spark, tmp_path):
    rows = [(i, [float(np.float32(v)) for v in (4e12 * i, 1.0 * i, 3.0)]) for i in range(4)] + [(9, [float(np.float32(6e12)), 1.5, 3.0])]
    got = vectors(spark, rows, tmp_path)
    dev = dict(zip([i for i, _ in rows], brute_whitening(rows)[2], strict=True))
    assert all(r["deviation"] == (dev[r["vec_id"]] if dev[r["vec_id"]] < 1 << 63 else None) for r in got)
    assert any(r["deviation"] is None for r in got)
