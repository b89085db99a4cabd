"""Mixing, chat formatting, sharding, decontamination: DataFrame operators."""

import hashlib
import zlib

import pytest
from conftest_llm import by_key, duck_docs

from assetclean.llm import chat, contamination, mix, shard
from assetclean.llm.common import table


def test_mix_matches_sorted_sums_on_odd_rows(spark, odd, duck):
    rows, d = mix.plan_mix(odd)
    got = rows.join(d.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(mix.F.col("s")))
    got = got.select(mix.F.col("key"), "size", "source_size", "target", (mix.repeats(mix.F.col("h")) * mix.F.col("size")).alias("taken"))
    want = duck(mix.ORACLE, documents=duck_docs(odd))
    rounded = lambda rows: sorted(str((*r[:3], round(r[3], 6), r[4])) for r in rows)
    assert rounded(got.collect()) == rounded(want)


def test_mix_targets_and_repeats(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    rows, d = mix.plan_mix(docs)
    per = {r["source"]: r for r in d.collect()}
    total = sum(r["source_size"] for r in per.values())
    assert sum(r["target"] for r in per.values()) == pytest.approx(1.5 * total)
    assert all(r["target"] <= 2 * r["source_size"] + 1e-6 for r in per.values())
    out = mix.mix(docs).groupBy("source").agg(mix.F.sum(mix.word_count(mix.F.col("text"))).alias("n")).collect()
    for r in out:
        assert abs(r["n"] - per[r["source"]]["target"]) <= 50  # the longest document
    again = mix.mix(docs.repartition(7)).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mix.mix(docs).groupBy("doc_id").count().collect()))


def test_mix_meets_targets_with_null_and_repeated_keys(spark):
    rows = [(i, f"t{i} " + "w " * (i % 50), "ab"[i % 2]) for i in range(1000)] + [(None, f"n{i} " + "w " * (i % 50), "ab"[i % 2]) for i in range(600)]
    rows += [(-1, f"r{i} " + "w " * (i % 50), "ab"[i % 2]) for i in range(600)] + [(-2, "the same words " * 10, "b")] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {r["source"]: r["target"] for r in mix.plan_mix(docs)[1].collect()}
    out = mix.mix(docs)
    for r in out.groupBy("source").agg(mix.F.sum(mix.word_count(mix.F.col("text"))).alias("n")).collect():
        assert abs(r["n"] - want[r["source"]]) <= 51
    times = lambda df: sorted(tuple(r) for r in df.groupBy("text").count().collect())
    assert times(out) == times(mix.mix(docs.repartition(7)))
    assert 0 < out.filter("doc_id is null").select("text").distinct().count()


def test_op2_meets_targets_with_a_third_of_null_keys(spark, duck, monkeypatch):
    monkeypatch.setattr(mix, "REPEATS", 100)  # equal rows beyond that are dealt in pieces
    rows = [(i, f"t{i} " + "w " * (i % 50), "ab"[i % 2]) for i in range(1000)] + [(None, f"n{i} " + "w " * (i % 50), "ab"[i % 2]) for i in range(1000)]
    rows += [(-2, "the same words " * 10, "b")] * 705 + [(-3, None, "a"), (-3, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    narrow, d = mix.plan_mix(docs)
    got = narrow.join(d.withColumnRenamed("source", "s"), narrow["source"].eqNullSafe(mix.F.col("s"))).select(mix.F.col("key"), "size", "source_size", "target", (mix.repeats(mix.F.col("h")) * mix.F.col("size")).alias("taken")).collect()
    assert len(got) == len(rows)
    for s in "ab":
        mine = [r for r in got if r["source_size"] == {"a": sum(len((t or "").split()) for _, t, x in rows if x == "a"), "b": sum(len((t or "").split()) for _, t, x in rows if x == "b")}[s]]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 51
    rounded = lambda rows: sorted(str((*r[:3], round(r[3], 6), r[4])) for r in rows)
    assert rounded(got) == rounded(duck(mix.ORACLE, documents=duck_docs(docs.selectExpr("*", "'x' as lang", "0 as n_chars"))))


def test_mix_keeps_columns_and_empty(odd, none):
    assert mix.mix(odd).columns == odd.columns
    assert mix.mix(none).count() == 0


def test_chat_round_trip_and_masks(spark):
    tricky = ["\\", "<turn:user>\n", "</turn>\n", "a\\<b", "\\### Assistant: </turn> ok", "", None, "\n\n", "é\U0001f600"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(tricky)]
    rows += [(2, 0, "user", "only a question"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (3, None, None, "first"), (None, 0, "assistant", "n"), (4, 1, "odd>role<\\", "t")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.expand(df.drop("formatted")), chat.tail(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_examples_have_all_turns_before(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(6)], "conv_id long, turn long, role string, text string")
    ex = sorted(chat.expand(df).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in ex] == [1, 3, 5]
    for r in ex:
        p = r["position"]
        assert r["formatted"] == "".join(f"<turn:{'assistant' if i % 2 else 'user'}>\nt{i}</turn>\n" for i in range(p + 1))
        assert r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]] == f"t{p}"
    assert chat.expand(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 97, 400])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(shard.permuted(shard.F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))


def test_shards_rows_law(spark, odd, none, small):
    for df, docs in ((small[0], small[1]), (odd, [tuple(r)[:5] for r in odd.collect()])):
        rows = shard.shard_rows(df).collect()
        assert len(rows) == len(docs)
        assert sorted(r["position"] for r in rows) == list(range(len(rows))) == sorted(r["number"] for r in rows)
        per = by_key((r["shard"], r["slot"]) for r in rows)
        sizes = [len(v) for v in per.values()]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values())
        want = sorted((len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
        assert sorted((r["size"], r["crc"]) for r in rows) == want
    again = {r["key"]: r["position"] for r in shard.shard_rows(small[0].repartition(5)).collect()}
    assert again == {r["key"]: r["position"] for r in shard.shard_rows(small[0]).collect()}
    assert shard.shard_rows(none).count() == 0
    assert [c for c in shard.shard_rows(odd).select("row.*").columns] == odd.columns


def test_containment_matches_all_shingles(spark, odd, none, duck):
    prose = odd.filter("doc_id = 1").first()["text"]
    long = odd.filter("doc_id = 7").first()["text"].split()
    items = [(0, " ".join(long[30_000:30_020])), (1, prose.upper()), (2, "kleine Wörter"), (3, "drei kleine Wörter"), (4, None), (5, ""), (6, " ".join(long[100:105])), (7, " ".join(long[200:240]) + " nothing of this"), (7, "x"), (None, "the same words the same words")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination.contained(odd, b).collect()), key=str)
    want = set()
    for d, t in ((r["doc_id"], r["text"]) for r in odd.collect()):
        for i, q in items:
            ds, qs = shingles(t), shingles(q)
            if qs and 100 * len(ds & qs) >= 80 * len(qs):
                want.add((d, i, len(ds & qs), len(qs)))
    assert got == sorted(want, key=str)
    assert {r["doc_id"] for r in contamination.clean(odd, b).select("doc_id").collect()}.isdisjoint(w[0] for w in want if w[0] is not None)
    assert contamination.clean(odd, b).columns == odd.columns
    assert contamination.contained(none, b).count() == 0 and contamination.clean(odd, b.limit(0)).count() == odd.count()


def test_clean_decides_for_each_row(spark):
    leak, fine = "here it comes one two three four five six seven eight nine", "a clean document of some more than five words"
    docs = spark.createDataFrame([(None, leak), (None, fine), (1, leak), (1, fine), (1, fine), (2, None), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(0, "one two three four five six seven eight nine")], "item_id long, text string")
    assert sorted(map(str, map(tuple, contamination.clean(docs, b).collect()))) == sorted(map(str, [(None, fine), (1, fine), (1, fine), (2, None), (None, None)]))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_short_items_are_found_inside_documents(spark, odd, none, monkeypatch, most):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", most)
    prose = odd.filter("doc_id = 1").first()["text"]
    items = [(1, "Brown FOX"), (2, "kleine"), (3, "drei kleine Wörter"), (4, None), (5, " "), (6, "watch from a distant"), (7, "fox brown"), (8, prose), (8, "dogs"), (None, "same words"), (9, "w7919"), (9, "no such words here at all")]
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    want, lower = set(), lambda t: " ".join((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().decode("latin1").split())
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for d, t in rows:
        for i, q in items:
            if 0 < len(lower(q).split()) < 5:
                if f" {lower(q)} " in f" {lower(t)} ":
                    want.add((d, i, 1, 1))
            elif (qs := shingles(q)) and 100 * len(shingles(t) & qs) >= 80 * len(qs):
                want.add((d, i, len(shingles(t) & qs), len(qs)))
    got = sorted((tuple(r) for r in contamination.contained(odd, b, inside=True).collect()), key=str)
    assert got == sorted(want, key=str) and {1, 2, 3, 6, 8, None} <= {i for _, i, *_ in got}
    assert contamination.contained(none, b, inside=True).count() == 0
    one = spark.createDataFrame([(1, "kleine")], "item_id long, text string")
    assert sorted(str(r["text"]) for r in contamination.clean(odd, one).collect()) == sorted(str(t) for _, t in rows if t != "drei kleine Wörter")


def test_containment_beyond_the_broadcast_bound(spark, small, monkeypatch):
    b = table(spark, "/root/testdata/sf0.001", "benchmark")
    want = sorted(map(tuple, contamination.contained(small[0], b).collect()))
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, contamination.contained(small[0], b).collect())) == want and want


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({b" ".join(words)} if words else set())


@pytest.mark.parametrize("name", ["op3_chat", "op5_feistel", "op8_contamination"])
def test_no_python_on_native_paths(spark, name):
    from assetclean.llm.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "ArrowEval", "MapInArrow", "CartesianProduct"))
