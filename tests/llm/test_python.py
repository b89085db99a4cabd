"""Token blocks, compression bands, language models, language ID, HTML, Jaccard join."""

import math
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import duck_docs

from assetclean.llm import compression, html_text, language, lm_score, set_join, tokens
from assetclean.llm.common import cut, shared_dir, short_batches

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("width", [1, 8])
@pytest.mark.parametrize("n", [1, 7, 8, 9, 5000])
def test_planes_round_trip(width, n):
    for ids in (np.random.default_rng(n).integers(0, 2**32, n, dtype="u4"), np.zeros(n, "u4"), np.full(n, 49407, "u4")):
        planes = tokens.shuffle_block(ids, width)
        assert (tokens.restore_block(planes, n, width) == ids).all()
    assert len(tokens.shuffle_block(np.full(n, 49407, "u4"), 8)) == 2


@pytest.mark.parametrize("width", [1, 8])
def test_token_files(spark, odd, none, width):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = shared_dir(spark)
    tokens.write_ids(odd, path, P.path("word_bpe_49k.json"), block=1000, width=width)
    got = sorted(((r["start"], r["key"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_documents(spark, path).collect()))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] or "", r["doc_id"]) for r in odd.select("doc_id", "text", language.F.xxhash64("text").alias("h")).collect()))
    start, want = 0, []
    for *_, text, key in rows:
        ids = model.encode(text, add_special_tokens=False).ids + [1]
        want.append((start, key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    path = shared_dir(spark)
    tokens.write_ids(none, path, P.path("word_bpe_49k.json"))
    assert tokens.read_documents(spark, path).count() == 0


@pytest.mark.parametrize("text", ["It's Ünïcode,  ok.", "a.b,c . , !. don't, 'S. İstanbul ΣΑΣ. 3.5, x²,", "<|endoftext|>, <|ENDOFTEXT|>.", "é.́ á, \xa0b c\x85d", "tabs\tand\nlines,\n.", ""])
def test_word_cache_equals_the_tokenizer(text):
    e = tokens.WordEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    want = np.array(e.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert e(text) == want == e(text)


def test_every_letter_before_a_stop_equals_the_tokenizer():
    e = tokens.WordEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = [f"a{c}. b{c}, {c}." for c in map(chr, range(0x110000)) if c.isalnum()]
    assert len(texts) > 100_000
    plain = e.model.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, p in zip(texts, plain, strict=True) if e(t) != np.array(p.ids, "<u4").tobytes()] == []


def test_new_words_of_letters_are_encoded_as_one_text(monkeypatch):
    e = tokens.WordEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    noise = random.Random(3)
    words = ["".join(noise.choices("abcdeéñß", k=noise.randint(1, 12))) + noise.choice(["", "", ".", "!!", ",$$$", "=<"]) for _ in range(500)]
    text = " ".join(words)
    want = np.array(e.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    alone = []
    each = e.encode_each
    monkeypatch.setattr(e, "encode_each", lambda w: alone.extend(w) or each(w))
    assert e(text) == want
    assert not any(w[0].isalpha() for w in alone)  # marks alone: words of letters are not sent one by one
    monkeypatch.setattr(e, "ends", np.zeros_like(e.ends))  # a model that does not show the ends of words
    e.known, e.older = {"": b""}, {}
    assert e(text) == want and len(alone) > 300


def test_words_are_encoded_without_offsets_and_looked_up_once():
    class Fast:
        def __init__(self, model):
            self.encode_batch_fast = model.encode_batch_fast

    class Known(dict):
        asked = 0

        def get(self, word):
            Known.asked += 1
            return dict.get(self, word)

        def __getitem__(self, word):
            Known.asked += 1
            return dict.__getitem__(self, word)

    e = tokens.WordEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    text = "one two two, three. " * 100 + "four"
    want = np.array(e.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    e.model = Fast(e.model)
    assert e(text) == want
    e.known = Known(e.known)
    assert e(text + " five") == want + np.array(e.model.encode_batch_fast(["five"], add_special_tokens=False)[0].ids, "<u4").tobytes()
    assert Known.asked == 602 + 1  # each word and mark once, the new one twice


def test_marks_after_words_equal_the_tokenizer():
    e = tokens.WordEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    parts = ["a", "B", "é", "İ", "ß", "e\u0301", "\u0338", " ", "\n", "\t", "\xa0", ".", "!", "=", "<", "|", "_", "`", "[", "'s", "'", "1", "²", "<|endoftext|>", "漢", "Σ"]
    noise = random.Random(4)
    for _ in range(20_000):
        text = "".join(noise.choices(parts, k=noise.randint(1, 16)))
        assert e(text) == np.array(e.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_one_key_is_dealt_over_all_shards(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5, id)) as doc_id", "if(id % 3 = 0, 'the same', concat('t', id)) as text")
    path = shared_dir(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # no merging of the small partitions
        tokens.write_ids(rows.repartition(8), path, P.path("word_bpe_49k.json"), block=500)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = sorted(tokens.read_documents(spark, path).collect(), key=lambda r: r["start"])
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 6000 and len(sizes) >= 7 and max(sizes.values()) < 1500
    keys = [-1 if r["key"] is None else r["key"] for r in got]
    assert keys == sorted(keys) and [r["start"] for r in got[1:]] == list(np.cumsum([r["n_tokens"] for r in got])[:-1])


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(three)
    inside = {j for i, w in enumerate(three) if many[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_compression_counts_and_verdicts(spark, odd, none, small):
    noise = random.Random(1)
    clean = " ".join("".join(noise.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(noise.randint(1, 4))) for _ in range(900))
    hexed = " ".join("%032x" % noise.getrandbits(128) for _ in range(400))
    half = clean[:4000] + " again and again we say it" * 600
    extra = spark.createDataFrame([(101, clean), (102, hexed), (103, half), (104, "word " * 400)], "doc_id long, text string")
    df = odd.select("doc_id", "text").union(small[0].select("doc_id", "text")).union(extra)
    got = compression.compression_rules(df).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(brute_counts(r["text"]) for r in df.collect())
    kept = {r["key"]: r["kept"] for r in got}
    assert kept[101] and not kept[103] and not kept[104]
    assert all(not r["kept"] for r in got if not r["n_words"])
    random_bytes = "".join(chr(33 + noise.randrange(0x2000)) for _ in range(4000))
    rules = compression.Rules()
    pack = compression.zstandard.ZstdCompressor(level=3)
    assert not compression.band_verdict(random_bytes.encode(), rules, pack)[3]
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert compression.compression_rules(none).count() == 0


@pytest.mark.parametrize("chunk, bucket, keys_held", [(1 << 20, 1 << 21, 1_000_000), (1000, 50, 0), (700, 1 << 21, 1_000_000)])
def test_cross_entropy_learns_every_word(spark, odd, none, monkeypatch, chunk, bucket, keys_held):
    monkeypatch.setattr(lm_score, "CHUNK", chunk)
    monkeypatch.setattr(lm_score, "BUCKET", bucket)
    monkeypatch.setattr(lm_score, "BROADCAST_KEYS", keys_held)
    rare = [(50, "да нет это кот и дом, кот и дом"), (51, "кот и дом"), (52, "сто рыб без мор"), (53, "猫と家"), (54, "犬と山"), (50, "7 [x] 7")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rare, "doc_id long, text string")).repartition(3)
    keys = spark.createDataFrame([(1,), (9,), (50,), (50,), (53,), (None,), (77,)], "doc_id long")
    docs = [(r["doc_id"], re.findall(r"[ก-໿\u2e80-\u9fff]|[^\W_\u2e80-\u9fff]+|\S", (r["text"] or "").lower())) for r in df.collect()]
    pairs = [(k, list(zip(["", *w], w))) for k, w in docs]
    count = [Counter(), Counter()]
    for k, p in pairs:
        for i in range(2):
            if i or k in (1, 9, 50, 53):
                for h, w in p:
                    count[i].update([(h, w), ("w", w, 1), ("h", h, 1), "all"])
    size, scale = sum(len(x) == 3 and x[0] == "w" for x in count[1] if x != "all"), count[0]["all"] / count[1]["all"]

    def bits(i, h, w):
        c = lambda x: count[i][x] * (scale if i else 1)
        p = (c(("w", w, 1)) + lm_score.PRIOR / size) / (c("all") + lm_score.PRIOR)
        return -math.log2((c((h, w)) + lm_score.PRIOR * p) / (c(("h", h, 1)) + lm_score.PRIOR))

    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0))
    want = order((k, len(p), *(sum(bits(i, *x) for x in p) / len(p) if p else None for i in range(2))) for k, p in pairs)
    rows = lm_score.score(df, keys).collect()
    for a, b in zip(order(tuple(r)[:4] for r in rows), want, strict=True):
        assert a[:2] == b[:2] and (a[2:] == b[2:] or a[2:] == pytest.approx(b[2:]))
    got = {r["doc_id" if "doc_id" in r else "key"]: r["score"] for r in rows}
    assert got[51] < got[52] and got[53] < got[54]  # told apart by words of scripts that are rare here
    assert lm_score.score(df, keys.limit(0)).filter("score <> 0").count() == 0 == lm_score.score(none, keys).count()


def test_languages_of_large_alphabets_are_told_apart(spark):
    rng = random.Random(11)
    letters = {"x": range(0x4E00, 0x4E00 + 1500), "y": range(0x6000, 0x6000 + 1500), "z": range(0x430, 0x450)}
    words = {n: ["".join(chr(rng.choice(a)) for _ in range(rng.randint(1, 4))) for _ in range(700)] for n, a in letters.items()}
    words["en"] = ["".join(rng.choice(["th", "er", "on", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(700)]
    rows = [(i * 4 + k, n, " ".join(rng.choices(words[n], k=60))) for i in range(120) for k, n in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train_model(df, usable=language.F.col("doc_id") < 320)
    assert len(model.step) <= 4 * 2 * 64 * (200 * 302 + 2)
    got = language.predict(df.filter("doc_id >= 320"), model).collect()
    assert len(got) == 160 and sum(r["lang"] == r["_lang_pred"] for r in got) >= 0.95 * 160
    upper = language.classify([t.upper() for _, n, t in rows if n == "z"][:5], model)
    assert upper[0] == ["z"] * 5


def test_a_model_travels_small(spark, monkeypatch):
    rng = random.Random(12)
    texts = {n: [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(60)) for _ in range(40)] for n in "xy"}
    model = language.fit(texts)
    sizes = []
    kind = type(spark.sparkContext)
    send = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda sc, value: sizes.append(len(pickle.dumps(value))) or send(sc, value))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts["x"])], "doc_id long, text string").repartition(3)
    assert {r["_lang_pred"] for r in language.predict(df, model).collect()} == {"x"}
    assert len(sizes) == 1 and sizes[0] < len(model.symbol) + model.step.nbytes / 20
    held = language.packed_model(model)
    for _ in range(2):
        assert all(np.array_equal(a, b) for a, b in zip(language.unpacked_model(held), model, strict=True))
    assert language.unpacked_model(held).step is held["step"]  # unpacked once


def test_a_model_is_small_in_a_worker():
    rng = random.Random(13)
    texts = {n: [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 7))) for _ in range(60)) for _ in range(40)] for n in "xy"}
    model = language.unpacked_model(pickle.loads(pickle.dumps(language.packed_model(language.fit(texts)))))
    tables = sum(x.nbytes for k, x in model._asdict().items() if k not in ("languages", "symbol"))
    assert tables < 80 * sum(len(t) for x in texts.values() for t in x)


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    train = {"x": ["abba abab"], "y": ["bcbc ccab"]}
    model = language.fit(train, symbols=18)  # one letter has a symbol, all others are spelt
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 60))) for _ in range(50)] + ["abab" * 800]
    for t in texts:
        s = language.symbols_of(t, model.symbol)
        if not len(s):
            continue
        runs = [s[i : i + language.RUN] for i in range(0, len(s), language.RUN)]
        got = language.phrases(runs, model).sum(axis=0)
        for k, name in enumerate(model.languages):
            data = bytes(np.concatenate([[0], *(language.symbols_of(x, model.symbol) for x in train[name])]).astype(np.uint8))
            count = 0
            for r in runs:
                at, r = 0, bytes(r)
                begun = b""
                for c in r:
                    if begun + bytes([c]) in data:
                        begun += bytes([c])
                    else:
                        count += 1
                        begun = bytes([c]) if bytes([c]) in data else b""
            assert got[k] == count


def test_language_accuracy_and_odd_rows(spark, odd, none):
    got = {r["doc_id"]: r for r in language.op7_language(spark, "/root/testdata/sf0.01").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert held and all((zlib.crc32(str(k).encode()) % 5 == 0) == r["held_out"] for k, r in got.items())
    assert sum(got[k]["lang_pred"] == lang[k] for k in held) / len(held) > 0.97
    model = language.train_model(odd)
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["_lang_pred"] == "und") == (not letters) and 0 <= r["_score"] <= 1 and (letters or r["_score"] == 0)
    assert language.predict(none, model).count() == 0
    empty = language.train_model(none)
    assert {r["_lang_pred"] for r in language.predict(odd, empty).collect()} == {"und"}


def test_style_tree_removes_what_a_site_repeats(spark):
    def page(i, inside, host="a.com"):
        return (i, f"http://{host}/{i}", inside)

    def art(i):
        return f'<div class="x1"><h2>Title {i}</h2>' + "".join(f"<p>Own text {i} {j}</p>" for j in range(2 + i % 4)) + "</div>"

    rows = [page(i, f'<body><div class="k7">Site tagline</div><div class="m3"><a href=1>One</a> <a href=2>Two</a></div>{art(i)}<div class="z9"><p>All rights for everyone</p></div></body>') for i in range(12)]
    rows += [
        page(100, '<body><nav>menu</nav><article><h1>A &amp; B</h1><p>x <b>bold</b> <script>var a="</p>";</script>y&nbsp;z<p>two<ul><li>i1<li>i2</ul><div id="comments"><p>nice</p></div><form><p>f</p></form></article><div>outside</div>', "b.com"),
        page(101, None, "b.com"), page(102, "", "c.com"), (103, None, "<p>no host"), (None, "http://b.com", "plain  text\nonly"),
        page(104, "<body><header>Top</header><main><header><h1>H</h1></header><p>one<br>two</p><aside>s</aside><table><tr><td>a<td>b</table></main><footer>f</footer>", "e.com"),
        page(105, '<div class="has-sidebar"><p>body</p><div class="sidebar">gone</div></div><![bad', "f.com"),
        page(106, "<p>" + "long " * 50_000 + "</p>", "g.com"), page(106, "<p>again</p>", "g.com"), page(106, "<p>again</p>", "g.com"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, runs string").repartition(3)
    got = {}
    for r in html_text.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in range(12):
        assert got[i] == ["\n".join([f"Title {i}", *(f"Own text {i} {j}" for j in range(2 + i % 4))])]
    assert got[100] == ["A & B\nx bold y z\ntwo\ni1\ni2"] and got[101] == [""] == got[102] and got[103] == ["no host"] and got[None] == ["plain text only"]
    assert got[104] == ["H\none two\na b"] and got[105][0].startswith("body") and "gone" not in got[105][0]
    assert sorted(map(len, got[106])) == [5, 5, 249_999]
    assert html_text.extract(df.limit(0)).count() == 0


def test_style_tree_keeps_own_text_on_a_large_host(spark):
    def page(i):
        n = 1 if i % 10 else 2 + i // 10 % 20  # one usual sequence of children, 20 rare ones
        own = "".join(f"<p>Own text {i} {j}</p>" for j in range(n))
        few = f'<div class="w"><p class="s">Same {i % 2}</p><p class="t">Same line</p><div id="u{i}">Only here {i}</div></div>'
        return (i, f"http://big.com/{i}", f'<body><div class="k7">Site tagline</div><div class="c">{own}</div>{few}</body>')

    df = spark.createDataFrame([page(i) for i in range(3000)], "page_id long, url string, html string").repartition(4)
    for r in html_text.extract(df).collect():
        i = r["page_id"]
        n = 1 if i % 10 else 2 + i // 10 % 20
        assert r["text"] == "\n".join([*(f"Own text {i} {j}" for j in range(n)), f"Only here {i}"])


@pytest.mark.parametrize("mark", ["<![ x ]>", "<![foo[ x ]]>", "<![CDATA[x]>", "<![endif]-->", "<![>"])
def test_text_after_a_marked_section_stays(mark):
    runs, _, _ = html_text.parse_page(f"<p>one</p>{mark}<p>two</p><p>a {mark} b</p>")
    assert [r["text"].replace("-->", "").split() for r in runs if r["text"] != "-->"] == [["one"], ["two"], ["a", "b"]]


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="page nav-fixed"><p>one</p><p>two</p></div>', ["one", "two"]),
        ('<div id="content" class="post comments-open"><p>one</p></div><div class="comments"><p>a longer remark than the text</p></div>', ["one"]),
        ('<div class="wrapper ad-free"><p>one</p><div class="ad-slot-1">buy</div></div>', ["one"]),
        ('<article><p>one</p><p class="notice-of-motion">two</p><p class="site-notice">three</p></article>', ["one", "two"]),
        ('<div class="widget"><p>the only text is here</p><div class="footer-inner">foot</div><p>and <span class="ad">x</span>here</p></div><div class="menu">m</div>', ["the only text is here", "and here"]),
        ('<div class="menu">aa</div><div class="footer">bb</div>', []),
        ('<div class="sidebar no-margin">aa</div><div class="has-sidebar">bb</div>', ["bb"]),
    ],
)
def test_names_mark_a_branch_by_their_purpose(html, want):
    assert [r["text"] for r in html_text.parse_page(html)[0]] == want


def test_style_tree_on_pages(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in html_text.op9_style_tree(spark, "/root/testdata/sf0.001").collect():
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_language_learns_from_the_whole_text(spark):
    rng = random.Random(2)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    own = {"x": ["ka", "lo", "mi"], "y": ["ten", "sur", "ald"]}
    header = "this page was made by a program and comes from elsewhere " * 7
    docs = [(i, header + " ".join(word(own["xy"[i % 2]]) for _ in range(400)), "xy"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    bare = spark.createDataFrame([(i, " ".join(word(own["xy"[i % 2]]) for _ in range(30)), "xy"[i % 2]) for i in range(20)], df.schema)
    assert all(r["lang"] == r["_lang_pred"] for r in language.predict(bare, language.train_model(df)).collect())
    cut = df.select(language.windows(language.F.col("text"), 300).alias("w"), language.windows(language.F.col("text"), 10**6).alias("all"), "text").collect()
    assert all(290 < len(r["w"]) <= 300 and r["w"][:99] == r["text"][:99] and r["w"][-99:] == r["text"][-99:] and r["all"] == r["text"] for r in cut)


def brute_components(docs):
    sets = [set_join.shingle_set(t) for _, t in docs]
    sets = [set(s.tolist()) for s in sets]
    part = list(range(len(docs)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), len(sets[i]), str(k if not sets[i] else least.get(find(i)))) for i, (k, _) in enumerate(docs))


def near_copies(seed, groups=6, size=14, words=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = rng.choices(vocabulary, k=30)
    docs = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=words) + common
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = t[: len(t) - rng.randrange(20)]
            docs.append(" ".join(t))
    docs += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(40)]
    docs += docs[:5]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_all_pairs(spark, seed):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = components_of(df)
    assert got == brute_components(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_links_match_all_pairs(spark, odd, none, seed):
    docs = near_copies(seed)
    nodes, links = set_join.join_links(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    node = {r["key"]: r["node"] for r in nodes.collect()}
    sets = {node[k]: set(set_join.shingle_set(t).tolist()) for k, t in docs}
    names = sorted(sets)
    want = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(map(tuple, links.collect())) == want and len(want) > len(names)  # far more links than a tree of the groups has
    assert set_join.join_links(none)[1].count() == 0


def components_of(df):
    nodes, parts = set_join.join_components(df)
    part = {r["node"]: r["part"] for r in parts.collect()}
    rows = [(r["key"], r["n"], part.get(r["node"], r["node"])) for r in nodes.collect()]
    least = {}
    for k, _, p in rows:
        if k is not None:
            least[p] = min(k, least.get(p, k))
    return sorted((str(k), n, str(k if n == 0 else least.get(p))) for k, n, p in rows)


def test_components_already_found_take_one_round(spark, monkeypatch):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102)], "a long, b long")
    parts = set_join.components(links).cache()
    want = {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}
    assert {tuple(r) for r in parts.collect()} == want
    names = []
    cut_at = set_join.cut_at
    monkeypatch.setattr(set_join, "cut_at", lambda df, name: names.append(name) or cut_at(df, name))
    again = set_join.components(parts.select(parts.part.alias("a"), parts.node.alias("b")))
    assert {tuple(r) for r in again.collect()} == want and names == ["edges"] * 2


def test_jaccard_odd_rows_and_one_of_each(spark, odd, none, duck):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert components_of(odd) == brute_components(docs)
    kept = set_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "10", "3", "4", "5", "6", "7", "9", "None"])
    nodes, parts = set_join.join_components(none)
    assert nodes.count() == 0 and parts.count() == 0 and set_join.keep_one(none).count() == 0


def test_jaccard_matches_sql(spark, small, duck):
    got = sorted(map(tuple, set_join.op10_jaccard(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(duck(set_join.ORACLE, documents=duck_docs(small[0])))


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_pair_blocks_cover_every_link_across_batches(step):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 60, dtype="u8"))
    sets = {}
    for n in range(60):
        s = rng.choice(base, 40 + n % 12, replace=False)
        sets[n] = np.unique(np.concatenate((s, rng.integers(0, 2**63, n % 5, dtype="u8"))))
    rows = {(int(t), int(n)): int(p) for t, n, p in zip(rng.integers(0, 12, 400), rng.integers(0, 60, 400), rng.integers(0, 6, 400), strict=True)}
    rows = sorted((t, n, len(sets[n]), p, n % 7) for (t, n), p in rows.items())

    def batches():
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*part, strict=True)), pa.array([set_join.parity(sets[r[1]]) for r in part], pa.binary())], ["token", "node", "size", "pos", "part", "parity"])

    may = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[4] != b[4] and set_join.may_link(np.int64(a[2]), a[3], np.int64(b[2]), b[3])}
    links = {(i, j) for i, j in may if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)}
    got = {(a, b) for x in set_join._open_pairs(batches()) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    assert links <= got <= may


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_holds_few_shingles_and_pairs():
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(504)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    got = []
    assert peak_mb(lambda: got.extend(set_join._nodes(iter([batch])))) < 20  # 12 MB of slots, and 12 more in one array
    assert sum(got[-1].column(5).to_pylist()) == 3000 * 500
    n = 1500  # a list of one block, every pair of which may link
    bits = set_join.parity(np.zeros(1, np.uint64))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([1] * n, range(n), [9] * n, [0] * n, range(n), [bits] * n), types, strict=True)], ["token", "node", "size", "pos", "part", "parity"])
    sizes = []
    assert peak_mb(lambda: sizes.extend(b.num_rows for b in set_join._open_pairs(iter([batch])))) < 60
    assert sum(sizes) == n * (n - 1) // 2


def test_rows_with_sets_go_in_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(5000).selectExpr("id", "concat('a b c d e ', id) AS text").coalesce(1)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    with short_batches(spark):
        assert {r["n"] for r in cut(docs.mapInArrow(count, "n long"), "batches").collect()} == {1000}
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("step", [7, 10_000])
def test_short_lists_are_paired_many_at_once(monkeypatch, step):
    calls = []
    near = set_join.near
    monkeypatch.setattr(set_join, "near", lambda *a: calls.append(len(a[0])) or near(*a))
    noise, rows = random.Random(6), []
    for token in range(1500):
        for _ in range(noise.choice([2, 2, 3, 5]) if token % 500 else 80):  # a few lists that go by blocks
            rows.append((token, len(rows), noise.randint(8, 12), noise.randint(0, 1), noise.randint(0, 3), set_join.parity(np.zeros(1, np.uint64))))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    batches = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + step], strict=True), types, strict=True)], ["token", "node", "size", "pos", "part", "parity"]) for i in range(0, len(rows), step))
    got = Counter((a, b) for x in set_join._open_pairs(batches) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
    lists = {}
    for r in rows:
        lists.setdefault(r[0], []).append(r)
    some = np.int64
    want = {(a[1], b[1]) for of in lists.values() for i, a in enumerate(of) for b in of[i + 1 :] if a[4] != b[4] and set_join.may_link(some(a[2]), a[3], some(b[2]), b[3])}
    assert set(got) == want and max(got.values()) == 1 and len(want) > 1000
    assert len(calls) < 400 + 2 * len(rows) / step  # one call for each row before


def test_word_hashes_over_parts(monkeypatch):
    text = " ".join(f"wört{i % 50}" for i in range(400)) + " " + "x" * 5000 + " end"
    whole = set_join.shingle_set(text)
    monkeypatch.setattr(set_join, "SEGMENT", 64)
    parts = [w for w in text.lower().encode().split()]
    assert len(set_join.word_hashes(text.encode())) == len(parts)
    monkeypatch.setattr(set_join, "SEGMENT", 3000)
    assert (set_join.shingle_set(text) == whole).all()
