"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every
substring of that text. A document is parsed against it greedily: a phrase
goes on while it occurs in the language's text and a new phrase begins where it
no longer does. The phrases needed, times log2 of the training length, over
the document's length, estimate the cross entropy in bits per symbol; the
language with the least wins.

The automata are fitted on a bounded sample: ``docs_per_language`` labelled
documents of each language (the first in the order of a hash of their id) and
``chars_per_doc`` code points of each, in WINDOWS pieces spread over its whole
text. That bounds the tables that a Python
worker holds: 16 * docs_per_language * chars_per_doc * symbols bytes a language at
most, whatever the alphabet, as the sample ends at so many symbols. A state's
transitions take the places from its least symbol to its greatest alone, and most
states have a single one, so the tables are far smaller in fact. They go to the
executors compressed. Prediction reads whole texts.
Letters are lowered and everything between them is one space. The most frequent
letters of the sample have a symbol each; any other letter, met in the sample or
not, is spelt by the hexadecimal digits of its code point, which have symbols of
their own: all letters stay distinct, in alphabets of any size.

Defined results: null text or a text without letters is ``und`` with score 0;
if nothing is labelled, everything is ``und``; rows without a label or an id
are not learned from; equal entropies go to the language first by name; equal
texts get equal results; extra columns are ignored; an empty table gives no
rows. Very long texts are parsed in runs of 1024 symbols, each from its first
symbol on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_hash, table

RUN = 1024
RUNS_AT_ONCE = 8192
#: pieces of a sampled document
WINDOWS = 3
UNKNOWN = "und"
#: digits of a spelt letter: all letters of Unicode are below 16 ** 5
DIGITS, BASE = 5, 16
SPELT = 255
ADDED = {c: T.StructField(c, t) for c, t in (("_lang_pred", T.StringType()), ("_score", T.DoubleType()), ("_entropy", T.DoubleType()))}


class Model(NamedTuple):
    languages: list[str]
    #: symbol of every code point: 0 between words, 1 to BASE the digits, SPELT a letter that is spelt
    symbol: np.ndarray
    #: transitions of all automata, [state + symbol] -> next state, where ``owner`` there is the state
    step: np.ndarray
    owner: np.ndarray
    #: where a phrase ends, the state that the symbol begins the next one with, [language, symbol]
    again: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def symbols_of(text: str, symbol: np.ndarray) -> np.ndarray:
    """Symbols of a text with one space at both ends and between words; empty
    if it has no letter."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    s = symbol[points]
    keep = np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))
    kept = s[keep]
    if not kept.any():
        return kept[:0]
    if (spelt := kept == SPELT).any():
        kept = np.repeat(kept, np.where(spelt, DIGITS, 1))
        letters, place = np.unique(points[keep][spelt], return_inverse=True)
        lowered = np.array([ord(chr(p).lower()[:1]) for p in letters])
        digits = lowered[:, None] // BASE ** np.arange(DIGITS - 1, -1, -1) % BASE + 1
        kept[kept == SPELT] = digits[place].reshape(-1)
    return kept


def fit(sample: dict[str, list[str]], symbols: int = 64, limit: int | None = None) -> Model:
    """Automata of the texts of each language, of its first ``limit`` symbols."""
    if symbols <= BASE:
        raise ValueError(f"symbols={symbols}")
    languages = sorted(sample)
    seen = Counter(c for texts in sample.values() for t in texts for c in t.lower() if c.isalpha())
    alphabet = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: symbols - 1 - BASE]]
    code = {c: i + 1 + BASE for i, c in enumerate(alphabet)}
    symbol = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if (c := chr(point)).isalpha():
            symbol[point] = code.get(c if c in code else c.lower()[:1], SPELT)
    steps, owners, again, roots, bits, at = [], [], [], [], [], 0
    for name in languages:
        text = np.concatenate([np.zeros(1, np.uint8), *(symbols_of(t, symbol) for t in sample[name])])[:limit]
        states = automaton(text.tolist())
        place, size = places(states, at, symbols)
        step, owner = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for moves, state in zip(states, place, strict=True):
            for c, to in moves.items():
                step[state + c - at], owner[state + c - at] = place[to], state
        steps.append(step)
        owners.append(owner)
        # the symbol begins the next phrase, at the root if unseen
        again.append([place[states[0][c]] if c in states[0] else place[0] for c in range(symbols)])
        roots.append(place[0])
        bits.append(np.log2(max(len(text), 2)))
        at += size
    none = [np.zeros(0, np.int32)]
    return Model(languages, symbol, np.concatenate(steps or none), np.concatenate(owners or none), np.array(again, np.int32).reshape(-1, symbols), np.array(roots, np.int32), np.array(bits))


def places(states: list[dict[int, int]], at: int, symbols: int) -> tuple[list[int], int]:
    """A different number for each state, from ``at`` on, so that the places
    number + symbol of no two states' transitions meet, and how many places
    that takes."""
    taken: set[int] = set()
    place, free = [], at + symbols
    for moves in states:
        least = min(moves, default=0)
        while free - least in taken:
            free += 1
        place.append(free - least)
        taken.add(free - least)
        free += max(moves, default=least) - least + 1
    return place, free + symbols - at


#: fields that travel compressed
PACKED = {"symbol": np.uint8, "step": np.int32, "owner": np.int32}


def packed_model(model: Model) -> dict:
    """The model as it travels."""
    return model._asdict() | {k: zstandard.compress(getattr(model, k).tobytes(), 1) for k in PACKED}


def unpacked_model(held: dict) -> Model:
    """The model of :func:`packed_model`, whose tables are unpacked in their
    place, so only once for each Python worker."""
    for k, kind in PACKED.items():
        if isinstance(held[k], bytes):
            held[k] = np.frombuffer(zstandard.decompress(held[k]), kind)
    return Model(**held)


def phrases(runs: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases of each run in each language, [run, language]: all runs and
    languages take one symbol at a time together."""
    lengths = np.array([len(r) for r in runs])
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    grid = np.zeros((sorted_lengths[0], len(runs)), np.int32)
    for k, i in enumerate(order):
        grid[: lengths[i], k] = runs[i]
    counts = np.zeros((len(model.languages), len(runs)), np.int32)
    state = np.repeat(model.roots[:, None], len(runs), axis=1)
    active = np.searchsorted(-sorted_lengths, -np.arange(sorted_lengths[0]), side="left")
    for j, m in enumerate(active):
        now, symbol = state[:, :m], grid[j, :m]
        at = now + symbol
        goes_on = model.owner.take(at) == now
        counts[:, :m] += ~goes_on
        state[:, :m] = np.where(goes_on, model.step.take(at), model.again.take(symbol, axis=1))
    out = np.empty((len(runs), len(model.languages)), np.int32)
    out[order] = counts.T
    return out


def classify(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[float | None]]:
    """(language, score, bits per symbol) of each text. The score is 1 minus
    the winner's entropy over the runner-up's."""
    runs: list[np.ndarray] = []
    owner: list[int] = []
    total = np.zeros((len(texts), len(model.languages)), np.int64)
    sizes = np.zeros(len(texts), np.int64)

    def work() -> None:
        if runs:
            np.add.at(total, np.array(owner), phrases(runs, model))
            runs.clear()
            owner.clear()

    for i, t in enumerate(texts if model.languages else []):
        s = symbols_of(t, model.symbol) if t else ()
        sizes[i] = len(s)
        for at in range(0, len(s), RUN):
            runs.append(s[at : at + RUN])
            owner.append(i)
            if len(runs) >= RUNS_AT_ONCE:
                work()
    work()
    names, scores, entropies = [], [], []
    for n, c in zip(sizes, total, strict=True):
        if not n:
            names.append(UNKNOWN), scores.append(0.0), entropies.append(None)
            continue
        h = (c + 1) * model.bits / n
        best = int(h.argmin())
        others = np.delete(h, best)
        names.append(model.languages[best]), entropies.append(float(h[best]))
        scores.append(float(min(1.0, max(0.0, 1 - h[best] / others.min()))) if len(others) else 1.0)
    return names, scores, entropies


def windows(text: Column, chars: int) -> Column:
    """``chars`` characters of a text at most: WINDOWS pieces spread evenly
    from its begin to its end, or the whole text if it is no longer."""
    size, n = F.char_length(text), (chars - WINDOWS + 1) // WINDOWS
    at = [F.floor((size - n) * i / (WINDOWS - 1)).cast("int") + 1 for i in range(WINDOWS)]
    return F.when(size <= chars, text).otherwise(F.concat_ws(" ", *[F.substring(text, a, n) for a in at]))


def train_model(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", usable: Column | None = None, docs_per_language: int = 200, chars_per_doc: int = 300, symbols: int = 64) -> Model:
    """Fit on a bounded sample of the labelled rows (those where ``usable``)."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    if usable is not None:
        rows = rows.filter(usable)
    first = Window.partitionBy("label").orderBy("h", "key", "text")
    rows = rows.select(F.col(label).alias("label"), F.col(key).alias("key"), id_hash(F.col(key)).alias("h"), windows(F.col(text), chars_per_doc).alias("text"))
    picked = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= docs_per_language)
    sample: dict[str, list[str]] = {}
    for r in picked.select("label", "text", "n").orderBy("label", "n").collect():
        sample.setdefault(r["label"], []).append(r["text"])
    return fit(sample, symbols, docs_per_language * (chars_per_doc + 2) + 1)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``_lang_pred``, ``_score`` and ``_entropy`` (bits per
    symbol), in the place of any such columns; all others are kept. Predictions read the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(packed_model(model))  # bounded by the sample
    docs = docs.drop(*ADDED)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = unpacked_model(shared.value)
        for b in batches:
            names, scores, entropies = classify(b.column(at).to_pylist(), fitted)
            more = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *ADDED])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED.values()]))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_model(docs, usable=~held_out(F.col("doc_id")))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_entropy").alias("entropy"))
