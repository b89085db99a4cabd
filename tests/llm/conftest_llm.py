"""Helpers of the tests."""

from collections import defaultdict


def by_key(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def duck_docs(df):
    import pyarrow as pa

    rows = df.select("doc_id", "text", "lang", "source", "n_chars").collect()
    return pa.table({c: pa.array([r[c] for r in rows], t) for c, t in (("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()))})
