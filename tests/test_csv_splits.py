"""Quoted CSV read in many splits: the same rows and numbers as one reader of
the whole file gives."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from assetclean.sources.csv_source import open_after, read_inventory_csv, records

SMALL = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def splits(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def awkward(rng, n):
    cells = ["plain", "", 'say ""hi""', "comma, inside", "two\nlines", '\n\n"\n', "é\U0001f600", "tail\\", '5" pipe'.replace('"', ""), "x" * 400, " lead", "a\n" * 60, '",\n",']
    return [[rng.choice(cells) for _ in range(3)] + [str(i)] for i in range(n)]


def written(rows, end, third="c,\nd"):
    f = io.StringIO(newline="")
    w = csv.writer(f, lineterminator=end)
    w.writerow(["a", 'b "x"', third, "i"])
    w.writerows(rows)
    return f.getvalue()


def whole(spark, path):
    """One task over the whole file, as Spark's own multi-line reader does it."""
    df = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_splits(spark, splits, tmp_path, end):
    path = str(tmp_path / "a.csv")
    rows = awkward(random.Random(4), 900)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(written(rows, end, "c,d"))  # Spark's reader takes the first line break it sees for a row's end
    df = read_inventory_csv(spark, path)
    got = df.orderBy("_ord").collect()
    assert df.columns == ["a", 'b "x"', "c,d", "i", "_ord"]
    assert [r["_ord"] for r in got] == list(range(len(rows)))
    assert [tuple(r)[:-1] for r in got] == whole(spark, path)
    assert [[v or "" for v in tuple(r)[:-1]] for r in got] == rows
    assert len({r[0] for r in records(spark, path).select(F.spark_partition_id()).collect()}) > 8


def test_files_and_odd_ends(spark, splits, tmp_path):
    """Several files, no newline at the end, empty lines, a header alone, stray
    quotes in plain fields, a quoted field longer than several splits."""
    rng = random.Random(9)
    texts = {
        "b.csv": written(awkward(rng, 120), "\n").rstrip("\n"),
        "a x.csv": 'a,"b ""x""","c,\nd",i\n\n1,5" pipe,y,2\n\n"q" r,"s",t,3\n',
        "c.csv": written([], "\n"),
        "d.csv": written([["long\n" * 4000, "x", "", "1"], ["y", "z", '"', "2"]], "\n"),
    }
    for name, text in texts.items():
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            f.write(text)
    got = read_inventory_csv(spark, str(tmp_path)).orderBy("_ord").collect()
    want = [(k, i, r) for k, name in enumerate(sorted(texts)) for i, r in enumerate(whole(spark, str(tmp_path / name)))]
    assert [(r["_ord"] >> 33, r["_ord"] & (1 << 33) - 1, tuple(r)[:-1]) for r in got] == want


def test_state_at_the_end_of_a_line():
    """Against a reader that goes character by character."""

    def brute(line, inside):
        start, closed = not inside, False
        i = 0
        while i < len(line):
            ch = line[i]
            if inside:
                if ch == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        inside, start = False, False
            elif ch == '"' and start:
                inside, start = True, False
            else:
                start = ch == ","
            i += 1
        return inside or closed

    rng = random.Random(2)
    for _ in range(20000):
        line = "".join(rng.choice('"",a') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            assert open_after(line, inside) == brute(line, inside), (line, inside)
