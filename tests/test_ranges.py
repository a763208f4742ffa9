"""Range windows with halos and interval labels, with keys that spread over many ranges, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranges, windows


@pytest.fixture
def many(spark):
    """Many small ranges, which Spark does not put together."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(seq, length, stride, least, alphabet):
    out = []
    for k, tokens in seq.items():
        a = [t for t in tokens if alphabet is None or t in alphabet]
        if len(a) >= max(length, least):
            out += [(k, i // stride, a[i : i + length]) for i in range(0, len(a) - length + 1, stride)]
        elif len(a) >= least:
            out.append((k, 0, a))
    return sorted(out)


@pytest.mark.parametrize("length,stride,alphabet", [(10, 2, None), (4, 3, ["x", "y"]), (60, 7, None), (1, 1, None)])
def test_one_key_over_many_ranges(many, length, stride, alphabet):
    r = random.Random(length)
    seq = {1: [r.choice("xyz") for _ in range(900)], 2: [r.choice("xyz") for _ in range(12)], 3: list("xyx"), 4: list("xyzxyzx"), None: list("xyxyxyxyxyxy")}
    rows = [(k, i, "v", t) for k, tokens in seq.items() for i, t in enumerate(tokens)]
    r.shuffle(rows)
    df = many.createDataFrame(rows, "k int, at int, pos string, t string")
    assert ranges.positions(df.withColumnRenamed("pos", "p"), "k", ["at"]).select("_part").distinct().count() > 10
    got = [(x["seq_id"], x["win_ix"], x["tokens"]) for x in ranges.long_windows(df, "k", ["at"], F.col("t"), alphabet, length, stride).where("seq_id IS NOT NULL").collect()]
    seq.pop(None)
    assert sorted(got) == plain(seq, length, stride, windows.LEAST, alphabet)


def test_positions(many):
    df = many.createDataFrame([(i % 3 and 7, i) for i in range(500)], "k int, at int")
    got = sorted((r["seq_id"], r["pos"], r["token"]) for r in ranges.long_sequences(df, "k", ["at"], F.col("at")).collect())
    want = sorted((k, p, i) for k in (0, 7) for p, i in enumerate(i for i in range(500) if (i % 3 and 7) == k))
    assert got == want


def test_intervals(many):
    r = random.Random(8)
    key = lambda: r.choice([1, 1, 1, 2, 3])
    spans = lambda n, most: [(key(), a := r.randrange(3000), a + r.randrange(most)) for _ in range(n)]
    w, i = [*spans(800, 12), (9, 5, 6), (1, None, 9), (1, 3, None), (1, 100, 100)], [*spans(120, 9), (2, 7, None), (8, 1, 2), (1, 100, 100)]
    got = ranges.in_intervals(many.createDataFrame([(*x, "own") for x in w], "k int, start int, stop int, label2 string"), many.createDataFrame(i, "k int, lo int, hi int"), "k").collect()
    hit = lambda k, s, e: int(s is not None and e is not None and any(k == q and None not in (lo, hi) and s <= hi and e >= lo for q, lo, hi in i))
    order = lambda x: str(x)
    assert sorted(((r["k"], r["start"], r["stop"], r["label"]) for r in got), key=order) == sorted(((*x, hit(*x)) for x in w), key=order)
    assert 100 < sum(r["label"] for r in got) < 700


def test_empty(spark):
    none = spark.createDataFrame([], "k int, at int, t string")
    assert ranges.long_windows(none, "k", ["at"], F.col("t")).collect() == []
    w = spark.createDataFrame([(1, 2, 3)], "k int, start int, stop int")
    assert [r["label"] for r in ranges.in_intervals(w, spark.createDataFrame([], "k int, lo int, hi int"), "k").collect()] == [0]
