"""Threshold policies over blocks against a plain fold: long keys, nulls, ties, skew, empty streams."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered
from tidemark.operators import thresholds

SCHEMA = "k int, pos long, score double, T_op double, T_min double, rows string, xs int"


def plain(scores, t_op=10.0, t_min=1.0, conditional=False):
    t, out = t_op, []
    for a in scores:
        before = t
        if a is not None and not (conditional and a > t):
            t = max(t_min, 0.9 * t + (1 - 0.9) * a)
        out.append((before, t, a is not None and a > before))
    return out


def frame(spark, streams, parts=7):
    """Streams by key, rows in no order, with columns that are named like the operators' own."""
    rows = [(k, i, a, 10.0, 1.0, "r", i) for k, scores in streams.items() for i, a in enumerate(scores)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def traced(df, *cols):
    out = {}
    for r in df.orderBy("k", "pos").collect():
        out.setdefault(r["k"], []).append(tuple(r[c] for c in cols))
    return out


@pytest.fixture(scope="module")
def streams():
    r = random.Random(2)
    slow = [10 * 0.9995**i + r.choice([0, 0, 5]) for i in range(9000)]  # comes down over very many blocks
    return {
        1: [r.uniform(0, 20) for _ in range(6000)], 2: slow, 3: [10.0, 0.0, None, 10.0], 4: [None] * 700, 5: [30.0] * 600, 6: [7.0], 7: [None, 3.0, None, 20.0] * 300,
    }


def test_ema(spark, streams):
    got = traced(thresholds.ema(frame(spark, streams), ["k"], ["pos"]), "T_before", "T_after", "flagged")
    for k, scores in streams.items():
        want = plain(scores)
        clear = [a is None or abs(a - w[0]) > 1e-9 for a, w in zip(scores, want)]  # a level stream and its T meet in the last bit
        assert [x[2] for x, c in zip(got[k], clear) if c] == [x[2] for x, c in zip(want, clear) if c]
        assert [y for x in got[k] for y in x[:2]] == pytest.approx([y for x in want for y in x[:2]], abs=1e-9)


def test_conditional_equals_the_fold_bit_by_bit(spark, streams):
    got = traced(thresholds.ema_conditional(frame(spark, streams), ["k"], ["pos"]), "T_before", "T_after", "flagged")
    assert got == {k: plain(scores, conditional=True) for k, scores in streams.items()}


def test_policies_and_gathered_policies(spark, streams):
    cols = ("u0", "u1", "c0", "c1", "f_fixed", "f_uncond", "f_cond", "rows", "xs")
    short = {k: v[:300] for k, v in streams.items()}
    a = traced(thresholds.policies(frame(spark, short), ["k"], ["pos"]), *cols)
    b = traced(thresholds.gathered_policies(frame(spark, short), ["k"], ["pos"]), *cols)
    fold = lambda d: {k: [(*x[2:5], *x[6:]) for x in v] for k, v in d.items()}
    assert fold(a) == fold(b)
    for k, scores in short.items():
        assert [x[0] for x in b[k]] == [x[0] for x in plain(scores)] and [x[2] for x in b[k]] == [x[0] for x in plain(scores, conditional=True)]
        assert [y for x in a[k] for y in x[:2]] == pytest.approx([y for x in b[k] for y in x[:2]], abs=1e-9)
    with pytest.raises(Exception, match="more than 299 rows"):
        thresholds.gathered_policies(frame(spark, {1: [1.0] * 300}), ["k"], ["pos"], most=299).collect()


def test_rounds_of_a_long_key(spark):
    """A key of 200,000 rows that settles: few rounds, and the fold's value; one that sinks for ever takes more."""
    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("pos"), ((F.col("id") * 7919) % 101 / 5.0).alias("score"), F.lit(10.0).alias("T_op"), F.lit(1.0).alias("T_min"))
    each = thresholds.blocked(rows, ["k"], ["pos"])
    ends, rounds = thresholds.conditional_ends(each, ["k"])
    assert each.count() >= n // ordered.BLOCK
    assert rounds <= 4
    assert ends.agg(F.min("end")).first()[0] == plain([(i * 7919) % 101 / 5.0 for i in range(n)], conditional=True)[-1][1]


def test_capped_and_floor_take_nulls(spark, streams):
    floor = {r["k"]: r["T_final"] for r in thresholds.conditional_floor(frame(spark, streams), ["k"], ["pos"]).collect()}
    assert floor == {k: plain(v, conditional=True)[-1][1] for k, v in streams.items()}
    capped = {r["k"]: r["T_final"] for r in thresholds.ema_capped(frame(spark, streams), ["k"], ["pos"], 0.8).collect()}
    for k, scores in streams.items():
        t = 10.0
        for a in scores:
            t = min(8.0, max(1.0, 0.9 * t + 0.1 * a)) if a is not None else t
        assert capped[k] == pytest.approx(t, abs=1e-9)


def test_empty(spark):
    none = frame(spark, {1: [1.0]}).where("false")
    for f in (thresholds.ema, thresholds.ema_conditional, thresholds.policies, thresholds.gathered_policies, thresholds.conditional_floor):
        assert f(none, ["k"], ["pos"]).collect() == []


@pytest.mark.parametrize("k", [1, 15])
def test_median_over_many_ranges(spark, streams, k):
    """Ranges borrow the rows before them: as a window over the whole key, nulls aside."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    some = {q: v[:500] for q, v in streams.items()}
    try:
        got = traced(thresholds.median_threshold(frame(spark, some), ["k"], ["pos"], k), "T_before", "flagged")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for q, scores in some.items():
        for i, (t, flagged) in enumerate(got[q]):
            known = [a for a in scores[max(0, i - k) : i] if a is not None]
            assert t == pytest.approx(max(1.0, statistics.median(known) if known else 10.0))
            assert flagged == (scores[i] is not None and scores[i] > t)
