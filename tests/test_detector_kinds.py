"""Windows that are alike are scored once, and the split puts only the rooms that it cuts in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.portable import h32
from tidemark.operators import detector, sampling


def test_each_distinct_window_is_scored_once(spark):
    """900 windows of 12 vectors: scorers see 12 rows and all training windows, and scores are those of a plain version."""
    rng = np.random.default_rng(4)
    kinds = np.round(rng.random((12, 2)), 3)
    rows = [(i, int(rng.integers(12)), bool(rng.random() < 0.4)) for i in range(900)]
    rows = [(i, [float(v) for v in kinds[k]], t and k < 8) for i, k, t in rows]
    df = spark.createDataFrame(rows, "id int, x array<double>, t boolean")
    seen = {}

    def scorer(name, at):
        def score(d, train):
            seen[name] = d.count(), train.count()
            return d.withColumn(name, F.get("scaled", F.lit(at)) * F.get("scaled", F.lit(at)))

        return score

    got = {r["id"]: r for r in detector.score_windows(df, "x", F.col("t"), scorer("recon", 0), scorer("isolation", 1)).collect()}
    train = np.array([x for _, x, t in rows if t])
    scale = np.quantile(train, 0.99, 0) - np.quantile(train, 0.01, 0)
    scaled = lambda x: ((np.array(x) - np.median(train, 0)) / scale) ** 2
    parts = scaled(train)
    z = lambda x: (scaled(x) - np.median(parts, 0)) / (np.quantile(parts, 0.75, 0) - np.quantile(parts, 0.25, 0))
    assert len(got) == 900 and all(got[i]["_train"] == t for i, _, t in rows)
    for i, x, _ in rows:
        assert got[i]["score"] == pytest.approx(0.7 * z(x)[0] + 0.3 * z(x)[1], abs=2e-9)
    assert seen == {"recon": (12, len(train)), "isolation": (12, len(train))}


def test_halves_when_ids_repeat_and_when_few_rooms_are_cut(spark):
    ids = [*range(700), *[5] * 41, *[1000] * 3]
    df = spark.createDataFrame([("ab"[i % 2], i) for i in ids] + [("c", 1), ("d", 2), ("d", 3)], "label string, id int")
    out = sampling.split_half(df, "label", "id", "s")
    keyed = out.withColumn("key", h32("s", F.col("id"))).collect()
    for label in "abcd":
        own = sorted(((r["key"], r["id"], r["split"]) for r in keyed if r["label"] == label))
        n = len(own)
        assert [s for _, _, s in own] == ["CAL"] * (n // 2) + ["TEST"] * (n - n // 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and n == 2
