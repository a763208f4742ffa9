"""Steps whose cost once grew faster than their work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import quantiles
from tidemark.operators import scorers


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_an_epoch_ends_with_one_row_for_each_task(spark):
    """No range sampling of the weights, and no row for each weight: an epoch is a deal, a step and a mean."""
    x = np.random.default_rng(1).standard_normal((900, 6))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    took = [jobs(spark, f"vae {n}", lambda n=n: scorers.fit_vae(df, "x", epochs=n, batch=64, least=3)) for n in (2, 6)]
    assert (took[1] - took[0]) / 4 <= 4


def test_rows_that_stand_for_several(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v), int(n)) for g in range(3) for v, n in zip(rng.integers(0, 500, 400) / 7, rng.integers(1, 90, 400))]
    df = spark.createDataFrame(rows, "g int, v double, n int")
    points = {"low": 0.01, "q": 0.37, "m": 0.5, "high": 0.99, "top": 1.0}
    for few in (False, True):
        got = {r["g"]: r for r in quantiles(df, "v", points, ["g"], "n", few).collect()}
        for g in range(3):
            long = np.repeat(*(np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2)))
            assert [got[g][p] for p in points] == pytest.approx(np.quantile(long, list(points.values())), rel=1e-14)
    plain = quantiles(df.withColumn("v", F.explode(F.array_repeat("v", F.col("n")))), "v", points).first()
    assert quantiles(df, "v", points, weight="n").first() == plain
