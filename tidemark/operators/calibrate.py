"""Calibration quantiles and the score bands that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import quantiles

#: name -> quantile of benign calibration scores.
POINTS = {"T0": 0.995, "T_op": 0.95, "T_min": 0.5, "bp50": 0.5, "bp90": 0.9, "bp999": 0.999}


def calibrate(benign: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each group) with the exact quantiles, linear between points."""
    return quantiles(benign, "score", POINTS, by)


def with_params(scores: DataFrame, params: DataFrame) -> DataFrame:
    """Attach the one row of parameters to every row."""
    return scores.crossJoin(F.broadcast(params))


def noise_band(scores: DataFrame) -> DataFrame:
    """none <= p50 < moderate <= p90 < high."""
    s = F.col("score")
    return scores.withColumn("band", F.when(s <= F.col("bp50"), "none").when(s <= F.col("bp90"), "moderate").otherwise("high"))


def attack_band(scores: DataFrame) -> DataFrame:
    """Keep scores above T_op: stealthy <= p99.9 < loud."""
    s = F.col("score")
    return scores.where(s > F.col("T_op")).withColumn("band", F.when(s <= F.col("bp999"), "stealthy").otherwise("loud"))


def warm_pool(scores: DataFrame) -> DataFrame:
    """Benign scores up to p50."""
    return scores.where(F.col("score") <= F.col("bp50"))


def pools(test: DataFrame, params: DataFrame) -> DataFrame:
    """Benign scores by noise band and attack scores by attack band."""
    d = with_params(test, params)
    return noise_band(d.where("label = 'benign'")).unionByName(attack_band(d.where("label = 'attack'")))
