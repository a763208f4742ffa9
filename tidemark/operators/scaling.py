"""Robust scaling fitted on normal training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import quantiles


def fit_robust(df: DataFrame, vector: str, low: float = 0.01, high: float = 0.99, weight: str | None = None) -> DataFrame:
    """One row: arrays center (median) and scale (high minus low quantile; 1 where that is 0, so rare bits survive). A row
    stands for ``weight`` rows, if given."""
    values = df.select(*([weight] if weight else []), F.posexplode(vector).alias("i", "x"))
    each = quantiles(values, "x", {"center": 0.5, "low": low, "high": high}, ["i"], weight, few=True)
    each = each.select("i", "center", (F.col("high") - F.col("low")).alias("range"))
    rows = F.array_sort(F.collect_list(F.struct("i", "center", F.when(F.col("range") == 0, 1.0).otherwise(F.col("range")).alias("scale"))))
    return each.agg(F.transform(rows, lambda r: r["center"]).alias("center"), F.transform(rows, lambda r: r["scale"]).alias("scale"))


def robust_scale(df: DataFrame, vector: str, fitted: DataFrame, out: str = "scaled") -> DataFrame:
    d = df.crossJoin(F.broadcast(fitted))
    shifted = F.zip_with(F.col(vector).cast("array<double>"), "center", lambda x, c: x - c)
    return d.withColumn(out, F.zip_with(shifted, "scale", lambda x, s: x / s)).drop("center", "scale")


def component_z(df: DataFrame, cols: Sequence[str], fit_on: DataFrame, weight: str | None = None) -> DataFrame:
    """Add z_<column>: less the median, by the interquartile range, both of ``fit_on``, whose rows stand for ``weight`` rows
    each, if given."""
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols))
    values = fit_on.select(*([weight] if weight else []), F.inline(pairs))
    each = quantiles(values, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["c"], weight, few=True)
    pick = lambda c, x: F.max(F.when(F.col("c") == c, x))
    f = each.agg(*(e for c in cols for e in (pick(c, F.col("median")).alias(f"_c_{c}"), pick(c, F.col("q3") - F.col("q1")).alias(f"_r_{c}"))))
    d = df.crossJoin(F.broadcast(f))
    z = {f"z_{c}": (F.col(c) - F.col(f"_c_{c}")) / F.when(F.col(f"_r_{c}") == 0, 1.0).otherwise(F.col(f"_r_{c}")) for c in cols}
    return d.withColumns(z).drop(*(x for c in cols for x in (f"_c_{c}", f"_r_{c}")))
