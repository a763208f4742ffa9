"""Quality metrics. Curves come from counts per distinct score, never from one task that sorts all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import quantiles, running


def rate(hit: Column) -> Column:
    """Share of rows where ``hit`` holds."""
    return F.avg(hit.cast("double"))


def confusion(flagged: Column, positive: Column) -> dict[str, Column]:
    both = (flagged & positive).cast("long")
    return {"tp": F.sum(both), "fp": F.sum((flagged & ~positive).cast("long")), "fn": F.sum((~flagged & positive).cast("long"))}


def precision_recall_f1(df: DataFrame, flagged: Column, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    d = df.groupBy(*by).agg(*(c.alias(n) for n, c in confusion(flagged, positive).items()))
    return d.select(
        *by, F.expr("try_divide(tp, tp + fp)").alias("precision"), F.expr("try_divide(tp, tp + fn)").alias("recall"), F.expr("try_divide(2 * tp, 2 * tp + fp + fn)").alias("f1")
    )


def curve(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """For each distinct score: p and n (positives and negatives with it), tp and fp (at or above it), n_pos and n_neg."""
    c = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("n"))
    c = running(c, "s", ["p", "n"], by)
    total = c.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    c = c.join(total, list(by)) if by else c.crossJoin(F.broadcast(total))
    return c.withColumns({"tp": F.col("n_pos") - F.col("cum_p") + F.col("p"), "fp": F.col("n_neg") - F.col("cum_n") + F.col("n"), "below": F.col("cum_n") - F.col("n")})


def auc(curve_: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; ties count one half."""
    return curve_.groupBy(*by).agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)) / F.nullif(F.first("n_pos") * F.first("n_neg"), F.lit(0))).alias("auc"))


def average_precision(curve_: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_.groupBy(*by).agg(F.sum(F.col("p") / F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("ap"))


def recall_at_fpr(curve_: DataFrame, limits: Sequence[float]) -> DataFrame:
    """(fpr_limit, recall): the best recall whose false-positive rate stays within each limit."""
    wide = curve_.withColumn("fpr_limit", F.explode(F.array(*map(F.lit, limits))))
    return wide.groupBy("fpr_limit").agg(F.coalesce(F.max(F.when(F.col("fp") / F.col("n_neg") <= F.col("fpr_limit"), F.col("tp") / F.col("n_pos"))), F.lit(0.0)).alias("recall"))


def box(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, extremes, and whiskers at the outermost values within 1.5 interquartile ranges."""
    q = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}, by)
    d = df.select(*by, value).join(q, list(by))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return d.groupBy(*by, "q1", "median", "q3", "low", "high").agg(
        F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("whisker_low"), F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("whisker_high")
    )


def histogram(df: DataFrame, value: str, low: float, width: float, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.floor((F.col(value) - low) / width).alias("bin")).agg(F.count("*").alias("n"))
