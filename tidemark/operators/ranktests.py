"""Rank tests over trial-level frames: a row is a trial, never a window of one, which would inflate the sample.

Rows with a null value take no part. Statistics are exact. Tail probabilities are closed forms where exact, else normal approximations, and named so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.ordered import average_ranks, running
from tidemark.functions.portable import h32


@F.udf(DoubleType())
def upper_tail(z: float) -> float:
    """P(Z >= z) of a standard normal; runs on the one row of a result."""
    return None if z is None else 0.5 * math.erfc(z / math.sqrt(2))


def chi_square_tail(h: Column, df: Column) -> Column:
    """P(X >= h) of a chi-square with a whole number of degrees: the upper incomplete gamma function is a finite sum then,
    of df / 2 terms, and for odd degrees what a normal has beyond the root of h."""
    x, odd = h / 2, df % 2 == 1
    # Terms x**a / gamma(a + 1) for a = 0, 1, ... or 1/2, 3/2, ...: each is the one before it times x / a.
    first = F.when(odd, 2 * F.sqrt(x / F.pi())).otherwise(1.0)
    more = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((df - F.when(odd, 1).otherwise(0)) / 2).cast("int")))
    half = F.when(odd, 0.5).otherwise(0.0)
    pair = lambda term, total: F.struct(term.cast("double").alias("term"), total.cast("double").alias("total"))
    summed = F.aggregate(more, pair(first, F.lit(0.0)), lambda s, k: pair(s["term"] * x / (k + half), s["total"] + s["term"]))["total"]
    return F.when(odd, 2 * upper_tail(F.sqrt(h)) + F.when(df > 1, F.exp(-x) * summed).otherwise(0.0)).otherwise(F.exp(-x) * summed)


def _tie_sum() -> Column:
    """What ties take off, in doubles: the cube of a count is beyond a long from some two million on."""
    ties = F.col("ties").cast("double")
    return F.sum(ties * ties * ties - ties)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(h, df, p): tie-corrected H over any number of groups, its degrees, and its chi-square tail. Null without values or
    where all are tied."""
    df = df.where(F.col(value).isNotNull())
    ranks = average_ranks(df, value)
    r = df.join(ranks, value).groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    total = r.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("n"), (F.count("*") - 1).cast("int").alias("df"))
    ties = ranks.agg(_tie_sum().alias("t"))
    n = F.col("n").cast("double")  # its cube is beyond a long from some two million rows on
    raw = 12.0 / F.nullif(n * (n + 1), F.lit(0)) * F.col("s") - 3 * (n + 1)
    correction = 1 - F.col("t") / F.nullif(n * n * n - n, F.lit(0))
    h = total.crossJoin(ties).select((raw / F.nullif(correction, F.lit(0.0))).alias("h"), "df")
    return h.select("h", "df", F.when(F.col("df") > 0, chi_square_tail(F.col("h"), F.col("df"))).alias("p"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n, p_normal): correlation of average ranks; two-sided, of rho * sqrt(n - 1)."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = df.join(average_ranks(df, x).select(x, F.col("rank").alias("_rx")), x).join(average_ranks(df, y).select(y, F.col("rank").alias("_ry")), y)
    r = d.agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))
    return r.withColumn("p_normal", 2 * upper_tail(F.abs("rho") * F.sqrt(F.col("n") - 1.0)))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(w, n, p_normal): sum of ranks of positive differences, zeros dropped; one-sided, tie-corrected."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ranks = average_ranks(d, "m")
    w = d.join(ranks, "m").agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w"), F.count("*").alias("n"))
    t = ranks.agg(_tie_sum().alias("t"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48.0)
    return w.crossJoin(t).withColumn("z", (F.col("w") - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).select("w", "n", upper_tail("z").alias("p_normal"))


def mann_whitney(df: DataFrame, group: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, u): how often a value of a exceeds one of b, ties one half."""
    out = None
    for a, b in pairs:
        c = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.sum((F.col(group) == a).cast("long")).alias("p"), F.sum((F.col(group) == b).cast("long")).alias("n"))
        c = running(c, value, ["n"])
        one = c.agg(F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2.0)).alias("u")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "u")
        out = one if out is None else out.unionByName(one)
    return out


def jonckheere(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """(j): the trend statistic, Mann-Whitney counts over ordered pairs of levels."""
    pairs = [(order[j], order[i]) for i in range(len(order)) for j in range(i + 1, len(order))]
    return mann_whitney(df, group, value, pairs).agg(F.sum("u").alias("j"))


def bootstrap_ci(df: DataFrame, by: list[str], ix: str, value: str, reps: int, seed: str) -> DataFrame:
    """(by, mean, lo, hi): percentile interval of the mean; ``ix`` numbers each group's rows from 0.

    A draw is an equi-join on the drawn number. Groups are trials of a cell, so reps times rows stays small.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(value).alias("mean"))
    draws = n.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_slot", F.explode(F.expr("sequence(0L, _n - 1)")))
    draws = draws.withColumn(ix, h32(seed, *(F.col(c) for c in by), F.col("_rep"), F.col("_slot")) % F.col("_n"))
    means = draws.join(df.select(*by, ix, value), [*by, ix]).groupBy(*by, "_rep").agg(F.avg(value).alias("_m"))
    ci = means.groupBy(*by).agg(F.expr("percentile(_m, 0.025D)").alias("lo"), F.expr("percentile(_m, 0.975D)").alias("hi"))
    return n.join(ci, by).select(*by, "mean", "lo", "hi")


#: 65,536 times the chance that a Poisson(1) variable is at most 0, 1, 2, ...: what a 16-bit draw is held against.
_POISSON = [round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def poisson_bootstrap(df: DataFrame, by: list[str], ids: list[str], value: str, reps: int, seed: str) -> DataFrame:
    """(by, mean, lo, hi): percentile interval of the mean for groups of any size, rows told apart by ``ids``.

    Every row has in every replicate a weight that is Poisson(1), drawn from a hash, as if rows were drawn with
    replacement; eight weights come of one digest. Replicates are sums of weights and of weighted values, added up where
    the rows are, so nothing is numbered or joined and a group's rows never meet. Nulls take no part.
    """
    d = df.where(F.col(value).isNotNull()).select(*by, *ids, F.col(value).cast("double").alias("_v")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(-(-reps // 8) - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in (*by, *ids)), F.col("_c").cast("string")).cast("binary"))
    d = d.withColumn("_d", digest)
    draws = [F.conv(F.substring("_d", 4 * k + 1, 4), 16, 10).cast("int") for k in range(8)]
    weights = [sum((F.when(u >= t, 1).otherwise(0) for t in _POISSON), F.lit(0)) for u in draws]
    d = d.withColumns({f"_w{k}": w for k, w in enumerate(weights)})
    sums = d.groupBy(*by, "_c").agg(*(x for k in range(8) for x in (F.sum(f"_w{k}").alias(f"_n{k}"), F.sum(F.col(f"_w{k}") * F.col("_v")).alias(f"_s{k}"))))
    each = F.explode(F.array(*(F.struct((F.col("_c") * 8 + k).alias("rep"), F.col(f"_n{k}").alias("n"), F.col(f"_s{k}").alias("s")) for k in range(8))))
    means = sums.select(*by, each.alias("x")).where((F.col("x.rep") < reps) & (F.col("x.n") > 0)).select(*by, (F.col("x.s") / F.col("x.n")).alias("_m"))
    ci = means.groupBy(*by).agg(F.expr("percentile(_m, 0.025D)").alias("lo"), F.expr("percentile(_m, 0.975D)").alias("hi"))
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).join(ci, by).select(*by, "mean", "lo", "hi")


def one_row_per_trial(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, one for each trial; fails when a trial has several, as frames of windows do."""
    others = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*others)).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("a trial has several rows")))
    return one.select(*keys, checked.alias("_row")).select(*keys, "_row.*")


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, r): least squares of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("r"))
