"""Ranks and running sums over a whole table without bringing it to one task.

Rows are dealt into ordered buckets; sums of buckets are few and are added up on their own; within a bucket a window
does the rest. Each function works within groups ``by`` too, however uneven they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import written

#: Least leading bits of a 32-bit hash that make a bucket, and least buckets for running sums over a measured key. There
#: are as many as the session has shuffle partitions, if that is more, so that both grow with what a user runs.
HASH_BITS, BUCKETS = 10, 64
#: Rows in a block of an ordered stream.
BLOCK = 256


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_room(df: DataFrame, key: Column) -> DataFrame:
    """Add _key, a 32-bit hash, and _bucket, the room of its leading bits."""
    bits = max(HASH_BITS, (_parts(df) - 1).bit_length())
    return df.withColumn("_key", key).withColumn("_bucket", F.shiftright("_key", 32 - bits))


def row_numbers(df: DataFrame, by: Sequence[str], key: Column, ties: Sequence[str], name: str = "rn") -> DataFrame:
    """Number rows from 1 within ``by`` in the order of a 32-bit hash, then ``ties``."""
    d = with_room(df, key)
    before = _before(d.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")), by, ["_n"])
    local = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key", *ties))
    return d.join(before, [*by, "_bucket"]).withColumn(name, F.col("_before__n") + local).drop("_key", "_bucket", "_before__n")


def running(df: DataFrame, key: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add cum_<column>: the sum over rows of the group with a key up to and including the own. Keys are distinct."""
    n = max(BUCKETS, _parts(df))
    bounds = df.groupBy(*by).agg(F.percentile_approx(key, [i / n for i in range(1, n)], 30 * n).alias("_bounds"))
    d = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    d = d.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(key)))).drop("_bounds")
    before = _before(d.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(c) for c in sums)), by, sums)
    local = Window.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(before, [*by, "_bucket"])
    return d.withColumns({f"cum_{c}": F.col(f"_before_{c}") + F.sum(c).over(local) for c in sums}).drop("_bucket", *(f"_before_{c}" for c in sums))


def _before(sums: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select(*by, "_bucket", *((F.sum(c).over(upto) - F.col(c)).alias(f"_before_{c}") for c in cols))


def average_ranks(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, ties, rank): the average rank of each distinct value of ``key``."""
    n = df.groupBy(*by, key).agg(F.count("*").alias("ties"))
    return running(n, key, ["ties"], by).withColumn("rank", F.col("cum_ties") - (F.col("ties") - 1) / 2.0).drop("cum_ties")


def quantiles(df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = (), weight: str | None = None, few: bool = False) -> DataFrame:
    """(by, one column for each point): exact quantiles, linear between neighbours; nulls take no part.

    Distinct values are counted and dealt into ordered rooms, whose counts tell which rooms hold the wanted ranks. Only those
    are put in order, so no task holds the values of a group, and what is sorted is some shares of the whole. A row stands
    for ``weight`` rows, if given, a whole number above 0; ``few`` says that the groups are few, so that their bounds may be
    broadcast.
    """
    times = F.sum(weight) if weight else F.count("*")
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(times.alias("n")))
    n = max(BUCKETS, _parts(df))
    shares = [i / n for i in range(1, n)]
    # A sketch is another one whenever it is made, and all steps must see the same rooms: it is written.
    bounds = written(counts.groupBy(*by).agg(F.percentile_approx("_v", shares, 8 * n).alias("_bounds"), F.sum("n").alias("_total")))
    small = F.broadcast if few or not by else lambda d: d
    d = counts.join(small(bounds), list(by)) if by else counts.crossJoin(small(bounds))
    d = d.withColumn("_bucket", _below("_bounds", F.col("_v"), n)).drop("_bounds")
    rooms = d.groupBy(*by, "_bucket").agg(F.sum("n").alias("_n"), F.first("_total").alias("_total"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rooms = rooms.withColumn("_before__n", F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    ranks = {}
    for name, q in points.items():
        at = F.lit(q) * (F.col("_total") - 1)
        ranks |= {f"{name}_low": F.floor(at), f"{name}_high": F.ceil(at)}
    first, held = F.col("_before__n"), lambda r: (F.col("_before__n") <= r) & (r < F.col("_before__n") + F.col("_n"))
    wanted = rooms.where(reduce(or_, map(held, ranks.values()))).select(*by, "_bucket", first)
    upto = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    c = d.join(small(wanted), [*by, "_bucket"]).withColumn("cum_n", first + F.sum("n").over(upto))
    ends = {name: F.min(F.when(F.col("cum_n") > rank, F.col("_v"))) for name, rank in ranks.items()}
    found = c.groupBy(*by).agg(F.first("_total").alias("_total"), *(x.alias(n) for n, x in ends.items()))
    found = found.withColumns({f"{n}_share": F.lit(q) * (F.col("_total") - 1) % 1 for n, q in points.items()})
    return found.select(*by, *(_between(*(F.col(f"{n}_{e}") for e in ("low", "high", "share"))).alias(n) for n in points))


def _below(bounds: str, value: Column, n: int) -> Column:
    """How many of fewer than ``n`` ordered bounds are smaller than the value, by halving."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, (n - 1).bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) < value, step).otherwise(0))


def _between(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share, the first product and the sum rounded once, as a fused multiply-add does and the SQL
    twins with it: where values lie on a whisker or a threshold, the last bit tells.

    The product's error is taken from halves of the factors (Dekker), the sum's from its parts (Knuth). Infinite or huge
    values have no such halves, and get the plain sum.
    """
    a, b, c = low, 1 - share, high * share
    p, s = a * b, a * b + c
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    of_p = ah * bh - p + ah * bl + al * bh + al * bl
    of_s = p - (s - (s - p)) + (c - (s - p))
    exact = s + (of_s + of_p)
    return F.when(share == 0, low).when(F.isnan(exact), s).otherwise(exact)


def _halves(x: Column) -> tuple[Column, Column]:
    wide = 134217729.0 * x
    high = wide - (wide - x)
    return high, x - high


def blocks(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut each group's ordered rows into blocks: adds _part, _block and _i, the row's place in its block from 0.

    Rows are dealt by ranges of (by, order) and numbered within a range only, so a group of any size spreads over
    tasks; (_part, _block) is the order of blocks. Ranges rest on a sample: write the result before it is read twice.
    """
    d = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    n = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return d.withColumn("_i", n).withColumns({"_block": F.floor(F.col("_i") / BLOCK), "_i": F.col("_i") % BLOCK})
