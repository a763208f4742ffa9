"""Ordered work on sequences of any length: rows are dealt by ranges of (key, order), so no key is one task.

What a range needs of the ones before it are a few numbers for each key in it; what it needs of the next one are a few
rows, its halo. Orders must have no ties where positions matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import LEAST, LENGTH, STRIDE
from tidemark.sources.tables import written


def positions(rows: DataFrame, key: str, order: Sequence[str], halo: int = 0) -> DataFrame:
    """Add pos (a row's place in its key, from 0), n (rows of the key), _part (its range), and _prev, the ranges before it
    whose last row is at most ``halo`` rows before the range's first, as structs (part, last).

    Rows are sorted within ranges and numbered as they stand there; ranges are counted by key, and the counts before a
    range are added up. Ranges rest on a sample, so the numbered rows are written before they are read twice.
    """
    d = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    d = written(d.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = d.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ordered = Window.partitionBy(key).orderBy("_part")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.struct(F.col("_part").alias("part"), (F.col("_before") + F.col("_n") - 1).alias("last"))
    near = F.filter(F.collect_list(last).over(ordered.rowsBetween(-halo, -1)), lambda p: p["last"] >= F.col("_before") - halo)
    parts = parts.withColumns({"n": F.sum("_n").over(Window.partitionBy(key)), "_prev": near if halo else F.array().cast("array<struct<part:int,last:bigint>>")})
    out = d.join(parts.drop("_n"), [key, "_part"])
    return out.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_first", "_before")


def with_rows_before(rows: DataFrame, key: str, order: Sequence[str], k: int) -> DataFrame:
    """The rows with pos, _to and _own: partitions by (key, _to) hold a range's rows (_own) and the k rows before it, so a
    window over them sees what one over the whole key would see of k rows back."""
    d = positions(rows, key, order)
    ends = d.groupBy(key, "_part").agg(F.min("pos").alias("_low"), F.max("pos").alias("_high"))
    after = Window.partitionBy(key).orderBy("_part").rowsBetween(1, k)
    ends = ends.withColumn("_next", F.filter(F.collect_list(F.struct("_part", "_low")).over(after), lambda q: q["_low"] - k <= F.col("_high"))).drop("_low", "_high")
    lent = F.transform(F.filter("_next", lambda q: F.col("pos") >= q["_low"] - k), lambda q: q["_part"])
    d = d.join(ends, [key, "_part"]).withColumn("_to", F.explode(F.concat(F.array("_part"), lent)))
    return d.withColumn("_own", F.col("_to") == F.col("_part")).drop("_part", "_prev", "_next", "n")


def long_sequences(rows: DataFrame, key: str, order: Sequence[str], token: Column) -> DataFrame:
    """(seq_id, pos, token) as ``sources.tables.sequences`` gives it, for keys of any size."""
    d = rows.select(F.col(key).alias("seq_id"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), token.alias("token"))
    return positions(d, "seq_id", [f"_o{i}" for i in range(len(order))]).select("seq_id", F.col("pos").cast("long").alias("pos"), "token")


def long_windows(
    rows: DataFrame, key: str, order: Sequence[str], token: Column, alphabet: list[str] | None = None, length: int = LENGTH, stride: int = STRIDE, least: int = LEAST
) -> DataFrame:
    """(seq_id, win_ix, tokens) as ``windows.sliding_windows`` gives it after ``windows.alphabet_filter``, for keys of any
    size: each range borrows the first length - 1 rows that follow it."""
    d = rows.select(F.col(key).alias("seq_id"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), token.alias("token"))
    if alphabet is not None:
        d = d.where(F.col("token").isin(alphabet))
    d = positions(d, "seq_id", [f"_o{i}" for i in range(len(order))], halo=length - 1).where(F.col("n") >= least)
    lent = F.transform(F.filter("_prev", lambda p: p["last"] >= F.col("pos") - (length - 1)), lambda p: p["part"])
    d = d.select("seq_id", "pos", "token", "n", "_part", F.explode(F.concat(F.array("_part"), lent)).alias("_to"))
    ahead = Window.partitionBy("seq_id", "_to").orderBy("pos").rowsBetween(0, length - 1)
    d = d.withColumn("tokens", F.collect_list("token").over(ahead)).where("_part = _to")
    full = (F.col("n") >= length) & (F.col("pos") % stride == 0) & (F.size("tokens") == length)
    short = (F.col("n") < length) & (F.col("pos") == 0)
    return d.where(full | short).select("seq_id", F.floor(F.col("pos") / stride).cast("long").alias("win_ix"), "tokens")


def running_max(rows: DataFrame, key: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the largest ``value`` of the key up to the row; nulls count as nothing."""
    d = written(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy(key, "_part").agg(F.max(value).alias("_m")).select(key, "_part", F.max("_m").over(before).alias("_before"))
    local = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(parts, [key, "_part"]).withColumn(out, F.greatest("_before", F.max(value).over(local))).drop("_part", "_before")


def in_intervals(windows: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Each window once, with label 1 if its time (start to stop) overlaps one or more intervals (lo to hi, ends included)
    of its key, else 0.

    Windows by their end and intervals by their beginning are one order of time; among the intervals that have begun by a
    window's end, it overlaps one if the latest of their ends is not before its start. So nothing is joined, and a key
    with many of both is dealt like any rows. Windows or intervals without a time overlap nothing.
    """
    w = windows.select(F.col(key).alias("_key"), F.col("stop").alias("_t"), F.lit(1).alias("_kind"), F.struct(*(F.col(f"`{c}`") for c in windows.columns)).alias("_w"))
    i = intervals.where("lo IS NOT NULL AND hi IS NOT NULL").select(F.col(key).alias("_key"), F.col("lo").alias("_t"), F.lit(0).alias("_kind"), F.col("hi").alias("_hi"))
    both = running_max(w.unionByName(i, allowMissingColumns=True), "_key", ["_t", "_kind"], "_hi", "_latest").where("_kind = 1")
    hit = F.coalesce(F.col("_latest") >= F.col("_w.start"), F.lit(False)) & F.col("_t").isNotNull()
    return both.select("_w.*", hit.cast("int").alias("label"))
