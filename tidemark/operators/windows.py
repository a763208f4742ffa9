"""Filters and count-based windows over sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LENGTH, STRIDE, LEAST = 10, 2, 5


def alphabet_filter(seq: DataFrame, alphabet: list[str]) -> DataFrame:
    """Keep tokens of the alphabet and number what is left anew. This comes before windows and changes them."""
    kept = seq.where(F.col("token").isin(alphabet))
    return kept.withColumn("pos", (F.row_number().over(Window.partitionBy("seq_id").orderBy("pos")) - 1).cast("long"))


def min_length(seq: DataFrame, least: int = LEAST) -> DataFrame:
    """Keep sequences of ``least`` tokens or more, with their length n."""
    return seq.withColumn("n", F.count("*").over(Window.partitionBy("seq_id"))).where(F.col("n") >= least)


def sliding_windows(seq: DataFrame, length: int = LENGTH, stride: int = STRIDE, least: int = LEAST) -> DataFrame:
    """(seq_id, win_ix, tokens): full windows every ``stride`` tokens; a shorter sequence is one window.

    Rows stay rows until a window is made, so a sequence may be as long as it likes.
    """
    ahead = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(0, length - 1)
    rows = min_length(seq, least).withColumn("tokens", F.collect_list("token").over(ahead))
    full = (F.col("n") >= length) & (F.col("pos") % stride == 0) & (F.size("tokens") == length)
    short = (F.col("n") < length) & (F.col("pos") == 0)
    return rows.where(full | short).select("seq_id", (F.col("pos") / stride).cast("long").alias("win_ix"), "tokens")


def window_grid(seq: DataFrame, grid: list[tuple[int, int]], least: int = LEAST) -> DataFrame:
    """(length, stride, seq_id, n_windows): how many windows each geometry gives."""
    sizes = seq.groupBy("seq_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    shapes = F.explode(F.array(*(F.struct(F.lit(a).alias("length"), F.lit(b).alias("stride")) for a, b in grid)))
    wide = sizes.withColumn("g", shapes).select("g.length", "g.stride", "seq_id", "n")
    count = F.when(F.col("n") >= F.col("length"), F.floor((F.col("n") - F.col("length")) / F.col("stride")) + 1).otherwise(1)
    return wide.select("length", "stride", "seq_id", count.cast("long").alias("n_windows"))


def drop_warmup(rows: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Leave out what falls within ``seconds`` of a key's first row. First times are aggregated and joined back, so a large
    key may be split; rows without a key or a time go."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    first = rows.groupBy(key).agg(F.min(us).alias("_first"))
    return rows.join(first, key).where(us - F.col("_first") >= seconds * 1_000_000).select(*rows.columns)
