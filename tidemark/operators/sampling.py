"""Splits, samples, draws and the factorial design, all by portable hashes instead of random streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import row_numbers, with_room
from tidemark.functions.portable import h32
from tidemark.sources.tables import written


def cap_sample(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """At most n rows, those with the smallest hash: a sampling operator."""
    return df.withColumn("_h", h32(seed, F.col(id_col))).orderBy("_h", id_col).limit(n).drop("_h")


def split_half(df: DataFrame, by: str, id_col: str, seed: str) -> DataFrame:
    """Add split: the first half of each group in hash order is CAL (rounded down), the rest TEST.

    Rooms of equal leading bits of the hash are counted; only rows of the one room of a group that the cut goes through are
    put in order.
    """
    d = with_room(df, h32(seed, F.col(id_col)))
    rooms = d.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(by)
    upto = F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    half = F.floor(F.sum("_n").over(group) / 2)
    rooms = written(rooms.select(by, "_bucket", (half - upto + F.col("_n")).alias("_open"), F.col("_n")))
    d, open_, n = d.join(rooms, [by, "_bucket"]), F.col("_open"), F.col("_n")
    whole = d.where((open_ <= 0) | (open_ >= n)).withColumn("split", F.when(open_ > 0, "CAL").otherwise("TEST"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_key", id_col))
    cut = d.where((open_ > 0) & (open_ < n)).withColumn("split", F.when(rank <= open_, "CAL").otherwise("TEST"))
    return whole.unionByName(cut).drop("_key", "_bucket", "_open", "_n")


def pool(df: DataFrame, by: Sequence[str], id_col: str, seed: str) -> DataFrame:
    """Number the rows of each pool from 0."""
    return row_numbers(df, by, h32(seed, F.col(id_col)), [id_col]).withColumn("ix", F.col("rn") - 1).drop("rn")


def design(spark: SparkSession, trials: int) -> DataFrame:
    """All cells of attack class, noise and trial."""
    levels = lambda *xs: F.explode(F.array(*map(F.lit, xs)))
    cells = spark.range(trials).withColumn("attack_class", levels("stealthy", "loud")).withColumn("noise", levels("none", "moderate", "high"))
    return cells.select("attack_class", "noise", F.col("id").alias("trial"))


def draw(cells: DataFrame, pools: DataFrame, level: str, phase: str, slots: int, offset: int, by: Sequence[str] = ()) -> DataFrame:
    """Draw ``slots`` scores with replacement for each cell from the pool whose ``band`` is the cell's ``level``; from that
    of each of the groups ``by`` (arms, say), with the same draws for all.

    A slot's hash modulo the pool's size names the pool row, so drawing is an equi-join. An empty pool gives no rows.
    """
    sizes = pools.groupBy(*by, "band").agg(F.count("*").alias("size"))
    wanted = cells.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("band", F.col(level) if level in cells.columns else F.lit(level))
    wanted = wanted.join(F.broadcast(sizes), "band").withColumn("ix", h32(phase, F.col("attack_class"), F.col("noise"), F.col("trial"), F.col("slot")) % F.col("size"))
    return wanted.join(pools.select(*by, "band", "ix", "score"), [*by, "band", "ix"]).select(
        *by, "attack_class", "noise", "trial", (F.col("slot") + offset).cast("long").alias("pos"), F.lit(phase).alias("phase"), "score"
    )


def trial_streams(cells: DataFrame, pools: DataFrame, warm: int = 50, noise: int = 150, attack: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """The ordered streams: warm-up, then noise, then attack."""
    parts = (("none", "warm", warm, 0), ("noise", "noise", noise, warm), ("attack_class", "attack", attack, warm + noise))
    out = None
    for level, phase, slots, offset in parts:
        part = draw(cells, pools, level, phase, slots, offset, by)
        out = part if out is None else out.unionByName(part)
    return out


def token_ids(seq: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add id, a token's number in the dictionary (token, id); tokens that it lacks go, as unknown symbols do. The
    dictionary is left to Spark's size check: it is broadcast only if it is small."""
    return seq.join(dictionary.select("token", "id"), "token")


def leakage(cal: DataFrame, test: DataFrame, id_col: str) -> DataFrame:
    """One row: how many ids both splits hold, which should be none."""
    return cal.select(id_col).intersect(test.select(id_col)).agg(F.count("*").alias("shared"))
