"""Threshold policies over ordered score streams.

T starts at T_op; a row is flagged by the threshold before it (strictly above), and the trace holds the one after it. A
null score is not flagged and moves nothing, under every policy. T_op and T_min are the same on all rows of a key.

A stream is cut into blocks of rows in order, and a block is one row with arrays. What a policy does to T over a block is
found for all blocks at once, starts of blocks follow from that, and the trace is a fold within each block from its start.
No task holds more of a key than its blocks in one range of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import blocks
from tidemark.operators.ranges import with_rows_before
from tidemark.sources.tables import discard, written

BETA = 0.9
#: Rows of a stream that may be gathered in one array.
GATHERED = 10_000
#: Places that a fold in order takes at most at each level.
SPAN = 512
POSITION = ["_super", "_part", "_room", "_block"]


def fixed(stream: DataFrame) -> DataFrame:
    """The threshold never moves."""
    flagged = F.coalesce(F.col("score") > F.col("T_op"), F.lit(False))
    return stream.withColumns({"T_before": F.col("T_op"), "T_after": F.col("T_op"), "flagged": flagged})


def _moved(t: Column, a: Column, t_min: Column, beta: float) -> Column:
    return F.greatest(t_min, F.lit(beta) * t + F.lit(1 - beta) * a)


def _always(t: Column, a: Column, t_min: Column, beta: float) -> Column:
    return F.when(a.isNull(), t).otherwise(_moved(t, a, t_min, beta))


def _if_not_flagged(t: Column, a: Column, t_min: Column, beta: float) -> Column:
    return F.when(a <= t, _moved(t, a, t_min, beta)).otherwise(t)


Step = Callable[[Column, Column, Column, float], Column]


def blocked(stream: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(by, position, T_op, T_min, scores, rows): the stream in blocks, written, as it is read several times."""
    d = blocks(stream, by, order)
    row = F.struct(*(F.col(f"`{c}`") for c in stream.columns if c not in by))
    packed = d.select(*by, "_part", "_block", "T_op", "T_min", F.struct("_i", "score", row.alias("row")).alias("x"))
    each = packed.groupBy(*by, "_part", "_block").agg(F.first("T_op").alias("T_op"), F.first("T_min").alias("T_min"), F.sort_array(F.collect_list("x")).alias("xs"))
    return written(each.select(
        *by, F.floor(F.col("_part") / SPAN).alias("_super"), "_part", F.floor(F.col("_block") / SPAN).alias("_room"), "_block", "T_op", "T_min",
        F.transform("xs", lambda x: x["score"].cast("double")).alias("scores"), F.transform("xs", lambda x: x["row"]).alias("rows"),
    ))


def _starts(each: DataFrame, by: list[str], then: Callable[[Column, Column], Column], none: Column, after: Callable[[Column, Column], Column]) -> DataFrame:
    """(by, position, _t): T at the start of each block, from what a block does (f) and the T_op of its key.

    What blocks do is composed room by room, then over ranges of rows, then over hundreds of ranges, so that no array has
    more than some hundred places; from the top, starts come down the same way.
    """
    level, up = each.select(*by, *POSITION, "f", F.col("T_op").alias("_t")), []
    for k in range(len(POSITION) - 1, -1, -1):
        own, outer = POSITION[k], POSITION[:k]
        level = level.groupBy(*by, *outer).agg(F.sort_array(F.collect_list(F.struct(own, "f"))).alias("fs"), F.first("_t").alias("_t"))
        up.append((own, level))
        level = level.select(*by, *outer, F.aggregate("fs", none, lambda f, x: then(f, x["f"])).alias("f"), "_t")
    found = None
    for own, level in reversed(up):
        outer = POSITION[: POSITION.index(own)]
        if found is not None:
            level = level.drop("_t").join(found, [*by, *outer])
        ts = F.aggregate("fs", F.array("_t"), lambda ts, x: F.concat(ts, F.array(after(x["f"], F.element_at(ts, -1)))))
        placed = F.zip_with("fs", F.slice(ts, 1, F.size("fs")), lambda x, t: F.struct(x[own].alias("own"), t.alias("t")))
        found = level.select(*by, *outer, F.explode(placed).alias("x")).select(*by, *outer, F.col("x.own").alias(own), F.col("x.t").alias("_t"))
    return found


def ema_starts(each: DataFrame, by: list[str], beta: float = BETA) -> DataFrame:
    """(by, position, _t) under the unconditional policy: a block as a whole is T -> max(c, b T + d)."""
    none = F.struct(F.lit(-1e300).alias("c"), F.lit(1.0).alias("b"), F.lit(0.0).alias("d"))

    def then(f: Column, g: Column) -> Column:
        return F.struct(F.greatest(g["c"], g["b"] * f["c"] + g["d"]).alias("c"), (g["b"] * f["b"]).alias("b"), (g["b"] * f["d"] + g["d"]).alias("d"))

    def step(f: Column, a: Column) -> Column:
        return then(f, F.struct(F.col("T_min").cast("double").alias("c"), F.lit(beta).alias("b"), (F.lit(1 - beta) * a).alias("d")))

    own = each.withColumn("f", F.aggregate(F.filter("scores", lambda a: a.isNotNull()), none, step))
    return _starts(own, by, then, none, lambda f, t: F.greatest(f["c"], f["b"] * t + f["d"]))


def conditional_ends(each: DataFrame, by: list[str], beta: float = BETA) -> tuple[DataFrame, int]:
    """(by, position, start, end) under the conditional policy, and in how many rounds they were found.

    A step is T -> min(T, max(T_min, beta T + (1 - beta) score)): monotone, and T never rises. All blocks are folded from
    a bound of their start at once, first T_op; then a start is at most the least end of the blocks before it, and blocks
    whose start has come down are folded again until none has. T_min is absorbing: a block that starts there ends there,
    so once a block comes down to it, none after it is folded again. The worst case is a round for each block; a stream
    that settles takes a few.
    """
    slim = written(each.select(*by, *POSITION, F.col("T_op").cast("double").alias("T_op"), F.least("T_op", "T_min").cast("double").alias("low"),
                               F.filter("scores", lambda a: a <= F.col("T_op")).alias("scores")))
    fold = lambda start: F.aggregate("scores", start, lambda t, a: _if_not_flagged(t, a, F.col("low"), beta))
    state = written(slim.select(*by, *POSITION, "T_op", "low", F.col("T_op").alias("start"), fold(F.col("T_op")).alias("end")))
    rounds = 1
    while True:
        before = lambda own, *outer: Window.partitionBy(*by, *outer).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
        parts = state.groupBy(*by, "_part").agg(F.min("end").alias("_end")).withColumn("_least", F.min("_end").over(before("_part"))).drop("_end")
        down = state.join(parts, [*by, "_part"]).withColumn("_new", F.least("T_op", "_least", F.min("end").over(before("_block", "_part")))).drop("_least")
        moved = F.col("_new") < F.col("start")
        floor = F.col("_new") <= F.col("low")
        down = written(down.withColumn("open", moved & ~floor).withColumn("end", F.when(moved & floor, F.col("low")).otherwise(F.col("end"))).withColumn("start", F.col("_new")).drop("_new"))
        discard(state)
        if down.where("open").isEmpty():
            discard(slim)
            return down.drop("open", "T_op", "low"), rounds
        again = slim.drop("T_op", "low").join(down.where("open").drop("end"), [*by, *POSITION]).select(*by, *POSITION, "T_op", "low", "start", fold(F.col("start")).alias("end"))
        state = written(down.where("NOT open").select(*again.columns).unionByName(again))
        discard(down)
        rounds += 1


def _trail(step: Step, t_min: Column, beta: float) -> Callable[[Column, Column], Column]:
    return lambda ts, a: F.concat(ts, F.array(step(F.element_at(ts, -1), a, t_min, beta)))


def _traced(each: DataFrame, by: list[str], starts: dict[str, Column], steps: dict[str, Step], beta: float) -> DataFrame:
    """The rows again, with <name>0 and <name>1, T before and after them, for each policy: a fold within the block."""
    low = F.least("T_op", "T_min").cast("double")
    d = each
    for name, step in steps.items():
        t_min = low if step is _if_not_flagged else F.col("T_min").cast("double")
        d = d.withColumn(f"_{name}", F.aggregate("scores", F.array(starts[name].cast("double")), _trail(step, t_min, beta)))
    last = F.size("rows")
    zipped = F.arrays_zip("rows", *(x.alias(f"{n}{k}") for n in steps for k, x in ((0, F.slice(f"_{n}", 1, last)), (1, F.slice(f"_{n}", 2, last)))))
    flat = d.select(*by, F.explode(zipped).alias("_x"))
    return flat.select(*by, "_x.rows.*", *(F.col(f"_x.{n}{k}") for n in steps for k in (0, 1)))


def policies(stream: DataFrame, by: Sequence[str], order: Sequence[str], beta: float = BETA) -> DataFrame:
    """Both moving policies and the fixed one on the same rows: u0, u1 (unconditional, before and after), c0, c1
    (conditional), and f_fixed, f_uncond, f_cond."""
    by = list(by)
    each = blocked(stream, by, order)
    starts = ema_starts(each, by, beta).withColumnRenamed("_t", "_u").join(conditional_ends(each, by, beta)[0].select(*by, *POSITION, F.col("start").alias("_c")), [*by, *POSITION])
    d = each.join(starts.withColumnsRenamed({"_u": "_ut", "_c": "_ct"}), [*by, *POSITION])
    return _flagged(_traced(d, by, {"u": F.col("_ut"), "c": F.col("_ct")}, {"u": _always, "c": _if_not_flagged}, beta))


def gathered_policies(stream: DataFrame, by: Sequence[str], order: Sequence[str], beta: float = BETA, most: int = GATHERED) -> DataFrame:
    """As ``policies``, for streams that are short by design, such as trials: a stream is one array, gathered by one
    shuffle. A stream of more than ``most`` rows is an error."""
    by = list(by)
    row = F.struct(*(F.col(f"`{c}`") for c in stream.columns if c not in by))
    each = stream.groupBy(*by).agg(F.first("T_op").alias("T_op"), F.first("T_min").alias("T_min"), F.sort_array(F.collect_list(F.struct(*order, row.alias("row")))).alias("xs"))
    fits = F.when(F.size("xs") <= most, F.col("xs")).otherwise(F.raise_error(F.lit(f"a gathered stream has more than {most} rows")))
    each = each.withColumn("xs", fits).select(*by, "T_op", "T_min", F.transform("xs", lambda x: x["row"]["score"].cast("double")).alias("scores"), F.transform("xs", lambda x: x["row"]).alias("rows"))
    return _flagged(_traced(each, by, {"u": F.col("T_op"), "c": F.col("T_op")}, {"u": _always, "c": _if_not_flagged}, beta))


def _flagged(d: DataFrame) -> DataFrame:
    above = lambda t: F.coalesce(F.col("score") > F.col(t), F.lit(False))
    return d.withColumns({"f_fixed": above("T_op"), "f_uncond": above("u0"), "f_cond": above("c0")})


def _one(d: DataFrame, name: str) -> DataFrame:
    flagged = F.coalesce(F.col("score") > F.col("T_before"), F.lit(False))
    return d.withColumnsRenamed({f"{name}0": "T_before", f"{name}1": "T_after"}).withColumn("flagged", flagged)


def ema(stream: DataFrame, by: Sequence[str], order: Sequence[str], beta: float = BETA) -> DataFrame:
    """T' = max(T_min, beta T + (1 - beta) score) on every row: adds T_before, T_after, flagged."""
    by = list(by)
    each = blocked(stream, by, order)
    d = each.join(ema_starts(each, by, beta), [*by, *POSITION])
    return _one(_traced(d, by, {"u": F.col("_t")}, {"u": _always}, beta), "u")


def ema_conditional(stream: DataFrame, by: Sequence[str], order: Sequence[str], beta: float = BETA) -> DataFrame:
    """As ``ema``, but flagged rows do not move T."""
    by = list(by)
    each = blocked(stream, by, order)
    ends, _ = conditional_ends(each, by, beta)
    d = each.join(ends.select(*by, *POSITION, F.col("start").alias("_t")), [*by, *POSITION])
    return _one(_traced(d, by, {"c": F.col("_t")}, {"c": _if_not_flagged}, beta), "c")


def conditional_floor(stream: DataFrame, by: Sequence[str], order: Sequence[str], beta: float = BETA) -> DataFrame:
    """(by, T_final): where the conditional threshold ends; as it never rises, that is the lowest it comes to."""
    by = list(by)
    return conditional_ends(blocked(stream, by, order), by, beta)[0].groupBy(*by).agg(F.min("end").alias("T_final"))


def ema_capped(stream: DataFrame, by: Sequence[str], order: Sequence[str], cap: float, beta: float = BETA) -> DataFrame:
    """(by, T_final) of the unconditional policy with a ceiling of ``cap`` times T_op.

    A step is T -> min(h, max(c, b T + d)), and so is what any rows in a row do: each level hands the next four numbers.
    """
    by = list(by)
    top = cap * F.col("T_op")
    step = F.struct(top.alias("h"), F.least("T_min", top).alias("c"), F.lit(beta).alias("b"), (F.lit(1 - beta) * F.col("score")).alias("d"))
    none = F.struct(F.lit(1e300).alias("h"), F.lit(-1e300).alias("c"), F.lit(1.0).alias("b"), F.lit(0.0).alias("d"))
    keep = F.when(F.col("score").isNull(), none).otherwise(step)
    d = blocks(stream, by, order)
    level = d.select(*by, F.floor(F.col("_part") / SPAN).alias("_super"), "_part", F.floor(F.col("_block") / SPAN).alias("_room"), "_block", "_i", keep.alias("f"), F.col("T_op").alias("t"))

    def then(f: Column, x: Column) -> Column:
        g = x["f"]
        clamp = lambda y: F.least(g["h"], F.greatest(g["c"], g["b"] * y + g["d"]))
        return F.struct(clamp(f["h"]).alias("h"), clamp(f["c"]).alias("c"), (g["b"] * f["b"]).alias("b"), (g["b"] * f["d"] + g["d"]).alias("d"))

    places = [*POSITION, "_i"]
    for k in range(len(places) - 1, -1, -1):
        ordered = F.sort_array(F.collect_list(F.struct(places[k], "f")))
        level = level.groupBy(*by, *places[:k]).agg(ordered.alias("fs"), F.first("t").alias("t")).select(*by, *places[:k], F.aggregate("fs", none, then).alias("f"), "t")
    f = F.col("f")
    return level.select(*by, F.least(f["h"], F.greatest(f["c"], f["b"] * F.col("t") + f["d"])).alias("T_final"))


def median_threshold(stream: DataFrame, by: Sequence[str], order: Sequence[str], k: int = 15) -> DataFrame:
    """T before a row is the median of the k scores before it, T_op where there are none, T_min at least. Ranges of rows
    borrow the k rows before them, so no key is one task."""
    row = F.struct(*(F.col(f"`{c}`") for c in stream.columns))
    d = stream.select(F.struct(*by).alias("_key"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), row.alias("_row"))
    d = with_rows_before(d, "_key", [f"_o{i}" for i in range(len(order))], k).select("_key", "_to", "_own", "pos", F.col("_row.score").alias("_score"), "_row")
    back = Window.partitionBy("_key", "_to").orderBy("pos").rowsBetween(-k, -1)
    d = d.withColumn("_median", F.expr("percentile(_score, 0.5D)").over(back)).where("_own").select("_row.*", "_median")
    d = d.withColumn("T_before", F.greatest("T_min", F.coalesce("_median", "T_op"))).drop("_median")
    return d.withColumn("flagged", F.coalesce(F.col("score") > F.col("T_before"), F.lit(False)))


def at_attack(t: str, order: str) -> Column:
    """An aggregate: the threshold that the first attack row meets."""
    return F.min_by(t, F.when(F.col("phase") == "attack", F.col(order)))


def settling(trace: DataFrame, by: Sequence[str], order: str, target: str, rest: float = 0.1) -> DataFrame:
    """(by, settled): first position at which less than ``rest`` of the way from T_op to ``target`` is left."""
    left = F.abs(F.col("T_after") - F.col(target)) <= rest * F.abs(F.col("T_op") - F.col(target))
    return trace.groupBy(*by).agg(F.min(F.when(left, F.col(order))).alias("settled"))
