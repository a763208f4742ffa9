"""The live detector: count windows, features, thresholds and alerts per key over a stream of events.

Batch and stream share the expressions of features and the policies of thresholds. Event time must be a TIMESTAMP with
zone. Rows may arrive in any order: they wait in state, by buckets of keys and slots of event time, until the watermark
has passed a slot; a timer then releases it, by key in order of (ts, id), so what the detector sees is in order across batches too. A
row whose time the watermark has passed when it arrives is late: it moves nothing and leaves by the side, marked ``late``,
so that it can be counted by key. A run over any deliveries thus equals the batch operators over the rows that were in time.

A key that is silent for longer than ``idle`` begins anew, with T_op and its warm-up, and a timer frees its state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tidemark.operators import thresholds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds of event time that are released together.
SLOT = 3_600_000
#: Buckets that keys are dealt into by a hash; the state of a bucket's keys lies together. A checkpoint holds for one number.
BUCKETS = 256
WINDOW_OUT = "key string, ts timestamp, id long, win_ix long, tokens array<string>, late boolean"
POLICY_OUT = (
    "key string, ts timestamp, id long, label string, score double, t_uncond double, t_cond double, f_fixed boolean, f_uncond boolean,"
    " f_cond boolean, warm boolean, late boolean"
)


def use_rocksdb(spark: SparkSession) -> None:
    """Processors with state need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def event_stream(spark: SparkSession, path: str, schema: StructType, late: str = "1 day", per_batch: int = 1000) -> DataFrame:
    """Files of events as a stream with a watermark; a file counts once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def keyed(rows: DataFrame, *cols: str) -> DataFrame:
    """Add key, of several columns such as (namespace, pod): a JSON array of their values, so no two of them share one."""
    return rows.withColumn("key", F.to_json(F.array(*(F.col(c).cast("string") for c in cols)), {"ignoreNullFields": "false"}))


class InOrder(StatefulProcessor):
    """Hands rows to ``released`` key by key in order of event time, and late ones to ``aside``.

    A group is a bucket of keys, so what a batch asks of the state is a few calls for each bucket, however many keys there
    are. ``fields`` are the columns besides key, us (event time in microseconds) and id that wait with a row, ``memory``
    what is kept of a key besides the time of its last row, ``columns`` those of the result.
    """

    fields: dict = {}
    memory: dict = {}
    columns: list[str] = []

    def __init__(self, slot: int = SLOT, idle: float | None = None):
        self.slot, self.idle = slot, None if idle is None else round(idle * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        arrays = lambda types: StructType([StructField(n, ArrayType(t)) for n, t in types.items()])
        self.handle = handle
        waiting = {"key": StringType(), "us": LongType(), "id": LongType(), **self.fields}
        self.names = list(waiting)
        self.waiting = handle.getMapState("waiting", StructType([StructField("slot", LongType())]), arrays(waiting))
        self.state = handle.getValueState("memory", arrays({"key": StringType(), "last": LongType(), **self.memory}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for b in rows:
            late = b["us"] <= passed
            if late.any():
                yield self.aside(b[late])
            b = b[~late]
            for at, new in b.groupby(b["us"] // (self.slot * 1000)):
                at = int(at)
                old = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
                if old is None:
                    self.handle.registerTimer((at + 1) * self.slot)
                self.waiting.updateValue((at,), tuple((list(old[i]) if old else []) + _plain(new[n]) for i, n in enumerate(self.names)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        # The first of the timers that a batch has let expire releases all the slots that the watermark has passed.
        ready = sorted(at for (at,) in self.waiting.keys() if (at + 1) * self.slot <= passed)
        if not ready and self.idle is None or not ready and not self.state.exists():
            return
        keys = {k: tuple(m) for k, *m in zip(*self.state.get(), strict=True)} if self.state.exists() else {}
        out: dict[str, list] = {n: [] for n in self.columns if n != "late"}
        if ready:
            slots = [pd.DataFrame(dict(zip(self.names, map(list, self.waiting.getValue((at,))), strict=True)), dtype=object) for at in ready]
            for at in ready:
                self.waiting.removeKey((at,))
            rows = pd.concat(slots, ignore_index=True).astype({"us": "int64", "id": "int64"}).sort_values(["key", "us", "id"], ignore_index=True)
            self._in_turn(rows, keys, out)
        if self.idle is not None:
            # Rows of the slot that the watermark stands in still wait: time is up to its beginning.
            upto = passed // self.slot * self.slot * 1000
            for k in [k for k, m in keys.items() if m[0] + self.idle <= upto]:
                last, *memory = keys.pop(k)
                self.ended(k, last, memory, out)
            for due in {-(-(m[0] + self.idle) // (self.slot * 1000)) * self.slot for m in keys.values()} if ready else ():
                self.handle.registerTimer(due)
        if keys:
            self.state.update(tuple(map(list, zip(*((k, *m) for k, m in keys.items()), strict=True))))
        else:
            self.state.clear()
        if out["key"]:
            made = pd.DataFrame({**out, "late": False}, columns=self.columns)
            yield made.assign(ts=_times(made["ts"]))

    def _in_turn(self, rows: pd.DataFrame, keys: dict, out: dict[str, list]) -> None:
        """Add what ``released`` makes of the rows; ``keys``, (last, *memory) by key, moves on with them."""
        held = {n: rows[n].tolist() for n in self.names}
        key, us = held["key"], held["us"]
        lo = 0
        for hi in range(1, len(us) + 1):
            if hi < len(us) and key[hi] == key[lo] and (self.idle is None or us[hi] - us[hi - 1] < self.idle):
                continue
            last, *memory = keys.get(key[lo], (None,))
            if last is None:
                memory = None
            elif self.idle is not None and us[lo] - last >= self.idle:
                self.ended(key[lo], last, memory, out)
                memory = None
            keys[key[lo]] = (us[hi - 1], *self.released(held, lo, hi, memory, out))
            lo = hi

    def released(self, rows: dict[str, list], lo: int, hi: int, memory: list | None, out: dict[str, list]) -> tuple:
        """Add to ``out`` what rows lo to hi, all of one key, give, with ts in microseconds; the key's new memory."""
        raise NotImplementedError

    def ended(self, key: str, last: int, memory: list, out: dict[str, list]) -> None:
        """Add to ``out`` what a key still has to give that has been silent for ``idle``."""

    def aside(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"key": rows["key"], "ts": _times(rows["us"]), "late": True, **{n: rows[n] for n in ("id", *self.fields) if n in self.columns}}
        none = pd.Series([None] * len(rows), rows.index, dtype=object)
        return pd.DataFrame({c: out.get(c, none) for c in self.columns}, index=rows.index)

    def close(self) -> None:
        pass


def _plain(x: pd.Series) -> list:
    return [None if v is None or v != v else v for v in x.tolist()]


def _times(us: pd.Series) -> pd.Series:
    return pd.to_datetime(us.astype("int64"), unit="us")


class CountWindows(InOrder):
    """Windows of ``length`` tokens every ``stride``; the last length - 1 tokens of a key are its memory."""

    fields = {"token": StringType()}
    memory = {"seen": LongType(), "tail": ArrayType(StringType())}
    columns = ["key", "ts", "id", "win_ix", "tokens", "late"]

    def __init__(self, length: int = 10, stride: int = 2, slot: int = SLOT, idle: float | None = None):
        super().__init__(slot, idle)
        self.length, self.stride = length, stride

    def released(self, rows, lo, hi, memory, out):
        seen, tail = memory or (0, [])
        tokens = [*tail, *rows["token"][lo:hi]]
        first = seen - len(tail)  # place of tokens[0] in the sequence
        start = -(-first // self.stride) * self.stride - first
        for i in range(start, len(tokens) - self.length + 1, self.stride):
            end = lo + i + self.length - 1 - len(tail)  # always a new row: an old window has been handed on
            out["key"].append(rows["key"][end])
            out["ts"].append(rows["us"][end])
            out["id"].append(rows["id"][end])
            out["win_ix"].append((first + i) // self.stride)
            out["tokens"].append(tokens[i : i + self.length])
        return seen + hi - lo, tokens[max(0, len(tokens) - self.length + 1) :]


class Policies(InOrder):
    """Both moving thresholds and the fixed one on the same rows; two numbers and the first time of a key are its memory."""

    fields = {"label": StringType(), "score": DoubleType()}
    memory = {"u": DoubleType(), "c": DoubleType(), "first": LongType()}
    columns = ["key", "ts", "id", "label", "score", "t_uncond", "t_cond", "f_fixed", "f_uncond", "f_cond", "warm", "late"]

    def __init__(self, t_op: float, t_min: float, beta: float = 0.9, warm_seconds: float = 30.0, slot: int = SLOT, idle: float | None = None):
        super().__init__(slot, idle)
        self.t_op, self.t_min, self.beta, self.warm = t_op, t_min, beta, warm_seconds

    def released(self, rows, lo, hi, memory, out):
        u, c, first = memory or (self.t_op, self.t_op, rows["us"][lo])
        for n, name in (("key", "key"), ("ts", "us"), ("id", "id"), ("label", "label"), ("score", "score")):
            out[n] += rows[name][lo:hi]
        out["warm"] += [t - first < self.warm * 1e6 for t in rows["us"][lo:hi]]
        for a in rows["score"][lo:hi]:
            out["t_uncond"].append(u)
            out["t_cond"].append(c)
            there = a is not None  # a null moves nothing and is no alert
            out["f_fixed"].append(there and a > self.t_op)
            out["f_uncond"].append(there and a > u)
            out["f_cond"].append(there and a > c)
            if there:
                if a <= c:
                    c = max(self.t_min, self.beta * c + (1 - self.beta) * a)
                u = max(self.t_min, self.beta * u + (1 - self.beta) * a)
        return u, c, first


class Rise(InOrder):
    """Sliding windows of a key's thresholds, each when it is over. Between windows a key keeps the rows that one which is
    not over holds; after a silence of a window's length all are over."""

    fields = {"t": DoubleType()}
    memory = {"next": LongType(), "us": ArrayType(LongType()), "t": ArrayType(DoubleType())}
    columns = ["key", "ts", "rise", "late"]

    def __init__(self, length: int = 3_600_000_000, step: int = 600_000_000, slot: int = SLOT):
        super().__init__(slot, length / 1e6)
        self.length, self.step = length, step

    def _first(self, us: int) -> int:
        """Start of the first window that holds a time."""
        return (us - self.length) // self.step * self.step + self.step

    def released(self, rows, lo, hi, memory, out):
        start, us, t = memory or (self._first(rows["us"][lo]), [], [])
        us, t = [*us, *rows["us"][lo:hi]], [*t, *rows["t"][lo:hi]]
        until = self._first(us[-1])  # windows before it have ended by the last row
        self._windows(rows["key"][lo], range(start, until, self.step), us, t, out)
        kept = bisect_left(us, until)
        return max(start, until), us[kept:], t[kept:]

    def ended(self, key, last, memory, out):
        start, us, t = memory
        self._windows(key, range(start, last + 1, self.step), us, t, out)

    def _windows(self, key: str, starts: range, us: list, t: list, out: dict[str, list]) -> None:
        for s in starts:
            held = [x for x in t[bisect_left(us, s) : bisect_left(us, s + self.length)] if x is not None]
            out["key"].append(key)
            out["ts"].append(s)
            out["rise"].append(max(held) - min(held) if held else None)


def _with_state(stream: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    # Event time as a plain number: which rows are late is the processor's to say, and Spark drops none before it.
    rows = stream.select(F.pmod(F.hash("key"), F.lit(BUCKETS)).alias("bucket"), "key", F.unix_micros("ts").alias("us"), "id", *processor.fields)
    out = rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return out.observe("detector", F.count("*").alias("rows"), F.coalesce(F.sum(F.col("late").cast("long")), F.lit(0)).alias("late"))


def count_windows(stream: DataFrame, length: int = 10, stride: int = 2, slot: int = SLOT, idle: float | None = None) -> DataFrame:
    """(key, ts, id, win_ix, tokens, late) from (key, ts, id, token); ts and id are those of a window's last row, or of a
    late row, which has no window. Rows are observed as ``detector``."""
    return _with_state(stream, CountWindows(length, stride, slot, idle), WINDOW_OUT)


def policies(stream: DataFrame, t_op: float, t_min: float, slot: int = SLOT, idle: float | None = None, warm_seconds: float = 30.0) -> DataFrame:
    """The three policies from (key, ts, id, label, score), and late rows, which have no thresholds. Rows are observed as
    ``detector``. For one threshold over all keys see ``GlobalThreshold``."""
    return _with_state(stream, Policies(t_op, t_min, warm_seconds=warm_seconds, slot=slot, idle=idle), POLICY_OUT)


def on_time(rows: DataFrame) -> DataFrame:
    """What a detector found, without the late rows."""
    return rows.where("NOT late").drop("late")


def late_by_key(rows: DataFrame) -> DataFrame:
    """(key, n): the late rows of a detector's output, over all of its batches."""
    return rows.where("late").groupBy("key").agg(F.count("*").alias("n"))


class GlobalThreshold:
    """One unconditional threshold over all keys, as a ``foreachBatch`` function, with no key that holds them all.

    A batch is cut into blocks by ranges of its rows, what blocks do to T is composed, and the batch's rows get their
    trace from the one stored T; the next T is stored with the number of its batch, so a batch that is run again starts
    from the same T and writes the same rows. Batches must come in order of event time, as those of files that were
    written in order or what ``policies`` has released.
    """

    def __init__(self, path: str, t_op: float, t_min: float, order: tuple[str, ...] = ("ts", "id"), beta: float = 0.9):
        self.path, self.t_op, self.t_min, self.order, self.beta = path, t_op, t_min, order, beta

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        t = spark.read.schema("batch long, t double").parquet(f"{self.path}/t").where(F.col("batch") < number).agg(F.max_by("t", "batch")).first()[0]
        # The stored T takes T_op's place as the start; flags of the fixed policy are not this function's.
        rows = batch.withColumns({"_all": F.lit(1), "T_op": F.lit(t), "T_min": F.lit(self.t_min)})
        trace = thresholds.ema(rows, ["_all"], self.order, self.beta).drop("_all", "T_op", "T_min")
        trace.write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        done = spark.read.schema(trace.schema).parquet(f"{self.path}/rows/batch={number}")
        end = done.agg(F.max_by("T_after", F.struct(*self.order)).alias("t")).select(F.coalesce("t", F.lit(t)).alias("t"))
        end.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/t/batch={number}")

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Run over all there is; the rows with T_before, T_after and flagged."""
        spark = stream.sparkSession
        if not _there(spark, f"{self.path}/t"):
            spark.range(1).select(F.lit(self.t_op).alias("t")).write.parquet(f"{self.path}/t/batch=-1")
        _finished(stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        return spark.read.parquet(f"{self.path}/rows").drop("batch")


def _there(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def _finished(q: StreamingQuery) -> StreamingQuery:
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def alerts_per_hour(stream: DataFrame) -> DataFrame:
    """Alerts by tumbling hours."""
    return stream.where("score > t").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("alerts")).select(F.col("window.start").alias("hour"), "alerts")


def episodes(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Alerts of a key less than ``gap`` apart as one episode."""
    burst = stream.where("score > t").groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("alerts"))
    return burst.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "alerts")


def threshold_rise(stream: DataFrame, bound: float, slot: int = SLOT) -> DataFrame:
    """Sliding hours in which a key's threshold moved by more than ``bound``; late rows move nothing."""
    wide = on_time(_with_state(stream.withColumn("id", F.lit(0).cast("long")), Rise(slot=slot), "key string, ts timestamp, rise double, late boolean"))
    return wide.select("key", F.col("ts").alias("start"), "rise", (F.col("rise") > bound).alias("abnormal"))


def arrived_once(stream: DataFrame) -> DataFrame:
    """Rows by id, each once however often it is delivered within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["id"])


def run(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Run a stream over all there is into Parquet files at ``path``, in folders ``by`` columns."""
    return _finished(stream.writeStream.partitionBy(*by).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start())


def drain(stream: DataFrame, path: str, checkpoint: str, schema: str | StructType, by: tuple[str, ...] = ()) -> DataFrame:
    """``run``, and what it wrote read back."""
    run(stream, path, checkpoint, by)
    return stream.sparkSession.read.schema(schema).parquet(path)
