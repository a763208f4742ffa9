"""Streaming queries, run over all there is and compared with batch results over the rows that came in time.

Rows stay in state until the watermark passes them, so a closing row far ahead in time is delivered last; it is left out of
the result. Deliveries are out of order: some rows come a batch or two after their time, and those that the watermark has
passed by then are late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import score_queries as Q
from tidemark.plans.sequence_queries import EVENTS, RARE, SEQ, _feat, _flt, _named, _named_sql, _sql
from tidemark.functions.portable import h32, h32_sql
from tidemark.operators import features as X
from tidemark.sources import tables as S
from tidemark.streaming import live

FAR = "2100-01-01"
#: Micro-batches of a stream: keys span them, and state carries over. Small ones are a file each, large ones several.
BATCHES = 5
FILE_ROWS, MOST_FILES = 100_000, 64
#: How far the watermark stays behind, half the time of a file; and milliseconds that are released together.
DELAY, DELAY_MS, DAY = "3 days", 3 * 86_400_000, 86_400_000


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = S.event_scores(spark, d).join(S.table(spark, d, "events").select("event_id", F.col("event_type").alias("token")), "event_id")
    return rows.select(F.col("tenant").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "token", "label", "score")


def _events(spark: SparkSession, d: str, closing: bool = False) -> DataFrame:
    """The events table as a stream of files in a folder of its own, in order of time."""
    return _stream(spark, _rows(spark, d), {"score": F.lit(1e9)} if closing else None)


def _stream(spark: SparkSession, rows: DataFrame, last: dict | None) -> DataFrame:
    """Rows as files in order of time, in micro-batches, with a ``last`` row far ahead if asked for."""
    path, rows = S.scratch(spark), S.written(rows)
    cuts = rows.agg(F.percentile_approx(F.col("ts").cast("double"), [i / BATCHES for i in range(1, BATCHES)], 10_000)).first()[0] or []
    at = F.col("ts").cast("double")
    slices = [(at > lo) & (at <= hi) for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True)]
    n = _files(rows, slices)
    for slice_ in slices:
        _dealt(rows.where(slice_), n).write.mode("append").parquet(f"{path}/a")
    if last is not None:
        rows.limit(1).withColumns({"ts": F.lit(FAR).cast("timestamp"), **last}).write.mode("append").parquet(f"{path}/a")
    return live.event_stream(spark, f"{path}/a", rows.schema, per_batch=n)


def _files(rows: DataFrame, slices: list[Column]) -> int:
    """Files that every slice is written as, and so files of a micro-batch: 1, or one for each FILE_ROWS of the smallest."""
    least = min(rows.agg(*(F.count_if(s).alias(f"n{i}") for i, s in enumerate(slices))).first())
    return max(1, min(MOST_FILES, least // FILE_ROWS))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.coalesce(1) if n == 1 else rows.repartition(n)


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    path = S.scratch(spark)
    return live.drain(stream, f"{path}/out", f"{path}/state", stream.schema)


def _closing(rows: DataFrame) -> DataFrame:
    """A row far ahead in time. Its token is one of the alphabet: a filter on tokens must let it pass, or what still waits
    is never released."""
    return rows.limit(1).withColumns({"ts": F.lit(FAR).cast("timestamp"), "id": F.lit(-1).cast("long"), "token": F.lit(EVENTS[0])})


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of BATCHES files by time, in which a quarter of the rows come a file late, and one in twenty
    two files late; within a file they stand in no order."""
    rows = _rows(spark, d)
    us = F.unix_micros("ts")
    span = rows.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    slice_ = F.expr(f"(unix_micros(ts) - lo) * {BATCHES} div (hi - lo + 1)")
    h = h32("deliver", F.col("id")) % 20
    at = F.least(F.lit(BATCHES - 1), slice_ + F.when(h == 0, 2).when(h <= 5, 1).otherwise(0))
    rows = S.written(rows.crossJoin(F.broadcast(span)).withColumn("_file", at).drop("lo", "hi"))
    path = S.scratch(spark)
    n = _files(rows, [F.col("_file") == i for i in range(BATCHES)])
    for i in range(BATCHES):
        _dealt(rows.where(F.col("_file") == i).drop("_file"), n).sortWithinPartitions(h32("order", F.col("id"))).write.mode("append").parquet(f"{path}/a")
    _closing(rows.drop("_file")).write.mode("append").parquet(f"{path}/a")
    return live.event_stream(spark, f"{path}/a", rows.drop("_file").schema, DELAY, per_batch=n)


def q_windows(spark, d):
    live.use_rocksdb(spark)
    windows = live.on_time(live.count_windows(_delivered(spark, d).where(F.col("token").isin(EVENTS)), slot=DAY))
    rows = X.assemble(windows.withColumn("seq_id", F.col("key").cast("long")), EVENTS, RARE)
    return _drained(spark, _named(rows, EVENTS, RARE))


def _tenants(rows: DataFrame) -> DataFrame:
    return live.on_time(rows).groupBy(F.col("key").cast("long").alias("tenant")).agg(
        *(F.sum(F.col(f"f_{p}").cast("long")).alias(f"alerts_{p}") for p in ("fixed", "uncond", "cond")), F.sum(F.col("warm").cast("long")).alias("n_warm"),
        F.round(F.max_by("t_cond", F.struct("ts", "id")), 6).alias("t_cond"), F.round(F.sum("t_uncond"), 4).alias("t_uncond"),
    )


def q_policies(spark, d):
    live.use_rocksdb(spark)
    par = Q.params(Q.split_scores(spark, d)).first()  # one row of six numbers
    return _tenants(_drained(spark, live.policies(_delivered(spark, d), par["T_op"], par["T_min"], slot=DAY)))


def q_idle(spark, d):
    """Tenants that are silent for a day begin anew."""
    live.use_rocksdb(spark)
    par = Q.params(Q.split_scores(spark, d)).first()  # one row of six numbers
    return _tenants(_drained(spark, live.policies(_delivered(spark, d), par["T_op"], par["T_min"], slot=DAY, idle=86_400, warm_seconds=21_600)))


def q_late(spark, d):
    """The detector's late rows by key, and how many rows it took in."""
    live.use_rocksdb(spark)
    par = Q.params(Q.split_scores(spark, d)).first()  # one row of six numbers
    out = _drained(spark, live.policies(_delivered(spark, d), par["T_op"], par["T_min"], slot=DAY))
    took = live.on_time(out).groupBy("key").agg(F.count("*").alias("n_in_time"))
    both = took.join(live.late_by_key(out).withColumnRenamed("n", "n_late"), "key", "full")
    return both.select("key", F.coalesce("n_in_time", F.lit(0)).alias("n_in_time"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


def q_global(spark, d):
    """One threshold over all tenants, batch by batch of a stream in order of time."""
    par = Q.params(Q.split_scores(spark, d)).first()  # one row of six numbers
    path = S.scratch(spark)
    out = live.GlobalThreshold(path, par["T_op"], par["T_min"]).run(_events(spark, d), f"{path}/state")
    return out.groupBy(F.col("key").cast("long").alias("tenant")).agg(F.sum(F.col("flagged").cast("long")).alias("alerts"), F.round(F.avg("T_after"), 6).alias("t_mean"))


def q_alerts(spark, d):
    t = F.lit(Q.params(Q.split_scores(spark, d)).first()["T_op"])
    out = _drained(spark, live.alerts_per_hour(_events(spark, d, closing=True).withColumn("t", t)))
    return out.where(F.col("hour") < FAR).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "alerts")


def q_episodes(spark, d):
    t = F.lit(Q.params(Q.split_scores(spark, d)).first()["T_op"])
    out = _drained(spark, live.episodes(_events(spark, d, closing=True).withColumn("t", t), "6 hours"))
    return out.where(F.col("start") < FAR).select("key", F.col("start").cast("timestamp_ntz").alias("start"), "alerts")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The live log: every score with the thresholds that it met, in folders by label."""
    live.use_rocksdb(spark)
    par = Q.params(Q.split_scores(spark, d)).first()  # one row of six numbers
    stream, path = live.policies(_events(spark, d, closing=True), par["T_op"], par["T_min"], slot=DAY), S.scratch(spark)
    return live.on_time(live.drain(stream, f"{path}/out", f"{path}/state", stream.schema, ("label",)))


def q_log(spark, d):
    return _log(spark, d).groupBy(F.col("key").cast("long").alias("tenant"), "label").agg(
        F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"), F.round(F.sum("t_uncond"), 4).alias("t_uncond"), F.round(F.sum("t_cond"), 4).alias("t_cond")
    )


def q_rise(spark, d):
    log = _log(spark, d).select("key", "ts", F.col("t_uncond").alias("t"))
    out = _drained(spark, live.threshold_rise(_stream(spark, log, {}), 10.0, slot=DAY))
    return out.where(F.col("start") < "2099-12-31").groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("abnormal").cast("long")).alias("abnormal"), F.round(F.sum("rise"), 4).alias("rise"))


_sent = f"""dl AS MATERIALIZED (SELECT *, least({BATCHES - 1}, (us - lo) * {BATCHES} // (hi - lo + 1) + CASE WHEN h = 0 THEN 2 WHEN h <= 5 THEN 1 ELSE 0 END) AS b FROM
        (SELECT event_id, user_id, ts, event_type, epoch_us(ts) AS us, {h32_sql("'deliver'", "event_id")} % 20 AS h FROM events), (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events))"""


def _in_time(where: str = "true") -> str:
    """The deliveries, with whether the watermark, over rows that pass the filter, had passed them."""
    return f"""wm AS (SELECT y.b, max(x.us) // 1000 - {DELAY_MS} AS ms FROM (SELECT DISTINCT b FROM dl) y LEFT JOIN (SELECT * FROM dl WHERE {where}) x ON x.b < y.b GROUP BY y.b),
        ot AS MATERIALIZED (SELECT dl.*, us <= coalesce(ms, 0) * 1000 AS late FROM dl JOIN wm USING (b) WHERE {where})"""


_tokens = f"event_type IN ({', '.join(map(repr, EVENTS))})"
_seq = "seq AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM ot WHERE NOT late)"
_in_time_tenants = "st AS MATERIALIZED (SELECT sp.*, par.*, row_number() OVER (PARTITION BY tenant ORDER BY sp.ts, event_id) AS n FROM sp JOIN ot USING (event_id), par WHERE NOT late)"
_sums = """count(*) FILTER (f_fixed) AS alerts_fixed, count(*) FILTER (f_uncond) AS alerts_uncond, count(*) FILTER (f_cond) AS alerts_cond, count(*) FILTER (warm) AS n_warm,
        round(arg_max(c0, (epoch_us(ts), event_id)), 6) AS t_cond, round(sum(u0), 4) AS t_uncond"""
_runs = """st AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tenant, run ORDER BY ts, event_id) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY tenant ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
        (SELECT sp.*, par.*, coalesce((epoch_us(sp.ts) - lag(epoch_us(sp.ts)) OVER (PARTITION BY tenant ORDER BY sp.ts, event_id) >= 86400000000)::INT, 1) AS fresh FROM sp JOIN ot USING (event_id), par WHERE NOT late)))"""
_full = """arr AS (SELECT seq_id, list(token ORDER BY pos) AS a FROM flt GROUP BY seq_id HAVING count(*) >= 10),
    win AS (SELECT seq_id, w AS win_ix, a[w * 2 + 1 : w * 2 + 10] AS tokens FROM (SELECT seq_id, a, unnest(range(0, (len(a) - 10) // 2 + 1)) AS w FROM arr))"""
_alert = (Q.SPLIT, Q.PAR, "al AS (SELECT tenant::VARCHAR AS key, ts FROM sp, par WHERE score > T_op)")

QUERIES = {
    "r1_r2_live_windows": (q_windows, _sql(_sent, _in_time(_tokens), _seq, _flt(EVENTS), _full, _feat(EVENTS, RARE), then=_named_sql(EVENTS, RARE))),
    "r3_r4_live_policies": (q_policies, Q._sql(Q.SPLIT, Q.PAR, _sent, _in_time(), _in_time_tenants, Q._folds("st", "tenant"), recursive=True,
        then=f"SELECT tenant, {_sums} FROM (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY tenant) < 30000000 AS warm FROM tr) GROUP BY tenant")),
    "r9_idle_keys_begin_anew": (q_idle, Q._sql(Q.SPLIT, Q.PAR, _sent, _in_time(), _runs, Q._folds("st", "tenant, run"), recursive=True,
        then=f"SELECT tenant, {_sums} FROM (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY tenant, run) < 21600000000 AS warm FROM tr) GROUP BY tenant")),
    "t7_live_global_threshold": (q_global, Q._sql(Q.SPLIT, Q.PAR, "st AS (SELECT sp.*, par.*, 1 AS one, row_number() OVER (ORDER BY ts, event_id) AS n FROM sp, par)", Q._folds("st", "one"), recursive=True,
        then="SELECT tenant, count(*) FILTER (f_uncond) AS alerts, round(avg(u1), 6) AS t_mean FROM tr GROUP BY tenant")),
    "r5_live_alerts_per_hour": (q_alerts, Q._sql(*_alert, then="SELECT date_trunc('hour', ts) AS hour, count(*) AS alerts FROM al GROUP BY 1")),
    "r6_live_episodes": (q_episodes, Q._sql(*_alert, """g AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM
        (SELECT key, ts, coalesce((ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) > INTERVAL 6 HOUR)::INT, 1) AS fresh FROM al))""", then="SELECT key, min(ts) AS start, count(*) AS alerts FROM g GROUP BY key, g")),
    "r8_late_rows": (q_late, _sql(_sent, _in_time(), then="SELECT user_id::VARCHAR AS key, count(*) FILTER (NOT late) AS n_in_time, count(*) FILTER (late) AS n_late FROM ot GROUP BY user_id")),
    "io7_score_log": (q_log, Q._sql(*Q._tenant, recursive=True, then="""SELECT tenant, label, count(*) AS n, round(sum(score), 4) AS score, round(sum(u0), 4) AS t_uncond, round(sum(c0), 4) AS t_cond
        FROM tr GROUP BY ALL""")),
    "r7_live_threshold_rise": (q_rise, Q._sql(*Q._tenant, """w AS (SELECT tenant::VARCHAR AS key, u0, time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS start FROM tr, (SELECT unnest(range(6)) AS k))""",
        "r AS (SELECT key, start, max(u0) - min(u0) AS rise FROM w GROUP BY ALL)", recursive=True,
        then="SELECT key, count(*) AS n, count(*) FILTER (rise > 10) AS abnormal, round(sum(rise), 4) AS rise FROM r GROUP BY key")),
}
