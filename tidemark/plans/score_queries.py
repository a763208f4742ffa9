"""Queries over score streams: calibration, policies, the factorial study, metrics and rank tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.portable import h32_sql
from tidemark.operators import calibrate as C
from tidemark.operators import metrics as E
from tidemark.operators import ranktests as H
from tidemark.operators import sampling as J
from tidemark.operators import thresholds as T
from tidemark.operators import windows as W
from tidemark.sources import tables as S

TRIALS, REPS = 40, 2000
ORDER = ["ts", "event_id"]
CELL = ["attack_class", "noise", "trial"]

SPLIT = f"""sc AS (SELECT event_id, user_id AS tenant, ts, CASE WHEN event_type = 'error' THEN 'attack' ELSE 'benign' END AS label, value AS score FROM events),
    sp AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {h32_sql("'cal'", "event_id")}, event_id) <= count(*) OVER (PARTITION BY label) // 2
        THEN 'CAL' ELSE 'TEST' END AS split FROM sc)"""
PAR = "par AS MATERIALIZED (SELECT " + ", ".join(f"quantile_cont(score, {q}) AS {n}" for n, q in C.POINTS.items()) + " FROM sp WHERE label = 'benign' AND split = 'CAL')"
STEP = "greatest({m}, 0.9::DOUBLE * {t} + (1 - 0.9::DOUBLE) * {a})"


def _folds(stream: str, key: str) -> str:
    """Both moving policies row by row, as a recursion over positions."""
    u, c = STEP.format(m="s.T_min", t="e.u1", a="s.score"), STEP.format(m="s.T_min", t="e.c1", a="s.score")
    first = STEP.format(m="T_min", t="T_op", a="score")
    return f"""ema AS (SELECT {key}, n, T_op AS u0, {first} AS u1, T_op AS c0, CASE WHEN score > T_op THEN T_op ELSE {first} END AS c1 FROM {stream} WHERE n = 1
        UNION ALL SELECT {", ".join("s." + k.strip() for k in key.split(","))}, s.n, e.u1, {u}, e.c1, CASE WHEN s.score > e.c1 THEN e.c1 ELSE {c} END
        FROM ema e JOIN {stream} s ON {" AND ".join(f"s.{k.strip()} = e.{k.strip()}" for k in key.split(","))} AND s.n = e.n + 1),
    tr AS (SELECT s.*, e.u0, e.u1, e.c0, e.c1, score > T_op AS f_fixed, score > u0 AS f_uncond, score > c0 AS f_cond FROM {stream} s JOIN ema e USING ({key}, n))"""


TENANT = "st AS MATERIALIZED (SELECT sp.*, par.*, row_number() OVER (PARTITION BY tenant ORDER BY ts, event_id) AS n FROM sp, par)"


def _bands(pool: str) -> str:
    return f"""{pool} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {h32_sql("'pool'", "event_id")}, event_id) - 1 AS ix, count(*) OVER (PARTITION BY band) AS size FROM (
        SELECT event_id, score, CASE WHEN score <= bp50 THEN 'none' WHEN score <= bp90 THEN 'moderate' ELSE 'high' END AS band FROM sp, par WHERE split = 'TEST' AND label = 'benign'
        UNION ALL SELECT event_id, score, CASE WHEN score <= bp999 THEN 'stealthy' ELSE 'loud' END FROM sp, par WHERE split = 'TEST' AND label = 'attack' AND score > T_op))"""


def _draws() -> str:
    one = lambda band, phase, slots, offset: f"""SELECT attack_class, noise, trial, slot + {offset} AS pos, '{phase}' AS phase, score FROM
        (SELECT c.*, {h32_sql(f"'{phase}'", "attack_class", "noise", "trial", "slot")} % size AS ix FROM (SELECT *, {band} AS band FROM cells, (SELECT unnest(range({slots})) AS slot)) c
        JOIN (SELECT DISTINCT band, size FROM pool) USING (band)) JOIN pool USING (band, ix)"""  # noqa: E731
    return f"""cells AS (SELECT a.x AS attack_class, b.x AS noise, t AS trial FROM (VALUES ('stealthy'), ('loud')) a(x), (VALUES ('none'), ('moderate'), ('high')) b(x),
        (SELECT unnest(range({TRIALS})) AS t)),
    st AS MATERIALIZED (SELECT x.*, T_op, T_min, row_number() OVER (PARTITION BY attack_class, noise, trial ORDER BY pos) AS n FROM ({one("'none'", "warm", 50, 0)} UNION ALL
        {one("noise", "noise", 150, 50)} UNION ALL {one("attack_class", "attack", 30, 200)}) x, par)"""


TRIAL_ROWS = """trials AS MATERIALIZED (SELECT attack_class, noise, trial, avg(f_fixed::INT) FILTER (phase = 'attack') AS recall_fixed, avg(f_uncond::INT) FILTER (phase = 'attack') AS recall_uncond,
        avg(f_cond::INT) FILTER (phase = 'attack') AS recall_cond, avg((f_fixed AND NOT f_uncond)::INT) FILTER (phase = 'attack') AS evasion_uncond,
        avg((f_fixed AND NOT f_cond)::INT) FILTER (phase = 'attack') AS evasion_cond, arg_min(u0, pos) FILTER (phase = 'attack') AS t_uncond,
        arg_min(c0, pos) FILTER (phase = 'attack') AS t_cond, avg(f_uncond::INT) FILTER (phase = 'noise') AS own_uncond, avg(f_fixed::INT) FILTER (phase = 'noise') AS own_fixed
        FROM tr GROUP BY ALL)"""


def _sql(*ctes: str, then: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n    ".join(ctes) + "\n" + then


STUDY = (SPLIT, PAR, _bands("pool"), _draws(), _folds("st", "attack_class, noise, trial"), TRIAL_ROWS)


def split_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.written(J.split_half(S.event_scores(spark, d), "label", "event_id", "cal"))


def params(sp: DataFrame) -> DataFrame:
    return C.calibrate(sp.where("label = 'benign' AND split = 'CAL'"))


def tenant_traces(spark: SparkSession, d: str) -> DataFrame:
    """All events of each tenant under the three policies, as columns of one row."""
    sp = split_scores(spark, d)
    return T.policies(C.with_params(sp, params(sp)), ["tenant"], ORDER)


def study_streams(spark: SparkSession, d: str) -> DataFrame:
    sp = split_scores(spark, d)
    par = params(sp)
    pools = J.pool(C.pools(sp.where("split = 'TEST'"), par).select("event_id", "score", "band"), ["band"], "event_id", "pool")
    streams = J.trial_streams(J.design(spark, TRIALS), pools)
    return C.with_params(streams, par.select("T_op", "T_min"))


def arm_streams(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """The same study on the scores of several arms (arm, event_id, label, split, score), each with its own thresholds."""
    par = C.calibrate(scores.where("label = 'benign' AND split = 'CAL'"), ("arm",))
    test = scores.where("split = 'TEST'").join(par, "arm")
    bands = C.noise_band(test.where("label = 'benign'")).unionByName(C.attack_band(test.where("label = 'attack'")))
    pools = J.pool(bands.select("arm", "event_id", "score", "band"), ["arm", "band"], "event_id", "pool")
    return J.trial_streams(J.design(spark, TRIALS), S.written(pools), by=["arm"]).join(par.select("arm", "T_op", "T_min"), "arm")


def trial_table(spark: SparkSession, d: str) -> DataFrame:
    """One row for each trial: recalls, evasions, thresholds at the attack, the noisy neighbour's own flags.

    A dozen queries start from it, so an application runs the study once.
    """
    return S.once(spark, "trials", d, "events", _run_study)


def _run_study(spark: SparkSession, d: str) -> DataFrame:
    return trials_of(study_streams(spark, d), CELL)


def trials_of(streams: DataFrame, cell: list[str]) -> DataFrame:
    t = T.gathered_policies(streams, cell, ["pos"])
    at = F.col("phase") == "attack"
    share = lambda hit, phase=at: E.rate(F.when(phase, hit.cast("int")))
    return t.groupBy(*cell).agg(
        *(share(F.col(f"f_{p}")).alias(f"recall_{p}") for p in ("fixed", "uncond", "cond")),
        *(share(F.col("f_fixed") & ~F.col(f"f_{p}")).alias(f"evasion_{p}") for p in ("uncond", "cond")),
        T.at_attack("u0", "pos").alias("t_uncond"), T.at_attack("c0", "pos").alias("t_cond"),
        *(share(F.col(f"f_{p}"), F.col("phase") == "noise").alias(f"own_{p}") for p in ("uncond", "fixed")),
    )


def _round(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, *(F.round(c, digits).alias(c) for c in df.columns if c not in keep))


def q_calibrate(spark, d):
    return _round(params(split_scores(spark, d)))


def q_pools(spark, d):
    sp = split_scores(spark, d)
    return C.pools(sp.where("split = 'TEST'"), params(sp)).groupBy("band").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"))


def q_warm(spark, d):
    sp = split_scores(spark, d)
    return C.warm_pool(C.with_params(sp.where("split = 'TEST' AND label = 'benign'"), params(sp))).agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("high"))


def q_leak(spark, d):
    sp = split_scores(spark, d)
    return J.leakage(sp.where("split = 'CAL'"), sp.where("split = 'TEST'"), "event_id")


def q_split(spark, d):
    return split_scores(spark, d).groupBy("label", "split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def q_tenant(spark, d):
    t = tenant_traces(spark, d)
    pos = F.col("label") == "attack"
    rate = lambda c, w: F.round(E.rate(F.when(w, F.col(c).cast("int"))), 6)
    return t.groupBy("tenant").agg(
        F.count("*").alias("n"), *(x for p in ("fixed", "uncond", "cond") for x in (rate(f"f_{p}", pos).alias(f"recall_{p}"), rate(f"f_{p}", ~pos).alias(f"fpr_{p}")))
    )


def q_trace(spark, d):
    return _round(tenant_traces(spark, d).select("tenant", "event_id", "u0", "u1", "c0", "c1", "f_fixed", "f_uncond", "f_cond"), "tenant", "event_id", "f_fixed", "f_uncond", "f_cond")


def q_global(spark, d):
    """One threshold for all tenants: the closed form over one stream."""
    sp = split_scores(spark, d)
    t = T.ema(C.with_params(sp, params(sp)).withColumn("one", F.lit(1)), ["one"], ORDER)
    return t.groupBy("tenant").agg(F.sum(F.col("flagged").cast("long")).alias("alerts"), F.round(F.avg("T_after"), 6).alias("t_mean"))


def q_floor(spark, d):
    sp = split_scores(spark, d)
    return _round(T.conditional_floor(C.with_params(sp, params(sp)), ["tenant"], ORDER), "tenant")


def q_capped(spark, d):
    sp = split_scores(spark, d)
    return _round(T.ema_capped(C.with_params(sp, params(sp)), ["tenant"], ORDER, 0.5), "tenant")


def q_median(spark, d):
    sp = split_scores(spark, d)
    t = T.median_threshold(C.with_params(sp, params(sp)), ["tenant"], ORDER)
    return t.groupBy("tenant").agg(F.sum(F.col("flagged").cast("long")).alias("alerts"), F.round(F.sum("T_before"), 4).alias("t_sum"))


def q_settling(spark, d):
    sp = split_scores(spark, d)
    t = T.ema(C.with_params(sp, params(sp)), ["tenant"], ORDER).withColumn("n", F.row_number().over(Window.partitionBy("tenant").orderBy(*ORDER)))
    return T.settling(t, ["tenant"], "n", "T_min").select("tenant", F.col("settled").cast("long").alias("settled"))


def q_streams(spark, d):
    return study_streams(spark, d).groupBy("attack_class", "noise", "phase").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.sum("pos").alias("pos"))


def q_trials(spark, d):
    return _round(trial_table(spark, d).drop("own_uncond", "own_fixed"), *CELL)


def _long(trials: DataFrame) -> DataFrame:
    """(cell, policy, recall, t): policies as rows, for summaries."""
    return trials.selectExpr(
        *CELL, "stack(3, 'fixed', recall_fixed, CAST(NULL AS DOUBLE), 'uncond', recall_uncond, t_uncond, 'cond', recall_cond, t_cond) AS (policy, recall, t)"
    )


def q_summary(spark, d):
    cell, trials = ["attack_class", "noise", "policy"], _long(trial_table(spark, d))
    ci = H.bootstrap_ci(trials.withColumnRenamed("trial", "ix"), cell, "ix", "recall", REPS, "boot").drop("mean")
    rows = trials.groupBy(*cell).agg(F.avg("recall").alias("recall"), F.avg("t").alias("t")).join(ci, cell)
    t_op = params(split_scores(spark, d)).select("T_op")
    out = rows.crossJoin(F.broadcast(t_op)).withColumn("t", F.when(F.col("policy") == "fixed", F.col("T_op")).otherwise(F.col("t"))).drop("T_op")
    return _round(out, "attack_class", "noise", "policy")


def q_bootstrap(spark, d):
    rows = _long(trial_table(spark, d)).withColumnRenamed("trial", "ix")
    return _round(H.bootstrap_ci(rows, ["attack_class", "noise", "policy"], "ix", "recall", REPS, "boot"), "attack_class", "noise", "policy")


def q_delta(spark, d):
    wide = trial_table(spark, d).groupBy("attack_class").pivot("noise", ["none", "moderate", "high"]).agg(F.avg("t_uncond"))
    return wide.select("attack_class", F.round(F.col("high") - F.col("none"), 6).alias("delta_t"))


def q_own(spark, d):
    return _round(trial_table(spark, d).groupBy("noise").agg(F.avg("own_uncond").alias("own_uncond"), F.avg("own_fixed").alias("own_fixed")), "noise")


def q_box(spark, d):
    """Recall of stealthy attacks by noise and policy."""
    stealthy = _long(trial_table(spark, d)).where("attack_class = 'stealthy' AND recall IS NOT NULL")
    return _round(E.box(stealthy, "recall", ["noise", "policy"]), "noise", "policy")


def q_box_thresholds(spark, d):
    return _round(E.box(trial_table(spark, d), "t_uncond", ["noise"]), "noise")


def q_trial_trace(spark, d):
    """How T moves over the first stealthy trial of each noise, phase by phase."""
    one = study_streams(spark, d).where("attack_class = 'stealthy' AND trial = 0")
    t = T.gathered_policies(one, CELL, ["pos"])
    return _round(t.select("noise", "pos", "phase", "score", "u0", "u1", "c0", "c1"), "noise", "pos", "phase")


def q_report(spark, d):
    """The study's report, written as one nested object and read back: the trend of stealthy recall with noise, what the
    moving threshold misses under high noise, the conditional one as its remedy, loud attacks as control, pool sizes."""
    trials = trial_table(spark, d)
    stealthy = trials.where("attack_class = 'stealthy'")
    high, loud = stealthy.where("noise = 'high'"), trials.where("attack_class = 'loud' AND noise = 'high'")
    means = lambda rows, *cols: rows.agg(F.struct(*(F.avg(c).alias(c) for c in cols)).alias("x"))
    one = lambda rows: rows.select(F.struct(*rows.columns).alias("x"))
    sizes = q_pools(spark, d).groupBy().pivot("band", ["none", "moderate", "high", "stealthy", "loud"]).agg(F.first("n"))
    parts = {
        "trend": one(H.kruskal(stealthy, "noise", "recall_uncond").crossJoin(H.spearman(_level(stealthy), "level", "recall_uncond"))),
        "paired": one(H.wilcoxon(high, "recall_fixed", "recall_uncond")), "high_noise": means(high, "recall_fixed", "recall_uncond", "evasion_uncond", "t_uncond"),
        "mitigation": means(high, "recall_cond", "evasion_cond", "t_cond"), "loud": means(loud, "recall_fixed", "recall_uncond", "evasion_uncond"), "pools": one(sizes),
    }
    whole = None
    for name, part in parts.items():
        part = part.withColumnRenamed("x", name)
        whole = part if whole is None else whole.crossJoin(part)
    path = S.scratch(spark)
    S.write_report(whole, path)
    r = spark.read.schema(whole.schema).json(path)
    pick = lambda **cols: [F.round(c, 6).alias(n) for n, c in cols.items()]
    return r.select(
        *pick(h="trend.h", p_h="trend.p", rho="trend.rho", p_rho="trend.p_normal", w="paired.w", p_w="paired.p_normal", recall_fixed="high_noise.recall_fixed", recall_uncond="high_noise.recall_uncond",
              evasion_uncond="high_noise.evasion_uncond", t_uncond="high_noise.t_uncond", recall_cond="mitigation.recall_cond", evasion_cond="mitigation.evasion_cond", t_cond="mitigation.t_cond",
              loud_fixed="loud.recall_fixed", loud_uncond="loud.recall_uncond", loud_evasion="loud.evasion_uncond"),
        *(F.col(f"pools.{b}").alias(f"n_{b}") for b in ("none", "moderate", "high", "stealthy", "loud")),
    )


def q_warm_rates(spark, d):
    """False-positive rates of each policy over all benign rows, and without the first day of each tenant."""
    t = tenant_traces(spark, d).where("label = 'benign'")
    late = W.drop_warmup(tenant_traces(spark, d), "tenant", "ts", 86_400).where("label = 'benign'")
    rates = lambda rows, end: rows.agg(*(F.round(E.rate(F.col(f"f_{p}")), 6).alias(f"fpr_{p}_{end}") for p in ("fixed", "uncond", "cond")))
    return rates(t, "all").crossJoin(rates(late, "late"))


def q_episode_latency(spark, d):
    """For each burst of a tenant's errors, which are under two days apart: seconds from its first error to the first
    alert in it; null if there is none."""
    sp = split_scores(spark, d)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = C.with_params(sp, params(sp)).select("tenant", "ts", "event_id", us.alias("us"), (F.col("label") == "attack").alias("error"), (F.col("score") > F.col("T_op")).alias("alert"))
    so_far = Window.partitionBy("tenant").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("error"), F.col("us"))).over(so_far)
    fresh = (F.col("error") & F.coalesce(F.col("us") - last >= 2 * 86_400_000_000, F.lit(True))).cast("int")
    rows = rows.withColumn("fresh", fresh).withColumn("burst", F.sum("fresh").over(so_far.rowsBetween(Window.unboundedPreceding, 0))).where("burst > 0")
    each = rows.groupBy("tenant", "burst").agg(F.min(F.when(F.col("error"), F.col("us"))).alias("lo"), F.max(F.when(F.col("error"), F.col("us"))).alias("hi"), F.min(F.when(F.col("alert"), F.col("us"))).alias("hit"))
    return each.select("tenant", "burst", F.when(F.col("hit") <= F.col("hi"), F.round((F.col("hit") - F.col("lo")) / 1e6, 3)).alias("seconds"))


def q_kruskal(spark, d):
    return _round(H.kruskal(trial_table(spark, d), "noise", "t_uncond"), "df")


def q_kruskal_types(spark, d):
    """Values of the five event types: four degrees."""
    return _round(H.kruskal(S.table(spark, d, "events").select("event_type", "value"), "event_type", "value"), "df")


def q_poisson(spark, d):
    """Mean value of all events of a type, from replicates over all rows."""
    return _round(H.poisson_bootstrap(S.table(spark, d, "events"), ["event_type"], ["event_id"], "value", 200, "poisson"), "event_type")


def _level(trials: DataFrame) -> DataFrame:
    return trials.withColumn("level", F.when(F.col("noise") == "none", 0).when(F.col("noise") == "moderate", 1).otherwise(2))


def q_spearman(spark, d):
    return _round(H.spearman(_level(trial_table(spark, d)), "level", "recall_uncond"), "n")


def q_wilcoxon(spark, d):
    return _round(H.wilcoxon(trial_table(spark, d), "recall_cond", "recall_uncond"), "n")


def q_jonckheere(spark, d):
    return _round(H.jonckheere(trial_table(spark, d), "noise", "t_uncond", ["none", "moderate", "high"]))


def q_mann_whitney(spark, d):
    return _round(H.mann_whitney(trial_table(spark, d), "noise", "t_uncond", [("high", "none"), ("moderate", "none"), ("high", "moderate")]), "a", "b")


def q_unit(spark, d):
    """Trials of each cell, after the check that no trial has several rows."""
    return H.one_row_per_trial(trial_table(spark, d), CELL).groupBy("attack_class", "noise").agg(F.count("*").alias("n"), F.round(F.avg("recall_fixed"), 6).alias("recall_fixed"))


def q_trend(spark, d):
    return _round(H.trend(_level(trial_table(spark, d)), "level", "t_uncond"))


def _labelled(spark, d):
    docs, labels = S.table(spark, d, "documents"), S.table(spark, d, "labels")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 0).alias("positive"), F.col("n_chars").cast("double").alias("score"))


def q_auc(spark, d):
    c = E.curve(_labelled(spark, d), "score", F.col("positive"))
    return _round(E.auc(c).crossJoin(E.average_precision(c)))


def q_recall_at_fpr(spark, d):
    return _round(E.recall_at_fpr(E.curve(_labelled(spark, d), "score", F.col("positive")), [0.01, 0.05, 0.2]), "fpr_limit")


def q_points(spark, d):
    c = E.curve(_labelled(spark, d), "score", F.col("positive"))
    return _round(c.select("s", (F.col("tp") / F.col("n_pos")).alias("tpr"), (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("prec")), "s")


def q_histogram(spark, d):
    return E.histogram(S.event_scores(spark, d), "score", 0.0, 10.0, ["label"])


def q_f1(spark, d):
    sp = split_scores(spark, d)
    x = C.with_params(sp.where("split = 'TEST'"), params(sp))
    t0 = x.agg(F.round(E.rate(F.when(F.col("label") == "attack", F.col("score") > F.col("T0"))), 6).alias("recall_t0"), F.round(E.rate(F.when(F.col("label") == "benign", F.col("score") > F.col("T0"))), 6).alias("fpr_t0"))
    return _round(E.precision_recall_f1(x, F.col("score") > F.col("T_op"), F.col("label") == "attack")).crossJoin(t0)


def q_alerts(spark, d):
    t = tenant_traces(spark, d).withColumn("hour", F.date_trunc("hour", F.col("ts")))
    return t.groupBy("hour").agg(*(F.sum(F.col(f"f_{p}").cast("long")).alias(f"alerts_{p}") for p in ("fixed", "uncond", "cond")))


def q_latency(spark, d):
    t = tenant_traces(spark, d)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = t.groupBy("tenant").agg(F.min(F.when(F.col("label") == "attack", us)).alias("a")).where("a IS NOT NULL")
    hit = t.where("f_fixed").withColumn("us", us).join(first, "tenant").where("us >= a").groupBy("tenant").agg(F.min("us").alias("b"), F.first("a").alias("a"))
    return hit.select("tenant", F.round((F.col("b") - F.col("a")) / 1e6, 3).alias("seconds"))


def q_sinks(spark, d):
    """Scores, a report and a table written and read back."""
    sp = split_scores(spark, d).withColumn("arm", F.lit("raw"))
    path = S.scratch(spark)
    S.write_scores(sp.select("arm", "label", "event_id", "score"), f"{path}/scores")
    summary = spark.read.parquet(f"{path}/scores").groupBy("arm", "label").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    S.write_table(summary, f"{path}/summary")
    table = spark.read.option("header", True).csv(f"{path}/summary", schema="arm string, label string, n long, ids long")
    S.write_report(table.select("arm", F.struct("label", "n").alias("counts"), "ids"), f"{path}/report")
    back = spark.read.json(f"{path}/report", schema="arm string, counts struct<label: string, n: long>, ids long")
    return back.select("arm", "counts.label", "counts.n", "ids")


_rank = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2"
#: P(Z >= z): Simpson's rule over 2,000 steps from 0 to z.
_tail = """(0.5 - {z} / 6000 * list_sum(list_transform(range(2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) *
        exp(-pow({z} * k / 2000, 2) / 2))) / sqrt(2 * pi()))"""
_boot = f"""bd AS MATERIALIZED (SELECT c.attack_class, c.noise, c.policy, c.rep, avg(l.recall) AS m FROM
        (SELECT attack_class, noise, policy, n, rep, slot, {h32_sql("'boot'", "attack_class", "noise", "policy", "rep", "slot")} % n AS ix FROM (SELECT attack_class, noise, policy, count(*) AS n FROM l GROUP BY ALL),
        (SELECT unnest(range({REPS})) AS rep), (SELECT unnest(range({TRIALS})) AS slot) WHERE slot < n) c JOIN l ON l.attack_class = c.attack_class AND l.noise = c.noise AND l.policy = c.policy AND l.trial = c.ix GROUP BY ALL)"""
_level_sql = "CASE noise WHEN 'none' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END"
_long_sql = """l AS (SELECT attack_class, noise, trial, 'fixed' AS policy, recall_fixed AS recall, NULL::DOUBLE AS t FROM trials UNION ALL
        SELECT attack_class, noise, trial, 'uncond', recall_uncond, t_uncond FROM trials UNION ALL SELECT attack_class, noise, trial, 'cond', recall_cond, t_cond FROM trials)"""
_lab = "lab AS (SELECT quality = 0 AS pos, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id))"
_curve = """cv AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, p, n, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM
        (SELECT s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM lab GROUP BY s) WINDOW w AS (ORDER BY s DESC))"""
_tenant = (SPLIT, PAR, TENANT, _folds("st", "tenant"))
_rates = "".join(f", round(avg(f_{p}::INT) FILTER (label = 'attack'), 6) AS recall_{p}, round(avg(f_{p}::INT) FILTER (label = 'benign'), 6) AS fpr_{p}" for p in ("fixed", "uncond", "cond"))
_mw = lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, sum(CASE WHEN x.t_uncond > y.t_uncond THEN 1 WHEN x.t_uncond = y.t_uncond THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM trials x, trials y WHERE x.noise = '{a}' AND y.noise = '{b}'"
_mws = " UNION ALL ".join(_mw(a, b) for a, b in (("high", "none"), ("moderate", "none"), ("high", "moderate")))

_stealthy = "s AS (SELECT * FROM trials WHERE attack_class = 'stealthy')"
_report_ctes = (
    _stealthy, f"kr AS (SELECT noise, recall_uncond AS x, {_rank.format(x='recall_uncond')} AS r FROM s)", "kg AS (SELECT sum(r) AS r, count(*)::DOUBLE AS n FROM kr GROUP BY noise)",
    "kt AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*) AS c FROM s GROUP BY recall_uncond))",
    "kh AS (SELECT (12.0::DOUBLE / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / nullif(1 - any_value(t) / (sum(n) * sum(n) * sum(n) - sum(n)), 0) AS h FROM kg, kt)",
    f"rh AS (SELECT corr(a, b) AS rho, count(*) AS n FROM (SELECT {_rank.format(x='level')} AS a, {_rank.format(x='recall_uncond')} AS b FROM (SELECT {_level_sql} AS level, recall_uncond FROM s)))",
    "hi AS (SELECT * FROM s WHERE noise = 'high')", "lo AS (SELECT * FROM trials WHERE attack_class = 'loud' AND noise = 'high')",
    "dd AS (SELECT recall_fixed - recall_uncond AS d, abs(recall_fixed - recall_uncond) AS m FROM hi WHERE recall_fixed <> recall_uncond)",
    f"ww AS (SELECT coalesce(sum(r) FILTER (d > 0), 0) AS w, count(*)::DOUBLE AS n FROM (SELECT d, {_rank.format(x='m')} AS r FROM dd))", "wt AS (SELECT coalesce(sum(c * c * c - c), 0) AS t FROM (SELECT count(*) AS c FROM dd GROUP BY m))",
    "wz AS (SELECT w, (w - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48::DOUBLE), 0) AS z FROM ww, wt)",
    "mh AS (SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("recall_fixed", "recall_uncond", "evasion_uncond", "t_uncond", "recall_cond", "evasion_cond", "t_cond")) + " FROM hi)",
    "ml AS (SELECT round(avg(recall_fixed), 6) AS loud_fixed, round(avg(recall_uncond), 6) AS loud_uncond, round(avg(evasion_uncond), 6) AS loud_evasion FROM lo)",
    "ps AS (SELECT " + ", ".join(f"nullif(count(*) FILTER (band = '{b}'), 0) AS n_{b}" for b in ("none", "moderate", "high", "stealthy", "loud")) + " FROM pool)",
)
_report_sql = f"""SELECT round(h, 6) AS h, round(exp(-h / 2), 6) AS p_h, round(rho, 6) AS rho, round(2 * {_tail.format(z='abs(rho) * sqrt(rh.n - 1)')}, 6) AS p_rho, round(w, 6) AS w,
        round({_tail.format(z='z')}, 6) AS p_w, mh.*, ml.*, ps.* FROM kh, rh, wz, mh, ml, ps"""

QUERIES = {
    "e1_calibrate": (q_calibrate, _sql(SPLIT, PAR, then="SELECT " + ", ".join(f"round({n}, 6) AS {n}" for n in C.POINTS) + " FROM par")),
    "io3_io4_io5_sinks": (q_sinks, _sql(SPLIT, then="SELECT 'raw' AS arm, label, count(*) AS n, sum(event_id)::BIGINT AS ids FROM sp GROUP BY label")),
    "f3_f4_e15_pools": (q_pools, _sql(SPLIT, PAR, _bands("pool"), then="SELECT band, count(*) AS n, round(min(score), 6) AS low, round(max(score), 6) AS high FROM pool GROUP BY band")),
    "f5_warm_pool": (q_warm, _sql(SPLIT, PAR, then="SELECT count(*) AS n, round(max(score), 6) AS high FROM sp, par WHERE split = 'TEST' AND label = 'benign' AND score <= bp50")),
    "j2_split_half": (q_split, _sql(SPLIT, then="SELECT label, split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM sp GROUP BY ALL")),
    "j10_leakage": (q_leak, _sql(SPLIT, then="SELECT count(*) AS shared FROM (SELECT event_id FROM sp WHERE split = 'CAL' INTERSECT SELECT event_id FROM sp WHERE split = 'TEST')")),
    "t1_t3_e2_e7_tenant_policies": (q_tenant, _sql(*_tenant, recursive=True, then=f"SELECT tenant, count(*) AS n{_rates} FROM tr GROUP BY tenant")),
    "t4_threshold_trace": (q_trace, _sql(*_tenant, recursive=True, then="SELECT tenant, event_id, round(u0, 6) AS u0, round(u1, 6) AS u1, round(c0, 6) AS c0, round(c1, 6) AS c1, f_fixed, f_uncond, f_cond FROM tr")),
    "t7_global_threshold": (q_global, _sql(SPLIT, PAR, "st AS (SELECT sp.*, par.*, 1 AS one, row_number() OVER (ORDER BY ts, event_id) AS n FROM sp, par)", _folds("st", "one"), recursive=True,
        then="SELECT tenant, count(*) FILTER (f_uncond) AS alerts, round(avg(u1), 6) AS t_mean FROM tr GROUP BY tenant")),
    "t3_conditional_fold": (q_floor, _sql(*_tenant, recursive=True, then="SELECT tenant, round(arg_max(c1, n), 6) AS T_final FROM tr GROUP BY tenant")),
    "t8_capped_ema": (q_capped, _sql(SPLIT, PAR, TENANT, "a AS (SELECT tenant, list(score ORDER BY n) AS a, any_value(T_op) AS t, any_value(T_min) AS m FROM st GROUP BY tenant)",
        then="SELECT tenant, round(list_reduce(list_prepend(t, a), lambda x, y: least(0.5 * t, greatest(m, 0.9::DOUBLE * x + (1 - 0.9::DOUBLE) * y))), 6) AS T_final FROM a")),
    "t8_median_threshold": (q_median, _sql(SPLIT, PAR, TENANT, "md AS (SELECT tenant, score, greatest(T_min, coalesce(quantile_cont(score, 0.5) OVER (PARTITION BY tenant ORDER BY n ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), T_op)) AS t FROM st)",
        then="SELECT tenant, count(*) FILTER (score > t) AS alerts, round(sum(t), 4) AS t_sum FROM md GROUP BY tenant")),
    "t6_settling": (q_settling, _sql(*_tenant, recursive=True, then="SELECT tenant, min(n) FILTER (abs(u1 - T_min) <= 0.1 * abs(T_op - T_min)) AS settled FROM tr GROUP BY tenant")),
    "j3_j5_trial_streams": (q_streams, _sql(SPLIT, PAR, _bands("pool"), _draws(), then="SELECT attack_class, noise, phase, count(*) AS n, round(sum(score), 4) AS total, sum(pos)::BIGINT AS pos FROM st GROUP BY ALL")),
    "j8_e2_e3_t5_trials": (q_trials, _sql(*STUDY, recursive=True, then="SELECT attack_class, noise, trial" + "".join(f", round({c}, 6) AS {c}" for c in (
        "recall_fixed", "recall_uncond", "recall_cond", "evasion_uncond", "evasion_cond", "t_uncond", "t_cond")) + " FROM trials")),
    "e14_cell_summary": (q_summary, _sql(*STUDY, _long_sql, _boot, "ci AS (SELECT attack_class, noise, policy, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bd GROUP BY ALL)",
        recursive=True, then="""SELECT attack_class, noise, policy, round(avg(recall), 6) AS recall, round(CASE WHEN policy = 'fixed' THEN any_value(T_op) ELSE avg(t) END, 6) AS t,
        round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi FROM l JOIN ci USING (attack_class, noise, policy), par GROUP BY attack_class, noise, policy""")),
    "h1_bootstrap_ci": (q_bootstrap, _sql(*STUDY, _long_sql, _boot,
        recursive=True, then="""SELECT attack_class, noise, policy, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM bd JOIN
        (SELECT attack_class, noise, policy, avg(recall) AS mean FROM l GROUP BY ALL) USING (attack_class, noise, policy) GROUP BY ALL""")),
    "e11_delta_t": (q_delta, _sql(*STUDY, recursive=True, then="SELECT attack_class, round(avg(t_uncond) FILTER (noise = 'high') - avg(t_uncond) FILTER (noise = 'none'), 6) AS delta_t FROM trials GROUP BY 1")),
    "e16_own_flags": (q_own, _sql(*STUDY, recursive=True, then="SELECT noise, round(avg(own_uncond), 6) AS own_uncond, round(avg(own_fixed), 6) AS own_fixed FROM trials GROUP BY noise")),
    "e13_box": (q_box, _sql(*STUDY, _long_sql, "q AS (SELECT noise, policy, quantile_cont(recall, 0.25) AS q1, quantile_cont(recall, 0.5) AS median, quantile_cont(recall, 0.75) AS q3, min(recall) AS low, max(recall) AS high FROM l WHERE attack_class = 'stealthy' AND recall IS NOT NULL GROUP BY ALL)",
        recursive=True, then="""SELECT noise, policy, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high,
        round(min(recall) FILTER (recall >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(recall) FILTER (recall <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
        FROM l JOIN q USING (noise, policy) WHERE attack_class = 'stealthy' GROUP BY noise, policy, q1, median, q3, low, high""")),
    "e13_box_thresholds": (q_box_thresholds, _sql(*STUDY, """q AS (SELECT noise, quantile_cont(t_uncond, 0.25) AS q1, quantile_cont(t_uncond, 0.5) AS median, quantile_cont(t_uncond, 0.75) AS q3, min(t_uncond) AS low, max(t_uncond) AS high FROM trials GROUP BY 1)""",
        recursive=True, then="""SELECT noise, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high,
        round(min(t_uncond) FILTER (t_uncond >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(t_uncond) FILTER (t_uncond <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM trials JOIN q USING (noise) GROUP BY noise, q1, median, q3, low, high""")),
    "t4_trial_trace": (q_trial_trace, _sql(*STUDY, recursive=True, then="SELECT noise, pos, phase, round(score, 6) AS score, round(u0, 6) AS u0, round(u1, 6) AS u1, round(c0, 6) AS c0, round(c1, 6) AS c1 FROM tr WHERE attack_class = 'stealthy' AND trial = 0")),
    "study_report": (q_report, _sql(*STUDY, *_report_ctes, recursive=True, then=_report_sql)),
    "e7_fpr_without_warmup": (q_warm_rates, _sql(*_tenant, recursive=True, then="SELECT " + ", ".join(f"round(avg(f_{p}::INT)" + (" FILTER (late)" if e == "late" else "") + f", 6) AS fpr_{p}_{e}" for e in ("all", "late") for p in ("fixed", "uncond", "cond"))
        + " FROM (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY tenant) >= 86400000000 AS late FROM tr) WHERE label = 'benign'")),
    "e10_episode_latency": (q_episode_latency, _sql(SPLIT, PAR, """r AS (SELECT tenant, ts, event_id, epoch_us(ts) AS us, label = 'attack' AS error, score > T_op AS alert FROM sp, par)""",
        "w AS (SELECT *, (error AND coalesce(us - max(us) FILTER (error) OVER (PARTITION BY tenant ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 172800000000, true))::INT AS fresh FROM r)",
        "b AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM w)",
        "e AS (SELECT tenant, burst::BIGINT AS burst, min(us) FILTER (error) AS lo, max(us) FILTER (error) AS hi, min(us) FILTER (alert) AS hit FROM b WHERE burst > 0 GROUP BY ALL)",
        then="SELECT tenant, burst, CASE WHEN hit <= hi THEN round((hit - lo) / 1e6, 3) END AS seconds FROM e")),
    "h2_kruskal": (q_kruskal, _sql(*STUDY, f"r AS (SELECT noise, t_uncond, {_rank.format(x='t_uncond')} AS r FROM trials WHERE t_uncond IS NOT NULL), g AS (SELECT sum(r) AS r, count(*) AS n FROM r GROUP BY noise), k AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM trials WHERE t_uncond IS NOT NULL GROUP BY t_uncond))",
        "h AS (SELECT (12.0::DOUBLE / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - any_value(t) / (sum(n) * sum(n) * sum(n) - sum(n))::DOUBLE) AS h FROM g, k)", recursive=True,
        then="SELECT round(h, 6) AS h, 2 AS df, round(exp(-h / 2), 6) AS p FROM h")),
    "h2_kruskal_event_types": (q_kruskal_types, f"""WITH r AS (SELECT event_type, value, {_rank.format(x='value')} AS r FROM events), g AS (SELECT sum(r) AS r, count(*)::DOUBLE AS n FROM r GROUP BY event_type),
        k AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*) AS c FROM events GROUP BY value)),
        h AS (SELECT (12.0::DOUBLE / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - any_value(t) / (sum(n) * sum(n) * sum(n) - sum(n))) AS h FROM g, k)
        SELECT round(h, 6) AS h, 4 AS df, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM h"""),
    "h1_poisson_bootstrap": (q_poisson, f"""WITH w AS (SELECT event_type, value, c * 8 + k AS rep, ('0x' || substr(md5(concat_ws('|', 'poisson', event_type, event_id, c)), 4 * k + 1, 4))::BIGINT AS u
        FROM events, (SELECT unnest(range(25)) AS c), (SELECT unnest(range(8)) AS k)),
        m AS (SELECT event_type, rep, sum(n * value) / sum(n) AS m FROM (SELECT *, {" + ".join(f"(u >= {t})::INT" for t in H._POISSON)} AS n FROM w) GROUP BY ALL HAVING sum(n) > 0)
        SELECT event_type, round((SELECT avg(value) FROM events e WHERE e.event_type = m.event_type), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi
        FROM m GROUP BY event_type"""),
    "h3_spearman": (q_spearman, _sql(*STUDY, f"v AS (SELECT {_level_sql} AS level, recall_uncond FROM trials WHERE recall_uncond IS NOT NULL)", recursive=True,
        then=f"SELECT round(rho, 6) AS rho, n, round(2 * {_tail.format(z='abs(rho) * sqrt(n - 1)')}, 6) AS p_normal FROM (SELECT corr(a, b) AS rho, count(*) AS n FROM (SELECT {_rank.format(x='level')} AS a, {_rank.format(x='recall_uncond')} AS b FROM v))")),
    "h4_wilcoxon": (q_wilcoxon, _sql(*STUDY, "dd AS (SELECT recall_cond - recall_uncond AS d, abs(recall_cond - recall_uncond) AS m FROM trials WHERE recall_cond <> recall_uncond)",
        f"w AS (SELECT coalesce(sum(r) FILTER (d > 0), 0) AS w, count(*)::DOUBLE AS n FROM (SELECT d, {_rank.format(x='m')} AS r FROM dd))",
        "t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM dd GROUP BY m))",
        "z AS (SELECT w, n, (w - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48::DOUBLE), 0) AS z FROM w, t)", recursive=True,
        then=f"SELECT round(w, 6) AS w, n::BIGINT AS n, round({_tail.format(z='z')}, 6) AS p_normal FROM z")),
    "h8_trial_unit": (q_unit, _sql(*STUDY, recursive=True, then="SELECT attack_class, noise, count(*) AS n, round(avg(recall_fixed), 6) AS recall_fixed FROM trials GROUP BY ALL")),
    "h5_jonckheere": (q_jonckheere, _sql(*STUDY, recursive=True, then=f"SELECT round(sum(u), 6) AS j FROM ({_mws})")),
    "h6_mann_whitney": (q_mann_whitney, _sql(*STUDY, recursive=True, then=f"SELECT a, b, round(u, 6) AS u FROM ({_mws})")),
    "h7_trend": (q_trend, _sql(*STUDY, recursive=True, then=f"SELECT round(regr_slope(t_uncond, {_level_sql}), 6) AS slope, round(corr(t_uncond, {_level_sql}), 6) AS r FROM trials")),
    "e5_e6_auc_ap": (q_auc, _sql(_lab, _curve, then="""SELECT round(sum(p * (nn - fp + n / 2)) / any_value(np * nn), 6) AS auc, round(sum(p / np * (tp / (tp + fp))), 6) AS ap FROM cv""")),
    "e9_recall_at_fpr": (q_recall_at_fpr, _sql(_lab, _curve, then="SELECT l AS fpr_limit, round(coalesce(max(tp / np) FILTER (fp / nn <= l), 0), 6) AS recall FROM cv, (SELECT unnest([0.01, 0.05, 0.2]::DOUBLE[]) AS l) GROUP BY l")),
    "e12_curve_points": (q_points, _sql(_lab, _curve, then="SELECT s, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr, round(tp / (tp + fp), 6) AS prec FROM cv")),
    "e12_histogram": (q_histogram, _sql(SPLIT, then="SELECT label, floor(score / 10)::BIGINT AS bin, count(*) AS n FROM sc GROUP BY ALL")),
    "e4_e8_f7_detector_quality": (q_f1, _sql(SPLIT, PAR, "x AS (SELECT label = 'attack' AS pos, score > T_op AS f, score > T0 AS f0 FROM sp, par WHERE split = 'TEST')", then="""SELECT round(count(*) FILTER (f AND pos) / count(*) FILTER (f), 6) AS precision,
        round(count(*) FILTER (f AND pos) / count(*) FILTER (pos), 6) AS recall, round(2 * count(*) FILTER (f AND pos) / (count(*) FILTER (f) + count(*) FILTER (pos)), 6) AS f1,
        round(avg(f0::INT) FILTER (pos), 6) AS recall_t0, round(avg(f0::INT) FILTER (NOT pos), 6) AS fpr_t0 FROM x""")),
    "e7_alerts_per_hour": (q_alerts, _sql(*_tenant, recursive=True, then="SELECT date_trunc('hour', ts) AS hour" + "".join(f", count(*) FILTER (f_{p}) AS alerts_{p}" for p in ("fixed", "uncond", "cond")) + " FROM tr GROUP BY 1")),
    "e10_detection_latency": (q_latency, _sql(SPLIT, PAR, "a AS (SELECT tenant, min(ts) AS a FROM sp WHERE label = 'attack' GROUP BY 1)", then="SELECT tenant, round((epoch_us(min(ts)) - epoch_us(any_value(a))) / 1e6, 3) AS seconds FROM sp JOIN a USING (tenant), par WHERE ts >= a AND score > T_op GROUP BY tenant")),
}
