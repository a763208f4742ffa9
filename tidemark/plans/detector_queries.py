"""The detector end to end, its arms, and the policy study on its own scores.

Windows of the events table are attacks if they hold an error. Half of the users' other windows train, the rest calibrates
and tests. The arms with given models have SQL twins of every step; the trained ones run the same functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.portable import h32, h32_sql
from tidemark.operators import calibrate as C
from tidemark.operators import detector as D
from tidemark.operators import features as X
from tidemark.operators import scorers as M
from tidemark.operators import windows as W
from tidemark.plans import score_queries as Q
from tidemark.plans.sequence_queries import EVENTS, RARE, SEQ, TOP, WIN, _feat, _flt, event_features
from tidemark.sources import tables as S

#: Directions that a given reconstruction keeps, and given trees: feature, cut, left, right, path by node.
KEPT, TREES = 2, 3
NODES = [[(t, 0.25, 1, 2, 0.0), (-1, 0.0, 0, 0, 3.5), (t + 1, 0.5, 3, 4, 0.0), (-1, 0.0, 0, 0, 2.0), (-1, 0.0, 0, 0, 5.25)] for t in range(TREES)]


def _is_train() -> Column:
    return (h32("train", F.col("seq_id")) % 2 == 0) & (F.col("label") == "benign")


def _named(windows: DataFrame) -> DataFrame:
    label = F.when(F.array_contains("tokens", "error"), "attack").otherwise("benign")
    return windows.withColumns({"event_id": F.concat_ws("-", "seq_id", "win_ix"), "label": label})


def filtered(spark: SparkSession, d: str) -> DataFrame:
    """Windows over the alphabet with their features x."""
    return S.written(_named(event_features(spark, d)).select("event_id", "seq_id", "label", F.col("features").alias("x")))


def unfiltered(spark: SparkSession, d: str) -> DataFrame:
    """Windows without the alphabet's filter; x are frequencies of the commonest tokens of training windows."""
    w = S.written(_named(W.sliding_windows(S.event_sequences(spark, d))))
    x = X.vocabulary_freq(w, X.top_vocabulary(w.where(_is_train()), TOP)).select("event_id", "seq_id", "label", F.col("freq").alias("x"))
    return S.written(x)


def given_recon(rows: DataFrame, train: DataFrame) -> DataFrame:
    d = len(train.select("scaled").first()[0])
    return M.given_error(rows, "scaled", [[1.0 if i == j else 0.0 for i in range(d)] for j in range(KEPT)])


def given_forest(rows: DataFrame, train: DataFrame) -> DataFrame:
    trees = [(t, M.SAMPLE, [float(x) for n in nodes for x in n]) for t, nodes in enumerate(NODES)]
    return M.isolation_score(rows, "scaled", rows.sparkSession.createDataFrame(trees, "tree int, size int, nodes array<double>"))


def _scores(windows: DataFrame, arm: str, recon: D.Scorer, isolate: D.Scorer) -> DataFrame:
    scored = D.score_windows(windows, "x", _is_train(), recon, isolate)
    return D.held_out(scored.select("event_id", "label", "score", "_train"), "event_id", "cal").withColumn("arm", F.lit(arm))


def given_scores(spark: SparkSession, d: str) -> DataFrame:
    """Held-out scores of both arms with given models; several queries read them."""
    return S.once(spark, "given arms", d, "events", lambda spark, d: _scores(filtered(spark, d), "filtered", given_recon, given_forest)
                  .unionByName(_scores(unfiltered(spark, d), "unfiltered", given_recon, given_forest)))


def trained_scores(spark: SparkSession, d: str) -> DataFrame:
    """Held-out scores of the three arms: linear and variational on filtered windows, variational without the filter."""
    with_filter, without = filtered(spark, d), unfiltered(spark, d)
    forest = D.isolation("event_id")
    arms = (("linear", with_filter, D.linear(3)), ("variational", with_filter, D.variational()), ("unfiltered", without, D.variational()))
    out = None
    for arm, windows, recon in arms:
        one = _scores(windows, arm, recon, forest)
        out = one if out is None else out.unionByName(one)
    return out


QUALITY = [*C.POINTS, "auc", "ap", "recall_t0", "fpr_t0"]
COUNTS = ["n_cal", "n_test", "n_attack"]


def _rounded(report: DataFrame) -> DataFrame:
    return report.select("arm", *COUNTS, *(F.round(c, 6).alias(c) for c in QUALITY))


def q_detector(spark, d):
    """Three trained arms: scores and report written, the report read back."""
    scores, path = S.written(trained_scores(spark, d)), S.scratch(spark)
    S.write_scores(scores.select("arm", "label", "event_id", "split", "score"), f"{path}/scores")
    report = D.nested(D.report(scores))
    S.write_report(report, f"{path}/report")
    r = spark.read.schema(report.schema).json(f"{path}/report")
    return _rounded(r.select("arm", "windows.*", "calibration.*", "test_quality.*"))


def q_arms(spark, d):
    """Both arms with given models in one report."""
    return _rounded(D.report(given_scores(spark, d)))


def q_arm_scores(spark, d):
    return given_scores(spark, d).select("arm", "event_id", "label", "split", F.round("score", 6).alias("score"))


def q_study(spark, d):
    """The policy study on the detector's scores, by arm."""
    cell = ["arm", *Q.CELL]
    t = Q.trials_of(Q.arm_streams(spark, given_scores(spark, d)), cell)
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return t.groupBy("arm", "attack_class", "noise").agg(F.count("*").alias("n"), *map(mean, ("recall_fixed", "recall_uncond", "recall_cond", "evasion_uncond", "evasion_cond", "t_uncond", "t_cond")))


def _arm_sql(unfiltered_: bool) -> tuple[str, ...]:
    """Windows to split scores ``sp`` of one arm, with the given models."""
    h = h32_sql("'train'", "seq_id")
    if unfiltered_:
        x = """vo AS (SELECT list(token ORDER BY n DESC, token) AS w FROM (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM nm WHERE train) GROUP BY token ORDER BY n DESC, token LIMIT %d)),
            xs AS (SELECT event_id, label, train, list_transform(w, lambda t: len(list_filter(tokens, lambda y: y = t)) / len(tokens)::DOUBLE) AS x FROM nm, vo)""" % TOP
        feat, source = (), "win"
    else:
        feat, source = (_feat(EVENTS, RARE),), "feat"
        x = "xs AS (SELECT event_id, label, train, list_concat(freq, pres, [entropy, unique_ratio, max_freq]) AS x FROM nm)"
    walk = " + ".join(f"CASE WHEN s[{t + 1}] <= 0.25::DOUBLE THEN 3.5::DOUBLE WHEN s[{t + 2}] <= 0.5::DOUBLE THEN 2 ELSE 5.25 END" for t in range(TREES))
    points = lambda c: f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r_{c}"
    z = lambda c: f"(({c} - c_{c}) / CASE WHEN r_{c} = 0 THEN 1 ELSE r_{c} END)"
    return (
        SEQ, _flt(None if unfiltered_ else EVENTS), WIN, *feat,
        f"nm AS MATERIALIZED (SELECT *, seq_id || '-' || win_ix AS event_id, CASE WHEN list_contains(tokens, 'error') THEN 'attack' ELSE 'benign' END AS label, NOT list_contains(tokens, 'error') AND {h} % 2 = 0 AS train FROM {source})",
        x,
        "fit AS (SELECT dim, quantile_cont(v, 0.5) AS c, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS r FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM xs WHERE train) GROUP BY dim)",
        "fl AS (SELECT list(c ORDER BY dim) AS c, list(CASE WHEN r = 0 THEN 1 ELSE r END ORDER BY dim) AS r FROM fit)",
        "sd AS MATERIALIZED (SELECT event_id, label, train, list_transform(range(len(x)), lambda i: (x[i + 1] - c[i + 1]) / r[i + 1]) AS s FROM xs, fl)",
        f"""er AS MATERIALIZED (SELECT *, (list_sum(list_transform(s, lambda t: t * t)) - list_sum(list_transform(s[1:{KEPT}], lambda t: t * t))) / len(s) AS recon,
            pow(2::DOUBLE, -(({walk})::DOUBLE / {TREES}) / {float(M.path_length(M.SAMPLE))!r}::DOUBLE) AS iso FROM sd)""",
        f"zp AS (SELECT {points('recon')}, {points('iso')} FROM er WHERE train)",
        f"sc AS MATERIALIZED (SELECT event_id, label, round({M.ALPHA}::DOUBLE * {z('recon')} + (1 - {M.ALPHA}::DOUBLE) * {z('iso')}, {D.DIGITS}) AS score FROM er, zp WHERE NOT train)",
        f"""sp AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {h32_sql("'cal'", "event_id")}, event_id) <= count(*) OVER (PARTITION BY label) // 2 THEN 'CAL' ELSE 'TEST' END AS split FROM sc)""",
    )


def _both(then: str, *more: str, recursive: bool = False) -> str:
    return " UNION ALL ".join("SELECT * FROM (" + Q._sql(*_arm_sql(arm == "unfiltered"), *more, recursive=recursive, then=then.replace("{arm}", arm)) + ")" for arm in ("filtered", "unfiltered"))


_curve = """cv AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, p, n, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM
    (SELECT score AS s, count(*) FILTER (label = 'attack') AS p, count(*) FILTER (label <> 'attack') AS n FROM sp WHERE split = 'TEST' GROUP BY s) WINDOW w AS (ORDER BY s DESC))"""
_rates = """rt AS (SELECT count(*) FILTER (split = 'CAL') AS n_cal, count(*) FILTER (split = 'TEST') AS n_test, count(*) FILTER (split = 'TEST' AND label = 'attack') AS n_attack,
    avg((score > T0)::INT) FILTER (split = 'TEST' AND label = 'attack') AS recall_t0, avg((score > T0)::INT) FILTER (split = 'TEST' AND label = 'benign') AS fpr_t0 FROM sp, par)"""
_quality = "SELECT '{arm}' AS arm, " + ", ".join(COUNTS) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in QUALITY) + """ FROM rt, par,
    (SELECT sum(p * (nn - fp + n / 2)) / nullif(any_value(np * nn), 0) AS auc, sum(p / np * (tp / (tp + fp))) AS ap FROM cv)"""
_means = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("recall_fixed", "recall_uncond", "recall_cond", "evasion_uncond", "evasion_cond", "t_uncond", "t_cond"))

QUERIES = {
    "detector_end_to_end": (q_detector, None),
    "detector_scores_given": (q_arm_scores, _both("SELECT '{arm}' AS arm, event_id, label, split, round(score, 6) AS score FROM sp")),
    "io6_scorer_arms": (q_arms, _both(_quality, Q.PAR, _curve, _rates)),
    "study_on_detector": (q_study, _both(f"SELECT '{{arm}}' AS arm, attack_class, noise, count(*) AS n, {_means} FROM trials GROUP BY attack_class, noise", *Q.STUDY[1:], recursive=True)),
}
