"""Queries over sequences: sources, filters, windows, features, scaling and scorers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.portable import h32_sql, rounded
from tidemark.operators import features as X
from tidemark.operators import metrics as E
from tidemark.operators import ranges as R
from tidemark.operators import sampling as J
from tidemark.operators import scaling as N
from tidemark.operators import scorers as M
from tidemark.operators import windows as W
from tidemark.sources import tables as S

#: The alphabet in feature order, the tokens that tell attacks, and their groups, for each source.
EVENTS = ["click", "error", "purchase", "view"]
RARE = ["error", "purchase"]
LINES = ["AF", "NF", "NO", "RF"]
LINES_RARE = ["NF", "NO"]
#: Tokens in a vocabulary: more than the event types or line states there are.
TOP = 20
#: Share of windows that a frequent pattern stands in.
SUPPORT = 0.6
GROUPS = {"click": "browse", "view": "browse", "error": "fault", "purchase": "buy", "signup": "buy"}

SEQ = """seq AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM events)"""
SEQ_LINES = """seq AS (SELECT l_suppkey AS seq_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
    l_extendedprice, l_quantity) - 1 AS pos, l_returnflag || l_linestatus AS token FROM lineitem)"""


def _flt(alphabet: list[str] | None) -> str:
    where = f"WHERE token IN ({', '.join(map(repr, alphabet))})" if alphabet else ""
    return f"flt AS (SELECT seq_id, token, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS pos FROM seq {where})"


WIN = """arr AS (SELECT seq_id, list(token ORDER BY pos) AS a FROM flt GROUP BY seq_id HAVING count(*) >= 5),
    win AS (SELECT seq_id, w AS win_ix, a[w * 2 + 1 : least(w * 2 + 10, len(a))] AS tokens FROM
        (SELECT seq_id, a, unnest(range(0, CASE WHEN len(a) >= 10 THEN (len(a) - 10) // 2 + 1 ELSE 1 END)) AS w FROM arr))"""


def _feat(alphabet: list[str], rare: list[str]) -> str:
    freq = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) / len(tokens)::DOUBLE" for t in alphabet)
    pres = ", ".join(f"list_contains(tokens, '{t}')::INT::DOUBLE" for t in rare)
    return f"""f0 AS (SELECT *, [{freq}] AS freq, [{pres}] AS pres FROM win),
    feat AS (SELECT *, coalesce(-list_sum(list_transform(list_filter(freq, lambda p: p > 0), lambda p: p * log2(p))), 0) AS entropy,
        len(list_distinct(tokens)) / {len(alphabet)}::DOUBLE AS unique_ratio, list_max(freq) AS max_freq FROM f0)"""


def _sql(*ctes: str, then: str) -> str:
    return "WITH " + ",\n    ".join(ctes) + "\n" + then


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.sliding_windows(W.alphabet_filter(S.event_sequences(spark, d), EVENTS))


def line_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.sliding_windows(W.alphabet_filter(S.line_sequences(spark, d), LINES))


def event_features(spark: SparkSession, d: str) -> DataFrame:
    return X.assemble(event_windows(spark, d), EVENTS, RARE)


def _named(df: DataFrame, alphabet: list[str], rare: list[str]) -> DataFrame:
    n, m = len(alphabet), len(rare)
    at = lambda i: F.round(F.get("features", F.lit(i)), 6)
    return df.select(
        "seq_id", "win_ix", *(at(i).alias(f"freq_{t.lower()}") for i, t in enumerate(alphabet)), *(at(n + i).alias(f"pres_{t.lower()}") for i, t in enumerate(rare)),
        at(n + m).alias("entropy"), at(n + m + 1).alias("unique_ratio"), at(n + m + 2).alias("max_freq"),
    )


def _named_sql(alphabet: list[str], rare: list[str]) -> str:
    freq = "".join(f", round(freq[{i + 1}], 6) AS freq_{t.lower()}" for i, t in enumerate(alphabet))
    pres = "".join(f", round(pres[{i + 1}], 6) AS pres_{t.lower()}" for i, t in enumerate(rare))
    return f"SELECT seq_id, win_ix{freq}{pres}, round(entropy, 6) AS entropy, round(unique_ratio, 6) AS unique_ratio, round(max_freq, 6) AS max_freq FROM feat"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mean features of each sequence."""
    rows = _named(event_features(spark, d), EVENTS, RARE)
    return rows.groupBy("seq_id").agg(F.count("*").alias("windows"), *(F.round(F.avg(c), 6).alias(c) for c in ("entropy", "unique_ratio", "max_freq")))


def q_io1(spark, d):
    return R.long_sequences(S.table(spark, d, "lineitem"), "l_suppkey", S.LINE_ORDER, F.concat("l_returnflag", "l_linestatus"))


def q_io2(spark, d):
    """A dictionary as text, made of the event types, written and read by the dictionary source."""
    types = S.table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("id"))
    abi = F.when(F.col("event_type") == "signup", "x32").otherwise("common")
    lines = types.select(F.concat_ws(" ", F.col("id").cast("string"), abi, "event_type", F.lit("entry")).alias("value"))
    path = S.scratch(spark)
    extra = types.agg(F.count("*").alias("n")).select(F.explode(F.array(F.lit("# id abi name"), F.lit(""), F.lit("x common bad"), F.lit("7 short"))).alias("value"))
    lines.unionByName(extra).write.text(path)
    return S.load_dictionary(spark, path)


def q_f1_f2(spark, d):
    return W.min_length(W.alphabet_filter(S.event_sequences(spark, d), EVENTS)).select("seq_id", "pos", "token", "n")


def q_f6(spark, d):
    events = S.table(spark, d, "events")
    late = W.drop_warmup(events, "user_id", "ts", 86_400)
    both = events.groupBy("user_id").agg(F.count("*").alias("n_all")).join(late.groupBy("user_id").agg(F.count("*").alias("n_late")), "user_id", "left")
    return both.select("user_id", "n_all", F.coalesce("n_late", F.lit(0)).alias("n_late"))


def _joined(df):
    return df.select("seq_id", "win_ix", F.array_join("tokens", " ").alias("tokens"))


def q_w1(spark, d):
    token = F.concat("l_returnflag", "l_linestatus")
    return _joined(R.long_windows(S.table(spark, d, "lineitem"), "l_suppkey", S.LINE_ORDER, token, LINES))


def q_w1_one(spark, d):
    """All events as one sequence: a key that no task could hold at scale."""
    events = S.table(spark, d, "events").withColumn("one", F.lit(1).cast("long"))
    return _joined(R.long_windows(events, "one", ["ts", "event_id"], F.col("event_type"), EVENTS))


def q_w3(spark, d):
    return _joined(W.sliding_windows(S.event_sequences(spark, d)))


def q_w4(spark, d):
    return W.window_grid(S.line_sequences(spark, d), [(10, 2), (15, 3), (5, 1), (25, 5)])


def q_features(spark, d):
    return _named(event_features(spark, d), EVENTS, RARE)


def q_features_lines(spark, d):
    return _named(X.assemble(line_windows(spark, d), LINES, LINES_RARE), LINES, LINES_RARE)


def q_x7(spark, d):
    return X.top_vocabulary(W.sliding_windows(S.line_sequences(spark, d)), TOP).select("token", "n", F.col("rank").cast("long").alias("rank"))


def q_x8(spark, d):
    windows = W.sliding_windows(S.event_sequences(spark, d))
    rows = X.vocabulary_freq(windows, X.top_vocabulary(windows, TOP))
    return rows.select("seq_id", "win_ix", *(F.round(F.get("freq", F.lit(i)), 6).alias(f"f{i + 1}") for i in range(len(GROUPS))))


def q_x9(spark, d):
    rows = X.group_freq(W.sliding_windows(S.event_sequences(spark, d)), GROUPS)
    return rows.select("seq_id", "win_ix", *(F.round(f"grp_{g}", 6).alias(f"grp_{g}") for g in ("browse", "buy", "fault")))


def q_x10(spark, d):
    rows = X.gaps(S.table(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", 10)
    return rows.select("user_id", "block", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "longest")))


def q_x11(spark, d):
    return X.frequent_patterns(event_windows(spark, d), SUPPORT, 3)


def q_x11_match(spark, d):
    windows = S.written(event_windows(spark, d))
    rows = X.pattern_match(windows, X.frequent_patterns(windows, SUPPORT, 3))
    return rows.select("seq_id", "win_ix", F.size(F.filter("matched", lambda m: m)).cast("long").alias("n"), F.round("match_ratio", 6).alias("ratio"))


def _vectors(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def q_n1(spark, d):
    v = _vectors(spark, d)
    scaled = N.robust_scale(v, "x", N.fit_robust(v.where("label < 8"), "x"))
    return scaled.select("vec_id", F.posexplode("scaled").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), rounded(F.col("value"), 6).alias("value"))


def _components(spark, d):
    f = event_features(spark, d)
    n = len(EVENTS) + len(RARE)
    return f.select("seq_id", "win_ix", F.get("features", F.lit(n)).alias("ent"), F.get("features", F.lit(n + 2)).alias("mx"), (F.col("pres")[0] > 0).alias("attack"))


def q_n2(spark, d):
    c = _components(spark, d)
    z = N.component_z(c, ["ent", "mx"], c.where("NOT attack"))
    return z.select("seq_id", "win_ix", *(rounded(c, 6).alias(n) for n, c in (("z_ent", F.col("z_ent")), ("z_mx", F.col("z_mx")), ("score", M.ensemble("z_ent", "z_mx")))))


def q_m1(spark, d):
    v = _vectors(spark, d)
    scored = M.linear_error(v, "x", M.fit_linear(v.where("label < 8"), "x", 6))
    return scored.select("vec_id", "label", F.round("recon", 6).alias("recon"))


def q_m1_given(spark, d):
    unit = [[1.0 if i == j else 0.0 for i in range(64)] for j in range(6)]
    return M.given_error(_vectors(spark, d), "x", unit).select("vec_id", F.round("recon", 9).alias("recon"))


def q_m2(spark, d):
    v = _vectors(spark, d)
    normal = v.where("label < 8")
    scaled = S.written(N.robust_scale(v, "x", N.fit_robust(normal, "x")))
    weights = M.fit_vae(scaled.where("label < 8"), "scaled")
    return M.vae_error(scaled, "scaled", weights).select("vec_id", "label", "recon")


def q_m2_given(spark, d):
    size = sum(map(math.prod, M._vae_shapes(64)))
    weights = np.array([(k * 37 % 101 - 50) / 400 for k in range(size)])
    return M.vae_error(_vectors(spark, d), "x", weights).select("vec_id", F.round("recon", 9).alias("recon"))


def _vae_sql() -> str:
    """The encoder's mean and the decoder, layer by layer, with the weights of ``q_m2_given``."""
    at, starts = 0, []
    for shape in M._vae_shapes(64):
        starts.append(at)
        at += math.prod(shape)
    w1, b1, wm, bm, _, _, w2, b2, w3, b3 = starts
    weight = lambda k: f"((({k}) * 37 % 101 - 50)::DOUBLE / 400)"
    layer = lambda x, n, m, w, b: (
        f"list_transform(range({m}), lambda j: list_sum(list_transform(range({n}), lambda i: {x}[i + 1] * {weight(f'{w} + i * {m} + j')})) + {weight(f'{b} + j')})"
    )
    bent = lambda layer: f"list_transform({layer}, lambda v: tanh(v))"
    h, z = M.HIDDEN, M.LATENT
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), a AS MATERIALIZED (SELECT *, {bent(layer("x", 64, h, w1, b1))} AS h FROM v),
        b AS MATERIALIZED (SELECT *, {layer("h", h, z, wm, bm)} AS z FROM a), c AS MATERIALIZED (SELECT *, {bent(layer("z", z, h, w2, b2))} AS k FROM b),
        y AS MATERIALIZED (SELECT *, {layer("k", h, 64, w3, b3)} AS y FROM c)
        SELECT vec_id, round(list_avg(list_transform(range(64), lambda i: (y[i + 1] - x[i + 1]) * (y[i + 1] - x[i + 1]))), 9) AS recon FROM y"""


def q_m5_given(spark, d):
    """Eight trees given as nodes (feature, cut, left, right, path): two cuts each, leaves at three path lengths."""
    trees = [(t, M.SAMPLE, [float(x) for n in ((t, 0, 1, 2, 0), (-1, 0, 0, 0, 3.5), (t + 1, 0.05, 3, 4, 0), (-1, 0, 0, 0, 2), (-1, 0, 0, 0, 3.25)) for x in n]) for t in range(8)]
    forest = spark.createDataFrame(trees, "tree int, size int, nodes array<double>")
    return M.isolation_expression(_vectors(spark, d), "x", forest).select("vec_id", F.round("isolation", 9).alias("isolation"))


_walk = " + ".join(f"CASE WHEN x[{t + 1}] <= 0 THEN 3.5 WHEN x[{t + 2}] <= 0.05::DOUBLE THEN 2 ELSE 3.25 END" for t in range(8))


def q_m4(spark, d):
    f = event_features(spark, d).withColumn("id", F.concat_ws("-", "seq_id", "win_ix"))
    forest = M.fit_isolation(f.where("NOT array_contains(tokens, 'error')"), "id", "features")
    return M.isolation_score(f, "features", forest).select("seq_id", "win_ix", "isolation")


def q_m7(spark, d):
    c = _components(spark, d)
    z = N.component_z(c, ["ent", "mx"], c.where("NOT attack"))
    wide = z.withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.7, 0.85, 1.0)))))
    wide = wide.withColumn("score", F.round(F.col("alpha") * F.col("z_ent") + (1 - F.col("alpha")) * F.col("z_mx"), 9))
    return E.auc(E.curve(wide, "score", F.col("attack"), ["alpha"]), ["alpha"]).select("alpha", F.round("auc", 6).alias("auc"))


def q_j1(spark, d):
    return J.cap_sample(S.table(spark, d, "lineitem").select("l_orderkey").distinct(), "l_orderkey", 500, "cap")


def q_j6(spark, d):
    types = S.table(spark, d, "events").groupBy(F.col("event_type").alias("token")).agg(F.min("event_id").alias("id"))
    return J.token_ids(S.event_sequences(spark, d), types).groupBy("seq_id").agg(F.sum("id").alias("ids"), F.count("*").alias("n"))


def q_j9(spark, d):
    """Windows of ten events, labelled by overlap with a user's bursts of errors, which are under two days apart."""
    events = S.table(spark, d, "events")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    windows = events.withColumn("block", ((F.row_number().over(by_time) - 1) / 10).cast("long")).groupBy("user_id", "block").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
    errors = events.where("event_type = 'error'")
    fresh = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by_time).cast("timestamp")) >= 2 * 86_400_000_000).cast("int"), F.lit(1))
    bursts = errors.withColumn("fresh", fresh).withColumn("burst", F.sum("fresh").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    bursts = bursts.groupBy("user_id", "burst").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return R.in_intervals(windows, bursts, "user_id").select("user_id", "block", "label")


_z = """c AS (SELECT seq_id, win_ix, entropy AS ent, max_freq AS mx, pres[1] > 0 AS attack FROM feat),
    p AS (SELECT quantile_cont(ent, 0.5) AS ce, quantile_cont(ent, 0.75) - quantile_cont(ent, 0.25) AS re, quantile_cont(mx, 0.5) AS cm,
        quantile_cont(mx, 0.75) - quantile_cont(mx, 0.25) AS rm FROM c WHERE NOT attack),
    z AS (SELECT c.*, (ent - ce) / CASE WHEN re = 0 THEN 1 ELSE re END AS z_ent, (mx - cm) / CASE WHEN rm = 0 THEN 1 ELSE rm END AS z_mx FROM c, p)"""
_event = (SEQ, _flt(EVENTS), WIN)
_patterns = f"""u AS MATERIALIZED (SELECT seq_id, win_ix, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM win),
    held AS MATERIALIZED (SELECT DISTINCT seq_id, win_ix, t AS pattern FROM u
        UNION ALL SELECT DISTINCT seq_id, win_ix, a.t || '>' || b.t FROM u a JOIN u b USING (seq_id, win_ix) WHERE a.i < b.i
        UNION ALL SELECT DISTINCT seq_id, win_ix, a.t || '>' || b.t || '>' || c.t FROM u a JOIN u b USING (seq_id, win_ix) JOIN u c USING (seq_id, win_ix) WHERE a.i < b.i AND b.i < c.i),
    frequent AS MATERIALIZED (SELECT pattern, count(*) AS freq FROM held GROUP BY 1 HAVING count(*) >= {SUPPORT} * (SELECT count(*) FROM win))"""

QUERIES = {
    "flagship_sequence_profile": (flagship, _sql(*_event, _feat(EVENTS, RARE), then="""SELECT seq_id, count(*) AS windows, round(avg(round(entropy, 6)), 6) AS entropy,
        round(avg(round(unique_ratio, 6)), 6) AS unique_ratio, round(avg(round(max_freq, 6)), 6) AS max_freq FROM feat GROUP BY seq_id""")),
    "io1_load_sequences": (q_io1, _sql(SEQ_LINES, then="SELECT seq_id, pos, token FROM seq")),
    "io2_load_dictionary": (q_io2, "SELECT event_type AS token, min(event_id) AS id FROM events WHERE event_type <> 'signup' GROUP BY event_type"),
    "f1_f2_alphabet_min_length": (q_f1_f2, _sql(SEQ, _flt(EVENTS), then="SELECT seq_id, pos, token, n FROM (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM flt) WHERE n >= 5")),
    "f6_drop_warmup": (q_f6, """SELECT user_id, count(*) AS n_all, count(*) FILTER (epoch_us(ts) - epoch_us(first_ts) >= 86400000000) AS n_late
        FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events) GROUP BY user_id"""),
    "w1_w2_sliding_windows": (q_w1, _sql(SEQ_LINES, _flt(LINES), WIN, then="SELECT seq_id, win_ix, array_to_string(tokens, ' ') AS tokens FROM win")),
    "w1_one_long_sequence": (q_w1_one, _sql("seq AS (SELECT 1::BIGINT AS seq_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM events)", _flt(EVENTS), WIN,
        then="SELECT seq_id, win_ix, array_to_string(tokens, ' ') AS tokens FROM win")),
    "w3_windows_full": (q_w3, _sql(SEQ, _flt(None), WIN, then="SELECT seq_id, win_ix, array_to_string(tokens, ' ') AS tokens FROM win")),
    "w4_window_grid": (q_w4, """SELECT g.l::INT AS length, g.s::INT AS stride, seq_id, (CASE WHEN n >= g.l THEN (n - g.l) // g.s + 1 ELSE 1 END)::BIGINT AS n_windows
        FROM (SELECT l_suppkey AS seq_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5), (VALUES (10, 2), (15, 3), (5, 1), (25, 5)) g(l, s)"""),
    "x1_x6_features_events": (q_features, _sql(*_event, _feat(EVENTS, RARE), then=_named_sql(EVENTS, RARE))),
    "x1_x6_features_lineitem": (q_features_lines, _sql(SEQ_LINES, _flt(LINES), WIN, _feat(LINES, LINES_RARE), then=_named_sql(LINES, LINES_RARE))),
    "x7_top_vocabulary": (q_x7, _sql(SEQ_LINES, _flt(None), WIN, then="""SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) AS rank
        FROM (SELECT unnest(tokens) AS token FROM win) GROUP BY token ORDER BY n DESC, token LIMIT 20""")),
    "x8_vocabulary_freq": (q_x8, _sql(SEQ, _flt(None), WIN, """v AS (SELECT list(token ORDER BY n DESC, token) AS w FROM (SELECT token, count(*) AS n FROM
        (SELECT unnest(tokens) AS token FROM win) GROUP BY token ORDER BY n DESC, token LIMIT 20))""", then="SELECT seq_id, win_ix" + "".join(
        f", round(len(list_filter(tokens, lambda x: x = w[{i}])) / len(tokens)::DOUBLE, 6) AS f{i}" for i in range(1, len(GROUPS) + 1)) + " FROM win, v")),
    "x9_group_freq": (q_x9, _sql(SEQ, _flt(None), WIN, then="SELECT seq_id, win_ix" + "".join(
        ", round(len(list_filter(tokens, lambda x: x IN (%s))) / len(tokens)::DOUBLE, 6) AS grp_%s" % (", ".join(f"'{t}'" for t, x in GROUPS.items() if x == g), g)
        for g in ("browse", "buy", "fault")) + " FROM win")),
    "x10_gaps": (q_x10, """WITH g AS (SELECT user_id, (row_number() OVER w - 1) // 10 AS block, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, block, count(*) AS n, round(avg(gap), 4) AS mean, round(stddev_samp(gap), 4) AS std, round(max(gap), 4) AS longest FROM g WHERE gap IS NOT NULL GROUP BY ALL"""),
    "x11_frequent_patterns": (q_x11, _sql(*_event, _patterns, then="SELECT pattern, freq FROM frequent")),
    "x11_pattern_match": (q_x11_match, _sql(*_event, _patterns, then="""SELECT win.seq_id, win.win_ix, count(f.pattern) AS n, round(count(f.pattern) / (SELECT count(*) FROM frequent)::DOUBLE, 6) AS ratio
        FROM win LEFT JOIN held USING (seq_id, win_ix) LEFT JOIN frequent f ON f.pattern = held.pattern GROUP BY ALL""")),
    "n1_robust_scale": (q_n1, """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
        f AS (SELECT dim, quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.99) - quantile_cont(x, 0.01) AS s FROM v WHERE label < 8 GROUP BY dim)
        SELECT vec_id, dim, round((x - c) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM v JOIN f USING (dim)"""),
    "n2_m6_component_z_ensemble": (q_n2, _sql(*_event, _feat(EVENTS, RARE), _z, then="""SELECT seq_id, win_ix, round(z_ent, 6) AS z_ent, round(z_mx, 6) AS z_mx,
        round(0.7::DOUBLE * z_ent + (1 - 0.7::DOUBLE) * z_mx, 6) AS score FROM z""")),
    "m1_linear_reconstruction": (q_m1, None),
    "m1_reconstruction_given": (q_m1_given, """SELECT vec_id, round((list_sum(list_transform(x, lambda t: t * t)) - list_sum(list_transform(x[1:6], lambda t: t * t))) / 64, 9) AS recon
        FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"""),
    "m2_m3_vae_reconstruction": (q_m2, None),
    "m2_vae_given": (q_m2_given, _vae_sql()),
    "m4_m5_isolation_forest": (q_m4, None),
    "m5_isolation_given": (q_m5_given, f"SELECT vec_id, round(pow(2::DOUBLE, -(({_walk})::DOUBLE / 8) / {float(M.path_length(M.SAMPLE))!r}::DOUBLE), 9) AS isolation FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"),
    "m7_alpha_sweep": (q_m7, _sql(*_event, _feat(EVENTS, RARE), _z, """w AS (SELECT a AS alpha, attack, round(a * z_ent + (1 - a) * z_mx, 9) AS s FROM z,
        (SELECT unnest([0.0, 0.25, 0.5, 0.7, 0.85, 1.0]::DOUBLE[]) AS a)), r AS (SELECT *, rank() OVER (PARTITION BY alpha ORDER BY s) +
        (count(*) OVER (PARTITION BY alpha, s) - 1) / 2 AS r FROM w)""", then="""SELECT alpha, round((sum(r) FILTER (attack) - count(*) FILTER (attack) * (count(*) FILTER (attack) + 1) / 2)
        / (count(*) FILTER (attack) * count(*) FILTER (NOT attack)), 6) AS auc FROM r GROUP BY alpha""")),
    "j1_cap_sample": (q_j1, f"SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY {h32_sql(repr('cap'), 'l_orderkey')}, l_orderkey LIMIT 500"),
    "j6_token_ids": (q_j6, """SELECT user_id AS seq_id, sum(id)::BIGINT AS ids, count(*) AS n FROM events JOIN (SELECT event_type, min(event_id) AS id FROM events GROUP BY 1) USING (event_type) GROUP BY 1"""),
    "j9_interval_labels": (q_j9, """WITH w AS (SELECT user_id, block, min(ts) AS start, max(ts) AS stop FROM (SELECT user_id, ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS block
        FROM events) GROUP BY ALL), e AS (SELECT user_id, ts, event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 172800000000)::INT, 1) AS fresh
        FROM events WHERE event_type = 'error'), i AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e) GROUP BY user_id, g)
        SELECT user_id, block, EXISTS (SELECT 1 FROM i WHERE i.user_id = w.user_id AND start <= hi AND stop >= lo)::INT AS label FROM w"""),
}
