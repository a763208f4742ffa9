"""Values that can be worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate, metrics, ranktests, sampling, scaling, thresholds, windows
from tidemark.operators import features as X


def seq(spark, lengths):
    rows = [(i, p, "abc"[p % 3]) for i, n in enumerate(lengths) for p in range(n)]
    return spark.createDataFrame(rows, "seq_id long, pos long, token string")


def test_window_counts(spark):
    lengths = [4, 5, 9, 10, 11, 12, 13]
    got = {r["seq_id"]: r["n"] for r in windows.sliding_windows(seq(spark, lengths)).groupBy("seq_id").agg(F.count("*").alias("n")).collect()}
    assert [got.get(i, 0) for i in range(len(lengths))] == [0, 1, 1, 1, 1, 2, 2]


def test_filter_comes_before_windows(spark):
    kept = windows.alphabet_filter(seq(spark, [9]), ["a", "c"])
    assert [r["pos"] for r in kept.orderBy("pos").collect()] == list(range(6))


def test_feature_example(spark):
    alphabet = ["openat", "execve", "mmap", "clone", "ptrace"] + [f"t{i}" for i in range(19)]
    tokens = ["openat"] * 4 + ["execve"] * 2 + ["mmap"] * 2 + ["clone", "ptrace"]
    df = spark.createDataFrame([(tokens,), (["openat"] * 10,)], "tokens array<string>")
    one, same = X.assemble(df, alphabet, ["ptrace"]).collect()
    assert one["freq"][:5] == pytest.approx([0.4, 0.2, 0.2, 0.1, 0.1]) and sum(one["freq"]) == pytest.approx(1)
    assert one["pres"] == [1.0] and one["features"][-3:] == pytest.approx([2.1219, 5 / 24, 0.4], abs=1e-4)
    assert same["features"][-3:] == pytest.approx([0, 1 / 24, 1]) and len(one["features"]) == 24 + 1 + 3


def stream(spark, scores, t_op=10.0, t_min=1.0):
    return spark.createDataFrame([(1, i, float(a), t_op, t_min) for i, a in enumerate(scores)], "k int, pos long, score double, T_op double, T_min double")


def trace(df):
    rows = df.orderBy("pos").collect()
    return [r["T_after"] for r in rows], [r["flagged"] for r in rows]


def test_policies(spark):
    s = stream(spark, [20, 0, 20])
    t, f = trace(thresholds.ema(s, ["k"], ["pos"]))
    assert t == pytest.approx([11, 9.9, 10.91]) and f == [True, False, True]
    t, f = trace(thresholds.ema_conditional(s, ["k"], ["pos"]))
    assert t == pytest.approx([10, 9, 9]) and f == [True, False, True]
    assert trace(thresholds.fixed(s)) == ([10.0] * 3, [True, False, True])


def test_tie_is_not_flagged_and_floor_absorbs(spark):
    t, f = trace(thresholds.ema_conditional(stream(spark, [10, 0]), ["k"], ["pos"]))
    assert f == [False, False] and t == pytest.approx([10, 9])
    t, _ = trace(thresholds.ema_conditional(stream(spark, [5, 0.5, 1], t_op=1.0), ["k"], ["pos"]))
    assert t == [1.0, 1.0, 1.0]


def test_closed_form_equals_fold_beyond_a_block(spark):
    scores = [(i * 7919 % 101) / 5 for i in range(1300)]
    t, flags = trace(thresholds.ema(stream(spark, scores), ["k"], ["pos"]))
    want, expected = 10.0, []
    for a, f in zip(scores, flags):
        assert f == (a > want)
        want = max(1.0, 0.9 * want + 0.1 * a)
        expected.append(want)
    assert t == pytest.approx(expected, abs=1e-9)
    cond, _ = trace(thresholds.ema_conditional(stream(spark, scores), ["k"], ["pos"]))
    assert all(x >= y for x, y in zip(cond, cond[1:])) and min(cond) >= 1
    fold = thresholds.conditional_floor(stream(spark, scores), ["k"], ["pos"]).first()["T_final"]
    assert fold == pytest.approx(cond[-1])
    want, folded = 10.0, []
    for a in scores:
        want = max(1.0, 0.9 * want + 0.1 * a) if a <= want else want
        folded.append(want)
    assert cond == pytest.approx(folded, abs=1e-12)
    want = 10.0
    for a in scores:
        want = min(8.0, max(1.0, 0.9 * want + 0.1 * a))
    assert thresholds.ema_capped(stream(spark, scores), ["k"], ["pos"], 0.8).first()["T_final"] == pytest.approx(want, abs=1e-9)


def test_closed_form_across_rooms(spark, monkeypatch):
    from tidemark.functions import ordered

    monkeypatch.setattr(ordered, "BLOCK", 4)
    scores = [(i * 7919 % 101) / 5 for i in range(300)]
    rows = [(k, i, float(a), 10.0, 1.0) for k in (1, 2) for i, a in enumerate(scores[k:])]
    d = spark.createDataFrame(rows, "k int, pos long, score double, T_op double, T_min double")
    got = {(r["k"], r["pos"]): r["T_after"] for r in thresholds.ema(d, ["k"], ["pos"]).collect()}
    capped = {r["k"]: r["T_final"] for r in thresholds.ema_capped(d, ["k"], ["pos"], 0.8).collect()}
    for k in (1, 2):
        t, c = 10.0, 10.0
        for i, a in enumerate(scores[k:]):
            t, c = max(1.0, 0.9 * t + 0.1 * a), min(8.0, max(1.0, 0.9 * c + 0.1 * a))
            assert got[k, i] == pytest.approx(t, abs=1e-9)
        assert capped[k] == pytest.approx(c, abs=1e-9)


def test_quantiles_equal_percentiles(spark):
    from tidemark.functions.ordered import quantiles

    rows = [(i % 3, None if i % 11 == 0 else float(i * 37 % 50)) for i in range(400)] + [(7, 2.0), (8, float("inf")), (8, 1.0)]
    d = spark.createDataFrame(rows, "g int, x double")
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    for by in ([], ["g"]):
        got = quantiles(d, "x", points, by).collect()
        want = d.groupBy(*by).agg(*(F.expr(f"percentile(x, {q}D)").alias(n) for n, q in points.items())).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in want} or sorted(map(tuple, got)) == [pytest.approx(tuple(r)) for r in sorted(map(tuple, want))]
    assert [tuple(r) for r in quantiles(d.limit(0), "x", points).collect()] == [(None,) * 5]


def test_bands(spark):
    par = dict(T_op=5.0, bp50=1.0, bp90=4.0, bp999=8.0)
    benign = spark.createDataFrame([(x,) for x in (1.0, 4.0, 4.1)], "score double").withColumns({k: F.lit(v) for k, v in par.items()})
    attack = spark.createDataFrame([(x,) for x in (5.0, 8.0, 8.1)], "score double").withColumns({k: F.lit(v) for k, v in par.items()})
    assert [r["band"] for r in calibrate.noise_band(benign).orderBy("score").collect()] == ["none", "moderate", "high"]
    assert [r["band"] for r in calibrate.attack_band(attack).orderBy("score").collect()] == ["stealthy", "loud"]


def test_quantiles_are_linear(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "score double")
    assert calibrate.calibrate(df).first()["T_op"] == pytest.approx(8.95)


def test_split_half(spark):
    df = spark.range(7).select(F.lit("a").alias("label"), F.col("id"))
    got = [r["split"] for r in sampling.split_half(df, "label", "id", "s").collect()]
    assert got.count("CAL") == 3 and got.count("TEST") == 4


def test_zero_range_keeps_rare_bits(spark):
    df = spark.createDataFrame([([0.0],)] * 300 + [([1.0],)], "x array<double>")
    got = scaling.robust_scale(df, "x", scaling.fit_robust(df, "x")).agg(F.max(F.col("scaled")[0])).first()[0]
    assert got == 1.0


def test_auc_with_ties_and_its_mirror(spark):
    rows = [(True, 3.0), (True, 1.0), (False, 1.0), (False, 0.0), (False, 5.0)]
    df = spark.createDataFrame(rows, "pos boolean, s double")
    a = metrics.auc(metrics.curve(df, "s", F.col("pos"))).first()["auc"]
    b = metrics.auc(metrics.curve(df.withColumn("s", -F.col("s")), "s", F.col("pos"))).first()["auc"]
    assert a == pytest.approx(3.5 / 6) and a + b == pytest.approx(1)


def test_kruskal_tail(spark):
    df = spark.createDataFrame([(g, float(v)) for g, v in zip("aaabbbccc", range(9))], "g string, v double")
    r = ranktests.kruskal(df, "g", "v").first()
    assert r["h"] == pytest.approx(7.2) and r["p"] == pytest.approx(math.exp(-3.6))


def test_wilcoxon_drops_zeros(spark):
    df = spark.createDataFrame([(2.0, 1.0), (3.0, 1.0), (1.0, 1.0), (0.0, 3.0)], "a double, b double")
    r = ranktests.wilcoxon(df, "a", "b").first()
    assert (r["w"], r["n"]) == (3.0, 3)
    assert r["p_normal"] == pytest.approx(0.5)


def test_spearman_tail(spark):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(10)], "a double, b double")
    r = ranktests.spearman(df, "a", "b").first()
    assert r["rho"] == pytest.approx(-1) and r["p_normal"] == pytest.approx(math.erfc(3 / math.sqrt(2)))


def test_a_trial_has_one_row(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None)], "cell string, trial int, recall double")
    assert {tuple(r) for r in ranktests.one_row_per_trial(df, ["cell", "trial"]).collect()} == {("a", 1, 0.5), ("a", 2, None)}
    with pytest.raises(Exception, match="several rows"):
        ranktests.one_row_per_trial(df.union(df), ["cell", "trial"]).collect()


def test_patterns_stand_in_order_with_gaps(spark):
    windows = spark.createDataFrame([(["a", "c", "b"],), (["b", "a"],), ([],)], "tokens array<string>")
    patterns = spark.createDataFrame([("a>b",), ("b",)], "pattern string")
    got = X.pattern_match(windows, patterns).select("matched", "match_ratio").collect()
    assert [tuple(r) for r in got] == [([True, True], 1.0), ([False, True], 0.5), ([False, False], 0.0)]
    assert {r["match_ratio"] for r in X.pattern_match(windows, patterns.limit(0)).collect()} == {0.0}


def test_a_shared_result_follows_its_source(spark, tmp_path):
    """Made once while the source's files stay, and anew when they change."""
    from tidemark.sources import tables

    made = []

    def build(spark, d):
        made.append(d)
        return spark.read.parquet(f"{d}/t.parquet")

    read = lambda: sorted(r["id"] for r in tables.once(spark, "probe", str(tmp_path), "t", build).collect())
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert read() == read() == [0, 1, 2] and len(made) == 1
    spark.range(5, 6).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert read() == [0, 1, 2, 5] and len(made) == 2
    spark.range(9).write.parquet(f"{tmp_path}/other/t.parquet")
    assert tables.once(spark, "probe", f"{tmp_path}/other", "t", build).count() == 9 and len(made) == 3
    assert read() == [0, 1, 2, 5] and len(made) == 3


def test_kruskal_of_more_rows_than_a_cube_in_a_long_allows(spark):
    """2.2 million rows in two groups, by the formula in whole numbers and fractions; the third group's value is all ties."""
    from fractions import Fraction

    n, values = 2_200_000, 1000
    got = ranktests.kruskal(spark.range(n).select((F.col("id") % 3).alias("g"), (F.col("id") % values).cast("double").alias("v")), "g", "v").first()
    each = n // values
    sums, sizes = [Fraction(0)] * 3, [0] * 3
    for g in range(3):
        for v in range(values):
            c = len(range(next(i for i in range(v, v + 3 * values, values) if i % 3 == g), n, 3 * values))
            sums[g] += c * (v * each + Fraction(each + 1, 2))
            sizes[g] += c
    h = (Fraction(12, n * (n + 1)) * sum(s * s / k for s, k in zip(sums, sizes)) - 3 * (n + 1)) / (1 - Fraction(values * (each**3 - each), n**3 - n))
    assert got["df"] == 2 and got["h"] == pytest.approx(float(h), abs=1e-6)
    one = ranktests.wilcoxon(spark.range(2_200_000).select(F.lit(2.0).alias("a"), F.lit(1.0).alias("b")), "a", "b").first()
    assert one["n"] == 2_200_000 and one["w"] == 2_200_000 * 2_200_001 / 2


def test_quantiles_round_once(spark):
    """Between neighbours the weighted sum is a fused multiply-add, equal neighbours included, as in the SQL twins."""
    from tidemark.functions.ordered import quantiles

    rows = [(g, ((g * 7919 + i * i * 31) % 31) / 30) for g in range(60) for i in range(35 + g % 6)]
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 0.99}
    got = quantiles(spark.createDataFrame(rows, "g int, v double"), "v", points, ["g"]).collect()
    for r in got:
        v = sorted(x for g, x in rows if g == r["g"])
        for name, q in points.items():
            at = (len(v) - 1) * q
            low, high, share = v[math.floor(at)], v[math.ceil(at)], at % 1
            assert r[name] == (math.fma(low, 1 - share, high * share) if share else low)
    inf = spark.createDataFrame([(-math.inf,), (-math.inf,), (1.0,)], "v double")
    assert quantiles(inf, "v", {"q": 0.25, "m": 0.75}).first()[:] == (-math.inf, -math.inf)


def test_rounded_keeps_the_sign_of_what_goes_to_zero(spark):
    from tidemark.functions.portable import rounded

    x = [-2e-7, 2e-7, -1.2345675, 1.2345675, 0.0, None, math.inf]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(rounded(F.col("v"), 6)).collect()]
    assert [str(v) for v in got] == ["-0.0", "0.0", "-1.234568", "1.234568", "0.0", "None", "inf"]


def test_j6_reads_every_event(spark):
    from tidemark.plans import registry

    d = "/root/testdata/sf0.001"
    assert registry.QUERIES["j6_token_ids"](spark, d).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{d}/events.parquet").count()
