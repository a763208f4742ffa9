"""Scorers against plain NumPy versions, the rank tests' tail and the bootstrap."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranktests, scorers


def data(n=600, d=6, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, 2)) @ rng.standard_normal((2, d)) + 0.05 * rng.standard_normal((n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)


def loss(w, x, noise):
    """What ``_gradient`` is the gradient of, written out."""
    w1, b1, wm, bm, wl, bl, w2, b2, w3, b3 = scorers._unpack(w, x.shape[1])
    h = np.tanh(x @ w1 + b1)
    mu, lv = h @ wm + bm, np.clip(h @ wl + bl, -8, 8)
    y = np.tanh((mu + np.exp(lv / 2) * noise) @ w2 + b2) @ w3 + b3
    return ((y - x) ** 2).sum() / 2 + scorers.KL * (np.exp(lv) + mu * mu - 1 - lv).sum() / 2


def test_gradient_against_differences():
    x = data(7)
    rng = np.random.default_rng(3)
    w = scorers.start_vae(6) + 0.1 * rng.standard_normal(len(scorers.start_vae(6)))
    noise = rng.standard_normal((7, scorers.LATENT))
    g = scorers._gradient(w, x, noise)
    for i in rng.choice(len(w), 60, replace=False):
        e = np.zeros_like(w)
        e[i] = 1e-5
        assert g[i] == pytest.approx((loss(w + e, x, noise) - loss(w - e, x, noise)) / 2e-5, rel=1e-4, abs=1e-5)


def test_mini_batches_do_not_depend_on_how_rows_arrive():
    x, state = data(), np.concatenate([scorers.start_vae(6), np.zeros(2 * len(scorers.start_vae(6)))])
    a = scorers.adam_steps(state, [x], 256, 1e-3, 0, np.random.default_rng(1))
    b = scorers.adam_steps(state, [x[:10], x[10:300], x[300:599], x[599:]], 256, 1e-3, 0, np.random.default_rng(1))
    assert a[1] == b[1] == 600 and np.array_equal(a[0], b[0])


def test_vae_fits_as_plain_numpy_does(spark):
    """One task: the same steps as a loop over the rows in hash order. Several tasks that average: a loss as low."""
    x = data()
    df = frame(spark, x)
    error = lambda w: ((scorers.vae_error(df, "x", w).agg({"recon": "avg"})).first()[0])
    state = np.concatenate([scorers.start_vae(6), np.zeros(2 * len(scorers.start_vae(6)))])
    for epoch in range(3):
        order = df.select("x", F.xxhash64(F.xxhash64("x"), F.lit(epoch)).alias("h")).orderBy("h").collect()
        state, _ = scorers.adam_steps(state, [np.array([r["x"] for r in order])], 64, 1e-2, 10 * epoch, np.random.default_rng([0, epoch, 0]))
    plain = state[: len(state) // 3]
    assert scorers.fit_vae(df, "x", epochs=3, batch=64, rate=1e-2) == pytest.approx(plain, abs=1e-9)
    start, one, several = (error(w) for w in (scorers.start_vae(6), scorers.fit_vae(df, "x", epochs=8, batch=64, rate=1e-2), scorers.fit_vae(df, "x", epochs=8, batch=64, rate=1e-2, least=3)))
    assert one < 0.5 * start and several < 0.6 * start


def test_vae_needs_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        scorers.fit_vae(frame(spark, data(2)).where("false"), "x")


def mixed(h):
    h = (h ^ (h >> 31)) * 0x7FB5D329728EA185 % 2**64
    return (h ^ (h >> 27)) >> 1


def test_every_tree_has_the_rows_of_its_smallest_keys(spark):
    x = data(900)
    df = frame(spark, x).repartition(7)
    hashes = {r["id"]: (r["a"] % 2**64, r["b"] % 2**64 | 1) for r in df.select("id", F.xxhash64(F.lit("0"), "id").alias("a"), F.xxhash64(F.lit("0'"), "id").alias("b")).collect()}
    forest = {r["tree"]: r for r in scorers.fit_isolation(df, "id", "x", trees=12, sample=50).collect()}
    assert sorted(forest) == list(range(12)) and {r["size"] for r in forest.values()} == {50}
    for t, r in forest.items():
        ids = sorted(hashes, key=lambda i: mixed((hashes[i][0] + t * hashes[i][1]) % 2**64))[:50]
        nodes, own = np.array(r["nodes"]).reshape(-1, 5), x[ids]
        f, cut = int(nodes[0, 0]), nodes[0, 1]
        assert own[:, f].min() <= cut <= own[:, f].max()
        # Every leaf's path is its depth and the mean path of the rows that fall into it, so leaves add up to the sample.
        def rows_of(node, idx):
            if nodes[node, 0] < 0:
                return [(node, len(idx))]
            left = own[idx, int(nodes[node, 0])] <= nodes[node, 1]
            return rows_of(int(nodes[node, 2]), idx[left]) + rows_of(int(nodes[node, 3]), idx[~left])

        leaves = rows_of(0, np.arange(50))
        assert sum(n for _, n in leaves) == 50 and all(n > 0 for _, n in leaves)
        depth = {0: 0}
        for i, (f, _, a, b, _) in enumerate(nodes):
            if f >= 0:
                depth[int(a)] = depth[int(b)] = depth[i] + 1
        assert all(nodes[i, 4] == pytest.approx(depth[i] + scorers.path_length(n)) for i, n in leaves)


def test_a_small_table_is_all_in_every_tree(spark):
    forest = scorers.fit_isolation(frame(spark, data(40)), "id", "x", trees=5).collect()
    assert len(forest) == 5 and {r["size"] for r in forest} == {40}


def test_scores_by_expressions_and_by_batches(spark):
    x = data(300)
    df = frame(spark, x)
    forest = scorers.fit_isolation(df, "id", "x", trees=30, sample=64)
    trees = [np.array(r["nodes"]).reshape(-1, 5) for r in forest.collect()]

    def path(t, row):
        i = 0
        while t[i, 0] >= 0:
            i = int(t[i, 2] if row[int(t[i, 0])] <= t[i, 1] else t[i, 3])
        return t[i, 4]

    want = {i: 2 ** (-np.mean([path(t, row) for t in trees]) / scorers.path_length(64)) for i, row in enumerate(x)}
    for score in (scorers.isolation_expression, scorers.isolation_score):
        assert {r["id"]: r["isolation"] for r in score(df, "x", forest).collect()} == pytest.approx(want)
        assert {r["isolation"] for r in score(df, "x", forest.where("false")).collect()} == {0.5}
    with pytest.raises(Exception, match="more than 8 levels"):
        nodes = [x for i in range(9) for x in (0.0, -float(i), 2.0 * i + 1, 2.0 * i + 2, 0.0, -1.0, 0.0, 0.0, 0.0, float(i))]
        chain = spark.createDataFrame([(0, 9, [*nodes, -1.0, 0.0, 0.0, 0.0, 9.0])], "tree int, size int, nodes array<double>")
        scorers.isolation_expression(df, "x", chain).collect()


def test_chi_square_tail(spark):
    """Against tables: the 5 % points, and far tails by numerical integration."""
    points = [(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (11.070498, 5), (18.307038, 10), (24.995790, 15)]
    got = spark.createDataFrame(points, "h double, df int").withColumn("p", ranktests.chi_square_tail(F.col("h"), F.col("df"))).collect()
    assert [r["p"] for r in got] == pytest.approx([0.05] * len(points), abs=1e-7)
    for k, h in ((3, 20.0), (6, 1.0), (7, 30.0)):
        grid = np.linspace(h, h + 200, 400_001)
        density = grid ** (k / 2 - 1) * np.exp(-grid / 2) / (2 ** (k / 2) * math.gamma(k / 2))
        got = spark.createDataFrame([(h, k)], "h double, df int").select(ranktests.chi_square_tail(F.col("h"), F.col("df"))).first()[0]
        assert got == pytest.approx(np.trapezoid(density, grid), rel=1e-6)


def test_kruskal_of_four_groups(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [4.0, 5.0, 6.0], "c": [7.0, 8.0, 9.0], "d": [10.0, 11.0, None]}
    r = ranktests.kruskal(spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double"), "g", "v").first()
    h = 12 / (11 * 12) * (6**2 / 3 + 15**2 / 3 + 24**2 / 3 + 21**2 / 2) - 3 * 12
    assert (r["h"], r["df"]) == (pytest.approx(h), 3) and 0.015 < r["p"] < 0.025
    tied = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert ranktests.kruskal(tied, "g", "v").first()["h"] is None


def test_poisson_bootstrap_is_near_the_exact_one(spark):
    rng = np.random.default_rng(5)
    x = rng.exponential(3.0, 400)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)] + [("n", 999, None), ("g", 1000, None)], "k string, ix long, v double")
    a = ranktests.poisson_bootstrap(df, ["k"], ["ix"], "v", 1000, "s").collect()
    means = rng.choice(x, (4000, 400)).mean(1)
    assert [r["k"] for r in a] == ["g"] and a[0]["mean"] == pytest.approx(x.mean())
    assert (a[0]["lo"], a[0]["hi"]) == (pytest.approx(np.percentile(means, 2.5), abs=0.06), pytest.approx(np.percentile(means, 97.5), abs=0.06))
