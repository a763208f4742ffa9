"""Unsupervised scorers: linear and variational reconstruction, isolation forest, their ensemble.

Models are small tables or arrays; fitting reads distributed data and sends back sums, samples of stated size or nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.7
#: Isolation forest: trees, rows for each and how deep they go. EULER is Euler's constant.
TREES, SAMPLE, DEPTH, EULER = 200, 256, 8, 0.5772156649015329
#: Variational autoencoder: hidden and latent sizes, weight of the divergence, learning rate, epochs, rows of a mini-batch.
HIDDEN, LATENT, KL, RATE, EPOCHS, BATCH = 24, 6, 0.5, 1e-3, 40, 256


def ensemble(za: str, zi: str, alpha: float = ALPHA):
    """alpha of the reconstruction score and the rest of the isolation score."""
    return alpha * F.col(za) + (1 - alpha) * F.col(zi)


def fit_linear(df: DataFrame, vector: str, k: int = 6):
    """The k principal directions, as the linear autoencoder of that width."""
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v")))


def linear_error(df: DataFrame, vector: str, model, out: str = "recon") -> DataFrame:
    """Mean squared error of what the directions reproduce; they are orthonormal, so it is |x|^2 - |V'x|^2 over d."""
    d = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    d = model.transform(d).withColumn(out, F.greatest(F.lit(0.0), square(vector_to_array("_v")) - square(vector_to_array("_p"))) / F.size(vector))
    return d.drop("_v", "_p")


def given_error(df: DataFrame, vector: str, directions: list[list[float]], out: str = "recon") -> DataFrame:
    """Mean squared reconstruction error for given orthonormal directions, in expressions alone."""
    x = F.col(vector).cast("array<double>")
    dot = lambda v: F.aggregate(F.zip_with(x, F.array(*map(F.lit, v)), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    norm = F.aggregate(x, F.lit(0.0), lambda s, t: s + t * t)
    for v in directions:
        norm = norm - dot(v) * dot(v)
    return df.withColumn(out, norm / F.size(vector))


def path_length(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n


def fit_isolation(df: DataFrame, id_col: str, vector: str, trees: int = TREES, sample: int = SAMPLE, seed: str = "0") -> DataFrame:
    """(tree, size, nodes): each tree grows on its own hash sample of normal training rows, exactly ``sample`` of them where
    there are as many.

    A row has two hashes, and its key for tree j is h1 + j * h2, mixed. Every task keeps the rows with the smallest keys of
    each tree, which merge: first within some hundred tasks, then over all. So one pass and no count are needed, and no
    task holds more than some thousand rows of a tree.
    """
    rows = df.select(F.xxhash64(F.lit(seed), F.col(id_col)).alias("a"), F.xxhash64(F.lit(f"{seed}'"), F.col(id_col)).alias("b"), F.col(vector).cast("array<double>").alias("x"))
    kept = rows.mapInPandas(_least_of(trees, sample), "tree int, key long, x array<double>").withColumn("room", F.shiftright(F.spark_partition_id(), 7))
    for by in (["tree", "room"], ["tree"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("key", "x"))
        kept = kept.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank")

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g.sort_values("key")["x"].to_numpy())
        rng = np.random.default_rng(int(g["tree"].iloc[0]))
        nodes: list[list[float]] = []

        def node(idx: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1.0, 0.0, 0.0, 0.0, depth + path_length(len(idx))])
            lo, hi = x[idx].min(0), x[idx].max(0)
            open_ = np.flatnonzero(hi > lo)
            if depth >= DEPTH or len(idx) < 2 or not len(open_):
                return me
            f = int(rng.choice(open_))
            cut = rng.uniform(lo[f], hi[f])
            left = x[idx, f] <= cut
            if left.all() or not left.any():
                return me
            a, b = node(idx[left], depth + 1), node(idx[~left], depth + 1)
            nodes[me][:4] = [f, cut, a, b]
            return me

        node(np.lexsort(x.T), 0)
        return pd.DataFrame({"tree": [int(g["tree"].iloc[0])], "size": [len(x)], "nodes": [[v for r in nodes for v in r]]})

    return kept.select("tree", "key", "x").groupBy("tree").applyInPandas(grow, "tree int, size int, nodes array<double>")


def _least_of(trees: int, sample: int):
    """Of a task's rows, those with the ``sample`` smallest keys of each tree. A bound for each tree's keys falls as rows
    come, so that soon nearly all rows are passed over."""
    numbers = np.arange(trees, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bound = np.full(trees, np.iinfo(np.int64).max)
        tree, key, held = np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                b = batch.iloc[lo : lo + 4096]
                h1, h2 = (b[c].to_numpy().view(np.uint64)[:, None] for c in ("a", "b"))
                h = h1 + numbers * (h2 | np.uint64(1))
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
                keys = ((h ^ (h >> np.uint64(27))) >> np.uint64(1)).view(np.int64)
                row, new = np.nonzero(keys < bound)
                tree, key = np.concatenate([tree, new]), np.concatenate([key, keys[row, new]])
                held += list(b["x"].to_numpy()[row])
                if len(key) > 4 * trees * sample:
                    tree, key, held = least(tree, key, held, bound)
        tree, key, held = least(tree, key, held, bound)
        yield pd.DataFrame({"tree": tree, "key": key, "x": held})

    def least(tree, key, held, bound):
        order = np.lexsort((key, tree))
        first = np.searchsorted(tree[order], np.arange(trees + 1))
        place = np.arange(len(order)) - first[tree[order]]
        full = np.flatnonzero(place == sample - 1)
        bound[tree[order][full]] = key[order][full]
        kept = order[place < sample]
        return tree[kept], key[kept], [held[i] for i in kept]

    return run


def isolation_score(df: DataFrame, vector: str, forest: DataFrame, out: str = "isolation") -> DataFrame:
    """2 ** (-mean path / normal path): higher is stranger; 0.5 without trees.

    Arrow batches walk a tree at a time with all of their rows, which takes a tenth of the time of ``isolation_expression``.
    The forest, at most trees times 511 nodes, goes along with the function.
    """
    trees = [(r["size"], np.array(r["nodes"]).reshape(-1, 5)) for r in sorted(forest.collect(), key=lambda r: r["tree"])]
    norm = max(1e-9, path_length(float(np.mean([s for s, _ in trees] or [2]))))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v) or not trees:
            return pd.Series(np.full(len(v), 0.5))
        x = np.stack(v.to_numpy())
        total = np.zeros(len(x))
        for _, t in trees:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                left = x[inner, f[inner]] <= t[at[inner], 1]
                at[inner] = np.where(left, t[at[inner], 2], t[at[inner], 3]).astype(int)
            total += t[at, 4]
        return pd.Series(2.0 ** (-(total / len(trees)) / norm))

    return df.withColumn(out, score(F.col(vector).cast("array<double>")))


def isolation_expression(df: DataFrame, vector: str, forest: DataFrame, out: str = "isolation") -> DataFrame:
    """As ``isolation_score`` in expressions alone, for plans that should have no Python worker and no collected model,
    such as streams.

    The forest, of at most trees times 511 nodes, is laid out as full binary trees of ``DEPTH`` levels, in which the
    children of place i are 2 i + 1 and 2 i + 2, and comes as one broadcast row of arrays. A row walks it in expressions:
    nothing is collected, and no Python runs over rows. A step of a walk takes some 0.4 microseconds.
    """
    trees = F.col("_trees")
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    laid = forest.mapInPandas(_laid_out, "tree int, size int, f array<int>, cut array<double>, path array<double>")
    all_ = F.sort_array(F.collect_list(F.struct("tree", "f", "cut", "path")))
    one = laid.agg(all_.alias("_all"), F.avg("size").alias("_m"), F.count("*").cast("int").alias("_trees")).select(
        "_m", "_trees", *(F.flatten(F.col(f"_all.{c}")).alias(f"_{c}") for c in ("f", "cut", "path"))
    )
    m = F.col("_m")
    normal = F.when(m <= 1, 0.0).when(m == 2, 1.0).otherwise(2 * (F.log(m - 1) + EULER) - 2 * (m - 1) / m)

    def path(tree: Column) -> Column:
        def on(at: Column, _: Column) -> Column:
            place = tree * inner + at
            right = F.get("_x", F.get("_f", place)) > F.get("_cut", place)
            return at + at + F.when(right, 2).otherwise(1)

        leaf = F.aggregate("_levels", F.lit(0), on)
        return F.get("_path", tree * leaves + leaf - inner)

    levels = F.array(*(F.lit(0) for _ in range(DEPTH)))
    numbers = F.sequence(F.lit(0), trees - 1)
    one = one.withColumns({"_levels": levels, "_numbers": F.when(trees > 0, numbers), "_normal": F.greatest(F.lit(1e-9), normal)})
    mean = F.aggregate("_numbers", F.lit(0.0), lambda s, t: s + path(t)) / trees
    d = df.withColumn("_x", F.col(vector).cast("array<double>")).crossJoin(F.broadcast(one))
    return d.withColumn(out, F.when(trees > 0, F.pow(F.lit(2.0), -mean / F.col("_normal"))).otherwise(0.5)).drop(
        "_x", "_m", "_trees", "_f", "_cut", "_path", "_levels", "_numbers", "_normal"
    )


def _laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trees as arrays by place. Below a leaf all go left, so every row ends on the last level."""
    for b in batches:
        rows = []
        for tree, size, nodes in zip(b["tree"], b["size"], b["nodes"], strict=True):
            t = np.asarray(nodes, float).reshape(-1, 5)
            f, cut, path = np.zeros(2**DEPTH - 1, np.int32), np.full(2**DEPTH - 1, np.inf), np.zeros(2**DEPTH)
            todo = [(0, 0)]
            while todo:
                node, place = todo.pop()
                leaf = t[node, 0] < 0
                if place >= len(f):
                    if not leaf:
                        raise ValueError(f"a tree of more than {DEPTH} levels")
                    path[place - len(f)] = t[node, 4]
                elif leaf:
                    todo.append((node, 2 * place + 1))
                else:
                    f[place], cut[place] = t[node, :2]
                    todo += [(int(t[node, 2]), 2 * place + 1), (int(t[node, 3]), 2 * place + 2)]
            rows.append((tree, size, f, cut, path))
        yield pd.DataFrame(rows, columns=["tree", "size", "f", "cut", "path"])


def _vae_shapes(d: int) -> list[tuple[int, ...]]:
    return [(d, HIDDEN), (HIDDEN,), (HIDDEN, LATENT), (LATENT,), (HIDDEN, LATENT), (LATENT,), (LATENT, HIDDEN), (HIDDEN,), (HIDDEN, d), (d,)]


def _unpack(flat: np.ndarray, d: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in _vae_shapes(d):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def fit_vae(df: DataFrame, vector: str, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 0, least: int = 16) -> np.ndarray:
    """Weights of a variational autoencoder, by Adam over mini-batches.

    An epoch deals the rows anew by a hash of the row and the epoch. Every task takes Adam steps over mini-batches of its
    rows, from the weights and moments that all tasks share, and an epoch ends with the mean of what they have come to,
    weighted by rows. A task gets ``least`` mini-batches or more, so a small table is plain mini-batch Adam in one task.
    What the driver holds are the weights and two moments, some thousand numbers.
    """
    first = df.select(vector).first()
    if first is None:
        raise ValueError("no rows to fit on")
    d = len(first[0])
    state = np.concatenate([start_vae(d, seed), np.zeros(2 * sum(math.prod(s) for s in _vae_shapes(d)))])
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.xxhash64(F.col(vector).cast("array<double>")).alias("h"))
    n = rows.count()
    parts, done = max(1, n // (batch * least)), 0
    for epoch in range(epochs):
        mixed = F.xxhash64("h", F.lit(epoch))
        dealt = rows.select("x", mixed.alias("h")).repartition(parts, "h").sortWithinPartitions("h", "x")

        def local(batches: Iterator[pa.RecordBatch], state=state, done=done, epoch=epoch) -> Iterator[pa.RecordBatch]:
            noise = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            now, seen = adam_steps(state, (b["x"].flatten().to_numpy().reshape(-1, d) for b in batches if len(b)), batch, rate, done, noise)
            if seen:
                yield pa.RecordBatch.from_pydict({"now": [now], "seen": [float(seen)]})

        ends = dealt.select("x").mapInArrow(local, "now array<double>, seen double").select(array_to_vector("now").alias("now"), "seen")
        state = ends.select(Summarizer.mean(F.col("now"), F.col("seen"))).first()[0].toArray()
        done += max(1, -(-n // (parts * batch)))
    return state[: len(state) // 3]


def start_vae(d: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.standard_normal(s) * (1 / np.sqrt(s[0])) if len(s) == 2 else np.zeros(s)).ravel() for s in _vae_shapes(d)])


def adam_steps(state: np.ndarray, arrays: Iterable[np.ndarray], batch: int, rate: float, done: int, noise: np.random.Generator) -> tuple[np.ndarray, int]:
    """(weights and moments after, rows seen): one step for each ``batch`` rows, and one for what is left."""
    w, m, v = (x.copy() for x in np.split(state, 3))
    seen, held = 0, []

    def step(x: np.ndarray) -> None:
        nonlocal w, m, v, seen, done
        done += 1
        g = _gradient(w, x, noise.standard_normal((len(x), LATENT))) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
        seen += len(x)

    for x in arrays:
        held.append(x)
        while sum(map(len, held)) >= batch:
            rows = np.concatenate(held)
            step(rows[:batch])
            held = [rows[batch:]]
    if sum(map(len, held)):
        step(np.concatenate(held))
    return np.concatenate([w, m, v]), seen


def _gradient(flat: np.ndarray, x: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Sum over rows of the gradient of squared error / 2 + KL divergence."""
    w1, b1, wm, bm, wl, bl, w2, b2, w3, b3 = _unpack(flat, x.shape[1])
    h = np.tanh(x @ w1 + b1)
    mu, lv = h @ wm + bm, np.clip(h @ wl + bl, -8, 8)
    s = np.exp(lv / 2)
    z = mu + s * noise
    k = np.tanh(z @ w2 + b2)
    e = k @ w3 + b3 - x
    dk = (e @ w3.T) * (1 - k * k)
    dz = dk @ w2.T
    dmu, dlv = dz + KL * mu, dz * noise * s / 2 + KL * (np.exp(lv) - 1) / 2
    dh = (dmu @ wm.T + dlv @ wl.T) * (1 - h * h)
    parts = (x.T @ dh, dh.sum(0), h.T @ dmu, dmu.sum(0), h.T @ dlv, dlv.sum(0), z.T @ dk, dk.sum(0), k.T @ e, e.sum(0))
    return np.concatenate([p.ravel() for p in parts])


def vae_error(df: DataFrame, vector: str, weights: np.ndarray, out: str = "recon") -> DataFrame:
    """Mean squared reconstruction error at the latent mean."""
    @F.pandas_udf("double")
    def error(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.stack(v.to_numpy())
        w1, b1, wm, bm, _, _, w2, b2, w3, b3 = _unpack(weights, x.shape[1])
        y = np.tanh((np.tanh(x @ w1 + b1) @ wm + bm) @ w2 + b2) @ w3 + b3
        return pd.Series(((y - x) ** 2).mean(1))

    return df.withColumn(out, error(F.col(vector).cast("array<double>")))
