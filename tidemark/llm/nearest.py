"""Operator 6, approximate nearest neighbours by NN-descent.

Equal vectors are one node, however many rows have them; a node's number names its page and its place there. The graph
starts from a few small leaves of each node, one of random nodes and some that random hyperplanes cut; within them nodes
compare themselves. NN-descent then lets the neighbours of each node, and the nodes it is a neighbour of, compare
themselves with each other, unless both were compared before; what beats a node's worst neighbour replaces it, round by
round until few edges change. A query starts from its own node's neighbours and walks the graph greedily: from the best
nodes it knows to their neighbours, until they lead to nothing new. Recall is measured on a sample of the queries, and
the walk goes on from more nodes until it is reached. The best that a query has met are then scored exactly on the
original vectors.

Edges travel between pages by Spark's shuffles, thousands to a row, and a vector goes once to each page that asks for it:
a row for each edge, or a vector with each, costs many times the work that the comparison itself is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, discard, mixed, stash, table

#: Leaves of a node at the start, the first one random; nodes in a leaf, about: a part of all, within bounds.
TREES, LEAF_PART, LEAF = 8, 16, (64, 512)
#: Leaves that a task takes together, as a power of two.
CELL = 6
#: Neighbours of a node from one leaf, and in the graph; as many incoming edges of a node, the nearest, are followed.
FROM_LEAF, NEIGHBOURS = 12, 28
#: Places in a node's list whose edges are always walked in both directions.
FIRST = 2
#: NN-descent ends when a round changes less than this share of the edges, and the search goes on from more nodes.
CHANGED = 0.2
#: Greedy search: nodes that a query goes on from, at first; nodes that it keeps for each of them.
BEAM, KEPT = 32, 2
#: The best that a query has met, of which so many for each result are scored exactly.
BEST = 4
#: The search is widened until this recall is measured on a sample of so many queries.
RECALL, SAMPLE = 0.93, 200
#: Pages at least (fewer for small tables), nodes of a page, about, and bits of a node's place in its page.
PAGES, PAGE, PLACE = 24, 1 << 16, 17
#: Dot products that are made in one go.
GO = 1 << 16
SEED = 5
NODES = "node long, key long, v binary, unit binary"
GRAPH = "node long, near array<long>, sims array<float>, fresh array<boolean>"
#: Edges on their way to a page: ends, similarities and marks, in order of each other.
SENT = "page int, a binary, b binary, s binary, f binary"
NONE = {"a": np.empty(0, np.uint32), "b": np.empty(0, np.uint32), "s": np.empty(0, np.float32), "f": np.empty(0, np.uint8)}


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows by cosine for each row where ``queries`` holds.

    Returns query_id, rank (from 1), vec_id, score (cosine in double precision on the original vectors); nearest first,
    ties to smaller ids; fewer rows if there are fewer candidates. Rows with a null id, and vectors that are null, empty,
    zero, hold null or non-finite components, or differ in length from the most common length take no part. Rows
    repeated with id and vector count once. Other columns, whatever their names, are ignored. An empty table gives an
    empty result. Vectors of any length are compared whole. The result is approximate, but a score is always exact.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL").mapInArrow(_taken, "id long, asks boolean, d int, v binary")
    rows = stash(rows.withColumn("key", F.xxhash64("v")))
    most = rows.select("id", "key", "d").distinct().groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = most[0]["d"] if most else 1
    rows = rows.where(F.col("d") == d)
    n = rows.agg(F.count_distinct("key")).first()[0]
    pages = max(min(PAGES, n // 256), -(-n // PAGE), 1)
    if pages << PLACE > 1 << 32:
        raise ValueError("more vectors than numbers for them")
    nodes = rows.groupBy("key").agg(F.first("v").alias("v")).withColumn("page", F.pmod("key", F.lit(pages)).cast("int"))
    nodes = stash(nodes.groupBy("page").applyInArrow(_numbered, "node long, key long, v binary").mapInArrow(_unit, NODES))
    rows = stash(rows.groupBy("id", "key").agg(F.max("asks").alias("asks")).join(nodes.select("key", "node"), "key").select("id", "asks", "node"))

    graph = _leaves(nodes, n, d)
    while _changed(graph) > CHANGED:
        after = _descended(graph, nodes)
        discard(graph)
        graph = after

    asking = rows.where("asks").select("id", "node")
    asked = stash(nodes.join(asking.select("node").distinct(), "node").select("node", "v"))
    # What equals the query, its own node, is the first that it has met.
    met = stash(_walked(graph, nodes, asked, k).select(F.col("node").alias("q"), F.explode(F.slice("near", 1, BEST * k + 1)).alias("x")))

    # The k + 1 smallest ids of a node are all that can be in a result; the limit applies before the shuffle.
    by_id = Window.partitionBy("node").orderBy("id")
    few = rows.select("node", "id").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    exact = met.join(nodes.select(F.col("node").alias("x"), F.col("v").alias("vx")), "x").join(asked.select(F.col("node").alias("q"), F.col("v").alias("vq")), "q")
    exact = exact.select("q", "x", "vq", "vx").mapInArrow(_scored, "q long, x long, score double")
    least = few.where("r = 1").select(F.col("node").alias("x"), F.col("id").alias("low"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    exact = exact.join(least, "x").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("q", "x", "score")
    found = exact.join(few.select(F.col("node").alias("x"), "id"), "x").withColumnRenamed("id", "vec_id")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asking.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(found, "q").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors take part, the vectors as bytes of doubles."""
    for b in batches:
        keep, size, out = [], [], []
        v = b["v"]
        ends, values = v.offsets.to_numpy(), v.values
        whole = values.fill_null(float("nan")).to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
        for i, there in enumerate(v.is_valid().to_pylist()):
            x = whole[ends[i] : ends[i + 1]]
            if there and len(x) and np.isfinite(x).all() and x.any():
                keep.append(i)
                size.append(len(x))
                out.append(x.tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b["id"].take(at), b["asks"].take(at), pa.array(size, pa.int32()), pa.array(out, pa.binary())], ["id", "asks", "d", "v"])


def _numbered(t: pa.Table) -> pa.Table:
    """Nodes of a page with their numbers."""
    if t.num_rows > 1 << PLACE:
        raise ValueError("a page has more vectors than numbers for them")
    page = np.int64(t["page"][0].as_py())
    return pa.table({"node": (page << PLACE) + np.arange(t.num_rows), "key": t["key"], "v": t["v"]})


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in half precision, which is enough to build a graph."""
    for b in batches:
        if b.num_rows:
            units = _normed(b["v"].to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([u.tobytes() for u in units], pa.binary())], [*b.schema.names, "unit"])


def _normed(vectors: list) -> np.ndarray:
    """Unit vectors of lists, or bytes, of doubles."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1) if isinstance(vectors[0], bytes) else np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _changed(graph: DataFrame) -> float:
    """Share of the edges that are new."""
    r = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new"), F.sum(F.size("near")).alias("n")).first()
    return (r["new"] or 0) / max(1, r["n"] or 0)


def _true(asked: DataFrame, nodes: DataFrame, k: int) -> dict[int, set[int]]:
    """The ``k`` nearest nodes of a sample of the queries' nodes, by comparison with all nodes."""
    rows = asked.orderBy(F.xxhash64("node")).limit(SAMPLE).collect()
    ids = np.array([r["node"] for r in rows], np.int64)
    sample = _normed([bytes(r["v"]) for r in rows]) if rows else None

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(ids):
                own = b["node"].to_numpy()
                s = sample @ _normed(b["v"].to_pylist()).T
                s[ids[:, None] == own] = -2
                top = np.argpartition(-s, min(k, len(own)) - 1, axis=1)[:, :k]
                q, x, sim = np.repeat(ids, top.shape[1]), own[top].reshape(-1), np.take_along_axis(s, top, 1).reshape(-1)
                yield pa.RecordBatch.from_pydict({"q": q[sim > -2], "x": x[sim > -2], "sim": sim[sim > -2]})

    found = nodes.select("node", "v").mapInArrow(compared, "q long, x long, sim double")
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "x")
    truth = {}
    for r in found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).collect():  # k * SAMPLE rows
        truth.setdefault(r["q"], set()).add(r["x"])
    return truth


def _recall(lists: DataFrame, truth: dict[int, set[int]], k: int) -> float:
    """Share of the sample's true nearest nodes that are among the best ones met, which are scored exactly."""
    met = lists.where(F.col("node").isin(list(truth))).select("node", F.slice("near", 2, BEST * k).alias("near")).collect()
    n = sum(map(len, truth.values()))
    return sum(len(truth[r["node"]] & set(r["near"])) for r in met) / n if n else 1.0


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, x, score): cosine in double precision."""
    for b in batches:
        if b.num_rows:
            s = (_normed(b["vq"].to_pylist()) * _normed(b["vx"].to_pylist())).sum(1)
            yield pa.RecordBatch.from_arrays([b["q"], b["x"], pa.array(np.clip(s, -1.0, 1.0))], ["q", "x", "score"])


def _matrix(units: list[bytes], kind: type = np.float16) -> np.ndarray:
    return np.frombuffer(b"".join(units), kind).reshape(max(1, len(units)), -1)[: len(units)]


def _paged(df: DataFrame) -> DataFrame:
    return df.withColumn("page", F.shiftright("node", PLACE).cast("int"))


def _met(left: DataFrame, right: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` of all that both tables hold of a page."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.repartitionById(parts, "page").groupBy("page") for x in (left, right))
    return left.cogroup(right).applyInArrow(f, schema)


def _to_pages(page: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """SENT rows, one for each page."""
    order = np.argsort(page.astype(np.uint16), kind="stable")
    page, columns = page[order], {c: x[order] for c, x in (NONE | columns).items() if len(x) == len(order)}
    first = np.flatnonzero(np.diff(page, prepend=-1))
    ends = np.append(first, len(page))[1:]
    cut = {c: [columns[c][i:j].tobytes() for i, j in zip(first, ends, strict=True)] if c in columns else [b""] * len(first) for c in NONE}
    return pa.RecordBatch.from_arrays([pa.array(page[first], pa.int32()), *(pa.array(x, pa.binary()) for x in cut.values())], ["page", *cut])


def _from_pages(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(t[c].to_pylist()), x.dtype) for c, x in NONE.items()]


def _edges(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Nodes, how many edges each has, and the edges of GRAPH rows."""
    near, sims, fresh = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (t["near"], t["sims"], t["fresh"]))
    return t["node"].to_numpy(), np.diff(near.offsets.to_numpy()), *(x.flatten().to_numpy(zero_copy_only=False) for x in (near, sims, fresh))


def _leaves(nodes: DataFrame, n: int, d: int) -> DataFrame:
    """The first graph: (node, near, sims, fresh), nearest first; an edge is fresh until a round has used it."""
    leaf = min(LEAF[1], max(LEAF[0], n // LEAF_PART))
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    planes = np.random.default_rng(SEED).standard_normal((TREES - 1, d, bits)).astype(np.float32)
    places = np.int64(1) << np.arange(bits, dtype=np.int64)

    low = min(bits, CELL)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each tree and the leaves that share the first planes: nodes, leaves and unit vectors."""
        for b in batches:
            if not b.num_rows:
                continue
            node, unit = b["node"].to_numpy(), _matrix(b["unit"].to_pylist())
            x, chance = unit.astype(np.float32), mixed(node.view(U64))
            drawn = (chance >> U64(63 - bits) >> U64(1)).astype(np.int64)
            for tree, code in enumerate([drawn, *((x @ p > 0) @ places for p in planes)]):
                cell = code >> low
                # Nodes are in pages by chance, so a batch tells which cells many similar vectors share; these are dealt into parts.
                share = np.bincount(cell, minlength=1 << bits - low) / max(1, len(node) >> bits - low)
                parts = np.where(share > 4, np.exp2(np.ceil(np.log2(np.maximum(share, 1)))), 1).astype(U64)
                key = ((tree << 32 | cell) << 16) | (chance & (parts[cell] - U64(1)) & U64(0xFFFF)).astype(np.int64)
                order = np.argsort(key)
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                at = np.split(order, first[1:])
                columns = ([x[i].tobytes() for i in at] for x in (node, code, unit))
                yield pa.RecordBatch.from_arrays([pa.array(key[order][first]), *(pa.array(c, pa.binary()) for c in columns)], ["cell", "node", "code", "unit"])

    def compared(t: pa.Table) -> pa.Table:
        ids, code = (np.frombuffer(b"".join(t[c].to_pylist()), np.int64) for c in ("node", "code"))
        units = np.frombuffer(b"".join(t["unit"].to_pylist()), np.float16).reshape(len(ids), -1)
        order = np.lexsort((ids, code))
        found = [[], [], []]
        for members in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            # A leaf of too many is dealt into parts, so that nothing compares more than a few thousand.
            parts = -(-len(members) // (2 * leaf))
            for part in (members[i::parts] for i in range(parts)):
                x, own, k = units[part].astype(np.float32), ids[part], min(FROM_LEAF, len(part) - 1)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                top = np.argpartition(s, len(part) - max(1, k), axis=1)[:, len(part) - k :]
                found[0].append(np.repeat(own, k)), found[1].append(own[top].reshape(-1)), found[2].append(np.take_along_axis(s, top, 1).reshape(-1))
        a, b, s = (np.concatenate(x) for x in found)
        return pa.Table.from_batches([_to_pages(a >> PLACE, a=a.astype(np.uint32), b=b.astype(np.uint32), s=s)])

    cells = nodes.select("node", "unit").mapInArrow(dealt, "cell long, node binary, code binary, unit binary")
    found = cells.groupBy("cell").applyInArrow(compared, SENT)
    empty = nodes.select("node", *(F.array().cast(f"array<{kind}>").alias(c) for c, kind in (("near", "long"), ("sims", "float"), ("fresh", "boolean"))))
    return stash(_met(_paged(empty), found, _better(NEIGHBOURS, NEIGHBOURS), GRAPH))


def _place(nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted nodes of a page stand in ``nodes``."""
    at = np.zeros(1 << PLACE, np.int64)
    at[nodes & (1 << PLACE) - 1] = np.arange(len(nodes))
    return at[wanted & (1 << PLACE) - 1]


def _once(own: np.ndarray, ids: np.ndarray, later: np.ndarray) -> np.ndarray:
    """One edge of all that are equal, by (own, ids); of these one that is not ``later``. Own are places in a page."""
    key = own << 33 | ids.astype(np.int64) << 1 | later
    by = np.argsort(key)
    return by[np.diff(key[by] >> 1, prepend=-1) != 0]


def _last(sim: np.ndarray) -> np.ndarray:
    """Similarities as numbers of 32 bits, the largest first."""
    bits = np.ascontiguousarray(sim, np.float32).view(np.uint32)
    return np.where(bits >> 31, bits, ~(bits | np.uint32(1 << 31))).astype(np.int64)


def _rank(own: np.ndarray) -> np.ndarray:
    """Places among equal neighbours of a sorted list."""
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))


def _better(most: int, followed: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """GRAPH rows and the edges that were sent to them: the ``most`` best distinct edges of each node; fresh are new ones,
    and those after the first ``followed`` that were so."""

    def better(rows: pa.Table, sent: pa.Table) -> pa.Table:
        nodes, counts, near, sims, fresh = _edges(rows)
        a, b, s, _ = _from_pages(sent)
        place = np.arange(len(near)) - np.repeat(np.cumsum(counts) - counts, counts)
        left = fresh.astype(bool) & (place >= followed)
        own = np.concatenate([np.repeat(np.arange(len(nodes)), counts), _place(nodes, a)])
        ids, sim = np.concatenate([near, b]), np.concatenate([sims, s]).astype(np.float32)
        new = np.concatenate([left, np.ones(len(a), bool)])
        # Equal edges side by side, those of the rows first.
        by = _once(own, ids, np.repeat([False, True], [len(near), len(a)]))
        own, ids, sim, new = own[by], ids[by], sim[by], new[by]
        by = np.argsort(own << 32 | _last(sim))
        by = by[_rank(own[by]) < most]
        ends = np.searchsorted(own[by], np.arange(len(nodes) + 1)).astype(np.int32)
        lists = (pa.ListArray.from_arrays(ends, pa.array(x[by])) for x in (ids, sim, new))
        return pa.Table.from_arrays([pa.array(nodes), *lists], ["node", "near", "sims", "fresh"])

    return better


def _reversed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, counts, near, sims, fresh = _edges(b)
        place = np.arange(len(near)) - np.repeat(np.cumsum(counts) - counts, counts)
        marks = fresh.astype(np.uint8) | (place < FIRST).astype(np.uint8) << 1
        yield _to_pages(near >> PLACE, a=near.astype(np.uint32), b=np.repeat(nodes, counts).astype(np.uint32), s=sims, f=marks)


def _around(rows: pa.Table, sent: pa.Table, reached: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a page's nodes in both directions: (node, other, fresh), in order of node; of incoming edges the best.

    ``reached`` keeps also those whose other end has no nearer neighbours, so that every node can be walked to.
    """
    nodes, counts, near, sims, fresh = _edges(rows)
    a, b, s, f = _from_pages(sent)
    w = np.concatenate([np.repeat(np.arange(len(nodes)), counts), _place(nodes, a)])
    m, sim, fresh = np.concatenate([near, b]), np.concatenate([sims, s]), np.concatenate([fresh.astype(np.uint8), f & 1]).astype(bool)
    firsts = np.concatenate([np.zeros(len(near), bool), (f & 2 > 0) & reached])
    back = np.repeat([False, True], [len(near), len(a)])
    # An edge in both directions is fresh if one of them is.
    by = np.argsort(key := w << 32 | m.astype(np.int64))
    key = key[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    either = np.logical_or.reduceat(fresh[by], first) if len(first) else fresh
    by = _once(w, m, back)
    w, m, sim, back, firsts = w[by], m[by].astype(np.int64), sim[by], back[by], firsts[by]
    by = np.argsort(w << 33 | back.astype(np.int64) << 32 | _last(sim))
    w, m, fresh, back, firsts = w[by], m[by], either[by], back[by], firsts[by]
    keep = ~back | firsts | (_rank(w << 1 | back) < NEIGHBOURS)
    return nodes[w[keep]], m[keep], fresh[keep]


def _descended(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round of NN-descent."""

    def members(rows: pa.Table, sent: pa.Table) -> pa.Table:
        """For the page itself what its nodes compare, and its nodes' worst neighbours; for others the nodes asked of them."""
        page = (rows["page"] if rows.num_rows else sent["page"])[0].as_py()
        w, m, fresh = _around(rows, sent)
        # Only around a node with a fresh edge, in either direction, is there anything to compare.
        first = np.flatnonzero(np.diff(w, prepend=-1))
        live = np.repeat(np.logical_or.reduceat(fresh, first), np.diff(np.append(first, len(w)))) if len(w) else fresh
        w, m, fresh = w[live], m[live], fresh[live]
        nodes, counts, _, sims, _ = _edges(rows)
        full = counts == NEIGHBOURS
        worst = np.full(len(nodes), -2, np.float32)
        worst[full] = sims[np.cumsum(counts)[full] - 1]
        # What is compared is told by its place among all that the page asks for.
        u, at = np.unique(np.concatenate([w, m]), return_inverse=True)
        asked = _to_pages(u >> PLACE, a=u.astype(np.uint32))
        w, m = np.split(at.astype(np.uint32), 2)
        own = pa.RecordBatch.from_pydict({
            "page": pa.array([page, page], pa.int32()), "a": [w.tobytes(), nodes.astype(np.uint32).tobytes()], "b": [m.tobytes(), b""],
            "s": [b"", worst.tobytes()], "f": [fresh.tobytes(), b""],
        })
        t = pa.Table.from_batches([own, asked])
        return t.append_column("kind", pa.array(["members", "worst"] + ["asked"] * asked.num_rows)).append_column("of", pa.array([page] * t.num_rows, pa.int32()))

    def vectors(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The vectors, and worst neighbours, that each page has asked this one for."""
        nodes, units = rows["node"].to_numpy(), _matrix(rows["unit"].to_pylist())
        worst = np.full(len(nodes), -2, np.float32)
        got = [[], [], [], []]
        cells = list(zip(*(asked[c].to_pylist() for c in ("kind", "of", "a", "s")), strict=True))
        for kind, _, a, s in cells:
            if kind == "worst":
                worst[_place(nodes, np.frombuffer(a, np.uint32))] = np.frombuffer(s, np.float32)
        for kind, of, a, _ in cells:
            if kind == "asked":
                at = _place(nodes, np.frombuffer(a, np.uint32))
                for x, y in zip(got, (of, a, units[at].tobytes(), worst[at].tobytes()), strict=True):
                    x.append(y)
        return pa.table([pa.array(got[0], pa.int32()), *(pa.array(x, pa.binary()) for x in got[1:])], ["page", "a", "unit", "s"])

    reverse = graph.mapInArrow(_reversed, SENT)
    sent = stash(_met(_paged(graph), reverse, members, f"{SENT}, kind string, of int"))
    known = _met(_paged(nodes.select("node", "unit")), sent.where("kind <> 'members'").select("page", "kind", "of", "a", "s"), vectors, "page int, a binary, unit binary, s binary")
    new = _met(sent.where("kind = 'members'").select("page", "a", "b", "f"), known, _compared, SENT)
    after = stash(_met(_paged(graph), new, _better(NEIGHBOURS, NEIGHBOURS), GRAPH))
    discard(sent)
    return after


def _compared(members: pa.Table, known: pa.Table) -> pa.Table:
    """Edges that beat the worst one of a node, by comparison of the nodes around one node, one of them fresh."""
    w, m = (np.frombuffer(b"".join(members[c].to_pylist()), np.uint32).astype(np.int64) for c in ("a", "b"))
    fresh = np.frombuffer(b"".join(members["f"].to_pylist()), bool)
    if not len(w):
        return pa.Table.from_batches([_to_pages(np.empty(0, np.int64))])
    ids = np.frombuffer(b"".join(known["a"].to_pylist()), np.uint32).astype(np.int64)
    worst = np.frombuffer(b"".join(known["s"].to_pylist()), np.float32)
    units = np.frombuffer(b"".join(known["unit"].to_pylist()), np.float16).reshape(len(ids), -1)
    order = np.argsort(ids)
    first = np.flatnonzero(np.diff(w, prepend=-1))
    sizes = np.diff(np.append(first, len(w))) + 1
    # What is around each node, fresh ones first, and the node itself; padded with place -1 to the widest.
    own = np.repeat(np.arange(len(first)), sizes - 1)
    by = np.argsort(own << 1 | ~fresh)
    wide = int(sizes.max())
    at = np.full((len(first), wide), -1, np.int32)
    at[own, np.arange(len(w)) - first[own]] = order[m[by]]
    at[np.arange(len(first)), sizes - 1] = order[w[first]]
    n_fresh = np.add.reduceat(fresh, first, dtype=np.int64)
    # Rows of like size together, so that little is padded.
    rows = np.lexsort((sizes, n_fresh))
    out = [[], [], []]
    step = max(1, GO // 4 // wide)
    for lo in range(0, len(rows), step):
        r = rows[lo : lo + step]
        f, z = int(n_fresh[r].max()), int(sizes[r].max())
        p = at[r, :z]
        x = units[p].astype(np.float32)
        limit = np.where(p < 0, np.float32(9), worst[p])
        s = x[:, :f] @ x.transpose(0, 2, 1)
        g, i, j = np.nonzero(s > limit[:, :f, None])
        keep = (p[g, j] >= 0) & (i != j)
        g, i, j = g[keep], i[keep], j[keep]
        out[0].append(p[g, i]), out[1].append(p[g, j]), out[2].append(s[g, i, j])
        g, i, j = np.nonzero(s[:, :, f:] > limit[:, None, f:])
        keep = p[g, i] >= 0
        g, i, j = g[keep], i[keep], j[keep] + f
        out[0].append(p[g, j]), out[1].append(p[g, i]), out[2].append(s[g, i, j])
    a, b, s = (np.concatenate(x) for x in out)
    # What several nodes have found goes out once.
    by = np.argsort(key := a.astype(np.int64) << 32 | b)
    by = by[np.diff(key[by], prepend=-1) != 0]
    a, b, s = ids[a[by]], ids[b[by]], s[by]
    return pa.Table.from_batches([_to_pages(a >> PLACE, a=a.astype(np.uint32), b=b.astype(np.uint32), s=s)])


def _walked(graph: DataFrame, nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Greedy search: GRAPH rows of the queries' nodes with the best nodes that each has met."""

    def around(rows: pa.Table, sent: pa.Table) -> pa.Table:
        w, m, _ = _around(rows, sent, reached=True)
        return pa.Table.from_batches([_to_pages(m >> PLACE, a=w.astype(np.uint32), b=m.astype(np.uint32))])

    def page(rows: pa.Table, sent: pa.Table) -> pa.Table:
        """A page for the search: its vectors, and from which nodes edges lead to which of its own."""
        nodes, unit = rows["node"].to_numpy(), _normed(rows["v"].to_pylist())
        a, b, _, _ = _from_pages(sent)
        by = np.argsort(a)
        number = rows["page"][0].as_py()
        cells = [nodes, unit, a[by], _place(nodes, b[by]).astype(np.uint32)]
        return pa.table([pa.array([number], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], ["page", "nodes", "unit", "a", "b"])

    edges = _met(_paged(graph), graph.mapInArrow(_reversed, SENT), around, SENT)
    index = stash(_met(_paged(nodes.select("node", "v")), edges, page, "page int, nodes binary, unit binary, a binary, b binary"))
    pages = [r["page"] for r in index.select("page").collect()]
    truth, beam = _true(asked, nodes, k), BEAM
    lists = kept = stash(asked.select("node", F.array("node").alias("near"), F.array(F.lit(2).cast("float")).alias("sims"), F.array(F.lit(True)).alias("fresh")))
    while _recall(lists, truth, k) < RECALL:
        if _changed(lists.select(F.slice("near", 1, beam).alias("near"), F.slice("fresh", 1, beam).alias("fresh"))) <= CHANGED:
            # Little is new from the best nodes: more of them, unless everything that the graph leads to has been met.
            r = lists.agg(F.max(F.size("near")).alias("longest"), F.max(F.exists("fresh", lambda x: x)).alias("fresh")).first()
            if r["longest"] > beam:
                if not r["fresh"]:  # what the lists had no room for is met again
                    lists = lists.withColumn("fresh", F.transform("near", lambda x: F.lit(True)))
                beam = max(128, 2 * beam)
                if r["fresh"]:
                    continue
            elif not r["fresh"]:
                break
        asks = lists.join(asked, "node").mapInArrow(_asks(pages, beam, KEPT * beam), "page int, q binary, n binary, x binary, unit binary, s binary")
        found = _met(index, asks, _answered, SENT)
        after = stash(_met(_paged(lists), found, _better(KEPT * beam, beam), GRAPH))
        discard(kept)
        lists = kept = after
    return lists


def _asks(pages: list[int], beam: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every page the queries, their vectors, what is good enough for them, and the nodes to go on from."""

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, counts, near, sims, fresh = _edges(b)
            start = np.cumsum(counts) - counts
            go = fresh.astype(bool) & (np.arange(len(near)) - np.repeat(start, counts) < beam)
            n = np.bincount(np.repeat(np.arange(len(nodes)), counts)[go], minlength=len(nodes))
            worst = np.full(len(nodes), -3, np.float32)
            full = counts >= most
            worst[full] = sims[(start + counts)[full] - 1]
            r = n > 0
            if r.any():
                unit = _normed([v for v, x in zip(b["v"].to_pylist(), r, strict=True) if x])
                cells = [nodes[r].astype(np.uint32), n[r].astype(np.int32), near[go].astype(np.uint32), unit, worst[r]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pages, pa.int32()), *(pa.array([x.tobytes()] * len(pages), pa.binary()) for x in cells)], ["page", "q", "n", "x", "unit", "s"]
                )

    return asks


def _answered(index: pa.Table, asks: pa.Table) -> pa.Table:
    """What a page's nodes, to which edges of the nodes asked for lead, have that is good enough for the queries."""
    out = [[], [], []]
    if index.num_rows and asks.num_rows:
        nodes, a, b = (np.frombuffer(index[c][0].as_py(), kind) for c, kind in (("nodes", np.int64), ("a", np.uint32), ("b", np.uint32)))
        unit = np.frombuffer(index["unit"][0].as_py(), np.float64).reshape(len(nodes), -1)
        last = max(int(x.max()) for x in (a, *(np.frombuffer(x, np.uint32) for x in asks["x"].to_pylist())) if len(x))
        starts = np.append(0, np.cumsum(np.bincount(a, minlength=last + 1), dtype=np.int32))
        for r in range(asks.num_rows):
            q, n, x, s = (np.frombuffer(asks[c][r].as_py(), kind) for c, kind in (("q", np.uint32), ("n", np.int32), ("x", np.uint32), ("s", np.float32)))
            mine = np.frombuffer(asks["unit"][r].as_py(), np.float64).reshape(len(q), -1)
            lo, hi = starts[:-1][x].astype(np.int64), starts[1:][x].astype(np.int64)
            ends, total = np.cumsum(n), np.append(0, np.cumsum(hi - lo))
            # So many queries at once that memory stays bounded.
            first = 0
            while first < len(q):
                last = max(first + 1, int(np.searchsorted(total[ends], total[ends[first] - n[first]] + 16 * GO)))
                cut = slice(ends[first] - n[first], ends[last - 1])
                size = (hi - lo)[cut]
                at = np.repeat(lo[cut] - np.cumsum(size) + size, size) + np.arange(size.sum())
                pair = np.unique(np.repeat(np.repeat(np.arange(first, last), n[first:last]), size) << 32 | b[at])
                i, j = pair >> 32, pair & 0xFFFFFFFF
                sim = np.empty(len(i), np.float32)
                for c in range(0, len(i), GO // 4):
                    # The cosine less one, by differences: so it tells near copies apart in few bits.
                    apart = mine[i[c : c + GO // 4]] - unit[j[c : c + GO // 4]]
                    sim[c : c + GO // 4] = np.einsum("ij,ij->i", apart, apart) / -2
                good = (sim > s[i]) & (nodes[j] != q[i])
                out[0].append(q[i[good]]), out[1].append(nodes[j[good]].astype(np.uint32)), out[2].append(sim[good])
                first = last
    a, b, s = (np.concatenate([np.empty(0, kind), *x]).astype(kind) for x, kind in zip(out, (np.uint32, np.uint32, np.float32), strict=True))
    return pa.Table.from_batches([_to_pages(a.astype(np.int64) >> PLACE, a=a, b=b, s=s)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the five nearest rows of every fiftieth row."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
