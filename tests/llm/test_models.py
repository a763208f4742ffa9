import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import mixing, nearest, toxicity


def test_nearest_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).round(3)
    x[500:520] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(9001, None), (9002, [0.0] * 16), (9003, [None] * 16), (9004, [float("nan")] * 16), (9005, [1.0]), (None, rows[0][1]), (9006, []), (9000, [float("inf")] * 16), rows[3]]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows + bad], "vec_id long, embedding array<double>, node int, score string")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    norm = np.linalg.norm(x, axis=1)
    hits = 0
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        s = x @ x[q] / norm / norm[q]
        s[q] = -9
        found.sort()
        assert [k for k, *_ in found] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in found]
        assert [sc for *_, sc in found] == pytest.approx([s[v] for _, v, _ in found], abs=1e-12)
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(1500), -s.round(12)))[:5].tolist()))
    assert hits >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in sorted(got[500])] == [7, 501, 502, 503, 504]  # equal vectors: ties to smaller ids


def test_descents_find_what_leaves_do_not(spark, monkeypatch):
    """From few and small leaves the graph gets most of its true neighbours by the rounds of NN-descent."""
    monkeypatch.setattr(nearest, "LEAF", (32, 32))
    monkeypatch.setattr(nearest, "TREES", 3)
    n = 4000
    x = np.random.default_rng(6).standard_normal((n, 12))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node long, v array<double>")
    nodes = nearest.stash(nodes.mapInArrow(nearest._unit, "node long, v array<double>, unit binary"))
    truth = {i: set(np.argsort(-(unit @ unit[i]))[1:6].tolist()) for i in range(0, n, 20)}

    def recall(graph):
        near = {r["node"]: r["near"][:5] for r in graph.where("node % 20 = 0").collect()}
        return sum(len(truth[i] & set(near[i])) for i in truth) / (5 * len(truth))

    graph = nearest._leaves(nodes, n, 12)
    before, rounds = recall(graph), 0
    assert nearest._changed(graph) == 1
    while nearest._changed(graph) > nearest.CHANGED:
        graph = nearest._descended(graph, nodes)
        rounds += 1
    assert before < 0.7 and recall(graph) >= 0.9 and rounds >= 2
    assert graph.where("size(near) <> size(array_distinct(near)) OR array_contains(near, node)").count() == 0


def test_nearest_beyond_one_leaf_and_page(spark, monkeypatch):
    """Through all steps, with leaves of a hundredth of the table; vectors travel to pages, not with each edge."""
    monkeypatch.setattr(nearest, "LEAF", (32, 32))
    monkeypatch.setattr(nearest, "TREES", 3)
    n = 3000
    x = np.random.default_rng(8).standard_normal((n, 16))
    x[1000:2000] = x[0] + 1e-3 * x[1000:2000]  # a third of them all but equal
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    sent = []
    monkeypatch.setattr(nearest, "_met", lambda left, right, f, schema, met=nearest._met: met(left, sent.append(right) or right, f, schema))
    rows = nearest.nearest(df, F.col("vec_id") % 50 == 0).collect()
    hits = 0
    for q in range(0, n, 50):
        s = unit @ unit[q]
        s[q] = -9
        got = [r for r in rows if r["query_id"] == q]
        assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in got)
        hits += len({r["vec_id"] for r in got} & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * len(rows)
    assert sent[0].count() < n  # a row for each edge were 36 for a node


def test_incoming_edges_are_bounded():
    """All nodes lead to node 0: it is compared with its own neighbours and the nearest of those that lead to it."""
    n, most = 5000, nearest.NEIGHBOURS
    sims = np.linspace(0.9, 0.1, n).astype(np.float32)
    rows = [(0, [1, 2], [0.9, 0.8], [False, False])] + [(i, [0], [float(sims[i])], [True]) for i in range(1, n)]
    graph = pa.Table.from_pylist(
        [dict(zip(("node", "near", "sims", "fresh"), r, strict=True)) for r in rows],
        pa.schema([("node", pa.int64()), ("near", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_()))]),
    )
    sent = pa.Table.from_batches(list(nearest._reversed(graph.to_batches())))
    w, m, fresh = nearest._around(graph, sent)
    assert sorted(m[w == 0]) == list(range(1, most + 3))
    assert fresh[w == 0].all()  # also those that both lead to each other, as one direction is fresh
    assert sorted(m[w == 1]) == [0] and sorted(m[w == n - 1]) == [0]


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nearest.nearest(df, F.col("vec_id") % 50 == 0).collect()))
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def corpus(spark, n=1500):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [words[k] for k in r.integers(0, 300, r.integers(5, 60))]
        toxic = int(r.random() < 0.25)
        for _ in range(3 * toxic):
            w.insert(int(r.integers(0, len(w))), ["idiot", "gruntla", "gruntlo", "st*pid"][r.integers(0, 4)])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    rows += [(n, None), (n + 1, ""), (None, "you idiot"), rows[0]]
    labels += [(None, 1, 1), (5, 1, None), labels[0]]
    docs = spark.createDataFrame([(*x, 2.0, "x") for x in rows], "doc_id long, text string, score double, features string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    held = [(g["score"], truth[g["doc_id"]]) for g in got if g["held_out"] and truth.get(g["doc_id"]) is not None]
    p, q = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(a > b) + (a == b) / 2 for a in p for b in q]) > 0.95
    assert {g["doc_id"] % 5 for g in got if g["doc_id"] is not None and g["held_out"]}
    empty = [g for g in got if g["doc_id"] in (1500, 1501)]
    assert empty[0]["score"] == empty[1]["score"]


def test_toxicity_without_labels(spark):
    docs, labels, _ = corpus(spark, 50)
    got = {g["doc_id"]: g for g in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert got[50]["score"] == 0 and got[None]["predicted"] == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rows = brute.corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, brute.SCHEMA).write.parquet(f"{d}/documents.parquet")
    item = " ".join((rows[20][1]).split()[:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(p.STAGES)

    clean = stage["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    kept = stage["ngram_join"](spark, docs, d)
    comp = brute.ngram(rows)
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for i, _, c in comp if i is not None and i == c})
    cut = {r["doc_id"]: r for r in stage["substring_dedup"](spark, docs, d).collect()}
    for i, n, gone, sha in brute.substring(rows, 50):
        if i is not None and gone and gone < n:
            assert brute.sha(cut[i]["text"].encode()) == sha and cut[i]["n_chars"] == len(cut[i]["text"])
        elif i is not None:
            assert (i in cut) == (gone == 0)
    left = {r["doc_id"] for r in stage["decontamination"](spark, docs, d).collect()}
    assert 20 not in left and 21 in left
    mixed = stage["mixing"](spark, docs, d)
    assert ({r["doc_id"]: r["copies"] for r in mixed.where("doc_id > 5").collect()}
            == {r["doc_id"]: r["copies"] for r in mixing.mix(docs).where("copies > 0 AND doc_id > 5").collect()})
    assert set(docs.columns) < set(mixed.columns) and 0 < mixed.count() < len(rows) and mixed.where("copies < 1").count() == 0
    assert p.run(spark, d).count() > 0


def test_pipeline_stages_with_clashing_columns(spark, tmp_path):
    """Columns that are called like the stages' own, null rows, ties and repeated rows go through as they are."""
    import corpus_pipeline as p

    names = ["kept", "n_removed", "copies", "_id", "_tag", "_print", "mix_domain", "carried", "rid", "Tag", "n_tokens", "input_copies", "features", "best.of"]
    rows = brute.corpus(n=24) + [(3, "tied by doc_id but of another text", "en", "src1", 9)]
    schema = brute.SCHEMA + "".join(f", `{c}` string" for c in names)
    d = str(tmp_path)
    spark.createDataFrame([(*r, *(f"{c}!" for c in names)) for r in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "not in any of them at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in p.STAGES:
        out = p.stash(stage(spark, docs, d))
        if name == "mixing":
            assert {"input_copies", "input_input_copies", "input_mix_domain", *p.MIX} <= set(out.columns)
            assert {r["input_input_copies"] for r in out.collect()} == {"copies!"}
        else:
            assert out.columns == docs.columns
            assert all(r[c] == f"{c}!" for r in out.collect() for c in names)
            assert out.where("doc_id IS NULL").count() >= 1
        assert p.stash(stage(spark, docs.limit(0), d)).count() == 0
