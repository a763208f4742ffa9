"""Operator 10, benchmark decontamination by greedy string tiling.

Seeds are runs of ``least`` words that a document shares with a benchmark item, found by a join on their fingerprints;
a filter of bounded size, made of the items' seeds, keeps documents' other runs out of it. The words of the items that
a document has seeds of go to it, a few hundred items at a time. There running Karp-Rabin fingerprints give the maximal
common runs; the longest one that overlaps no marked word is marked first, again and again, so that passages are found
whatever their order. Coverage is the share of an item's words under marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, PUNCTUATION, U64, discard, mixed, numbered, signed, span, stash, sums, table, word_hashes

#: Words in the shortest match.
LEAST = 5
#: Share of an item's words that makes a document contaminated.
COVERAGE = 0.6
#: Bits of the filter for each seed of the benchmark, and at most (2**27 bits are 16 MB); a full filter only lets more
#: runs into the join.
SEED_BITS, MOST_BITS, LEAST_BITS = 64, 27, 16
#: Places of the filter that a seed sets.
PROBES = 4
#: Bits in one row of the filter while it is made.
_PART = 13
#: Items that are compared with a document in one row.
AT_ONCE = 256
#: A document's row: two hashes tell rows apart at any size.
ROW = ["rid", "tag"]


def _words(texts: list[bytes]) -> list[np.ndarray]:
    return word_hashes(texts, LOWER, PUNCTUATION)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the runs of ``k`` words."""
    at = np.arange(len(words) - k + 1)
    return span(sums(words), at, at + k) + U64(k)


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """How much of a benchmark item each document holds.

    Words are lower-cased (A-Z) runs without ASCII white space and punctuation. Returns one row per input row: doc_id, n_items (items
    that share a run of ``least`` words, whole items if shorter), item_id of the item covered best (ties: the smallest;
    null if none), coverage (share of its words under tiles), contaminated (coverage >= ``coverage``) and the ``carry``
    columns as a struct ``carried``.

    An item of one word is covered in full by every document that has the word. Null and empty texts hold nothing. Null items and null item_ids take no part; items without words cover nothing;
    items repeated with id and text count once, items of one id and several texts are several. Very long and repetitive
    texts are read whole: their common runs are kept as runs, never as pairs of places. Null doc_ids and repeated rows
    are rows like any other. Other columns, whatever their names, are ignored. Empty tables give an empty result or one
    without overlaps.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = stash(items.distinct().withColumn("iid", F.xxhash64("item_id", "text")).mapInArrow(
        _items(least), "iid long, item_id long, k int, words binary, seeds array<long>"
    ))
    seeds = stash(items.select(F.explode("seeds").alias("seed"), "iid").distinct())
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # from 1 to ``least``
    bits = _filter(seeds)

    texts = numbered(docs, carry)
    hits = stash(texts.select(*ROW, "text").mapInArrow(_hits(bits, sizes), "rid long, tag int, seeds array<long>"))
    pairs = stash(hits.select(*ROW, F.explode("seeds").alias("seed")).join(seeds, "seed").select(*ROW, "iid").distinct())
    rooms = pairs.groupBy(*ROW).agg(F.ceil(F.count("*") / AT_ONCE).alias("rooms"))
    met = (
        pairs.join(rooms, ROW).withColumn("room", F.pmod("iid", F.col("rooms")))
        .join(items.select("iid", "item_id", "k", "words"), "iid")
        .groupBy(*ROW, "room").agg(F.collect_list(F.struct("item_id", "k", "words")).alias("items"))
    )
    # Repeated rows have one text: it is tiled once.
    once = texts.join(pairs.select(*ROW).distinct(), ROW, "left_semi").select(*ROW, "text").dropDuplicates(ROW)
    tiled = stash(once.join(met, ROW).select(*ROW, "text", "items").mapInArrow(_tiled, "rid long, tag int, n_items long, item_id long, coverage double"))
    best = tiled.groupBy(*ROW).agg(
        F.sum("n_items").alias("n_items"), F.max(F.struct("coverage", (-F.col("item_id")).alias("item"))).alias("best")
    )
    best = stash(best.select(*ROW, "n_items", (-F.col("best.item")).alias("item_id"), F.col("best.coverage").alias("coverage")))
    for t in (hits, pairs, seeds, items, tiled):
        discard(t)
    out = texts.drop("text").join(best, ROW, "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "carried"
    ).withColumn("contaminated", F.col("coverage") >= coverage)
    out = out.select("doc_id", "n_items", "item_id", "coverage", "contaminated", "carried")
    return out if carry else out.drop("carried")


def _items(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for iid, item_id, words in zip(b["iid"].to_pylist(), b["item_id"].to_pylist(), _words(b["text"].to_pylist()), strict=True):
                if len(words):
                    k = min(least, len(words))
                    rows.append((iid, item_id, k, words.tobytes(), signed(np.unique(grams(words, k)))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["iid", "item_id", "k", "words", "seeds"])

    return run


def _places(seeds: np.ndarray, log: int) -> Iterator[np.ndarray]:
    """Where in a filter of 2**log bits each seed has its probes, one after the other."""
    for i in range(PROBES):
        yield (mixed(seeds + U64(i)) >> U64(64 - log)).astype(np.int64)


def _filter(seeds: DataFrame) -> np.ndarray:
    """The filter of the benchmark's seeds as bytes, bounded by ``MOST_BITS`` whatever their number."""
    log = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, seeds.count()) * SEED_BITS)))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(list(_places(b["seed"].to_numpy().view(U64), log))))
            yield pa.RecordBatch.from_pydict({"part": pa.array(at >> _PART, pa.int32()), "bit": pa.array(at & ((1 << _PART) - 1), pa.int32())})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bits in b["bits"].to_pylist():
                flags = np.zeros(1 << _PART, np.uint8)
                flags[bits] = 1
                out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_pydict({"part": b["part"], "packed": pa.array(out, pa.binary())})

    parts = seeds.select("seed").mapInArrow(places, "part int, bit int").groupBy("part").agg(F.collect_set("bit").alias("bits"))
    whole = np.zeros((1 << log) // 8, np.uint8)
    size = (1 << _PART) // 8
    for r in parts.mapInArrow(packed, "part int, packed binary").collect():
        whole[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["packed"], np.uint8)
    return whole


def _hits(bits: np.ndarray, sizes: list[int]):
    log = len(bits).bit_length() + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            found: list[np.ndarray] = []
            for row, words in enumerate(_words(b["text"].to_pylist())):
                own = [grams(words, k) for k in sizes if len(words) >= k]
                if not own:
                    continue
                own = np.concatenate(own)
                for i in range(PROBES):
                    at = (mixed(own + U64(i)) >> U64(64 - log)).astype(np.int64)
                    own = own[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
                if len(own):
                    rows.append(row)
                    found.append(signed(np.unique(own)))
            if rows:
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b["rid"].take(pa.array(rows)), b["tag"].take(pa.array(rows)), pa.ListArray.from_arrays(ends, np.concatenate(found))], [*ROW, "seeds"]
                )

    return run


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        best, share, n_items = [], [], []
        for words, items in zip(_words(b["text"].to_pylist()), b["items"].to_pylist(), strict=True):
            own: tuple[float, int] | None = None
            for item in items:
                of = np.frombuffer(item["words"], U64)
                part = (tiles(words, of, item["k"]) / len(of), -item["item_id"])
                own = part if own is None else max(own, part)
            best.append(-own[1])
            share.append(own[0])
            n_items.append(len(items))
        yield pa.RecordBatch.from_arrays(
            [b["rid"], b["tag"], pa.array(n_items, pa.int64()), pa.array(best, pa.int64()), pa.array(share, pa.float64())], [*ROW, "n_items", "item_id", "coverage"]
        )


def runs(doc: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal common runs of ``k`` words or more: places in doc and in item, and lengths.

    A place of doc is looked at together with its neighbour; which places of the item go on from the neighbour's is
    decided once for each distinct pair of neighbouring seeds. So a text that repeats itself costs its length and its runs.
    """
    own, of = grams(doc, k), grams(item, k)
    kinds, kind_of = np.unique(of, return_inverse=True)
    at = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
    own = np.where(kinds[at] == own, at, -1)
    places = np.argsort(kind_of, kind="stable")
    first = np.searchsorted(kind_of[places], np.arange(len(kinds) + 1))

    def ends(back: bool) -> tuple[np.ndarray, np.ndarray]:
        none = np.array([-2])
        near, near_of = (np.concatenate([none, x[:-1]] if back else [x[1:], none]) for x in (own, kind_of))
        near = np.where(near < 0, -1, near)
        here = np.flatnonzero(own >= 0)
        pair, which = np.unique(own[here] * (len(kinds) + 1) + near[here] + 1, return_inverse=True)
        kind, beside = pair // (len(kinds) + 1), pair % (len(kinds) + 1) - 1
        size = first[kind + 1] - first[kind]
        of_pair = np.repeat(np.arange(len(pair)), size)
        q = places[np.repeat(first[kind] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        stops = near_of[q] != beside[of_pair]
        of_pair, q = of_pair[stops], q[stops]
        begin = np.searchsorted(of_pair, np.arange(len(pair) + 1))
        times = (begin[1:] - begin[:-1])[which]
        a = np.repeat(here, times)
        q = q[np.repeat(begin[:-1][which] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        order = np.lexsort((a, a - q))
        return a[order], q[order]

    (a, q), (last, _) = ends(True), ends(False)
    return a, q, last - a + k


def _free(marks: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """What ``marks``, sorted and apart, leave of [0, n)."""
    edges = [0, *(x for m in marks for x in m), n]
    return [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if y > x]


def _marked(marks: list[tuple[int, int]], at: np.ndarray, n: int) -> np.ndarray:
    """Whether each [at, at + n) overlaps a mark."""
    if not marks:
        return np.zeros(len(at), bool)
    starts, stops = np.array(marks).T
    i = np.searchsorted(starts, at + n) - 1
    return (i >= 0) & (stops[i] > at)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> int:
    """Words of ``item`` under tiles: longest matches first, none shorter than ``least``, none overlapping.

    Of equally long matches the first in the document, then in the item, goes first. A match that is partly covered when
    its turn comes is cut to its free stretches.
    """
    if len(doc) < least or len(item) < least:
        return 0
    a, q, n = runs(doc, item, least)
    pool: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {int(x): [(a[n == x], q[n == x])] for x in np.unique(n)}
    in_doc: list[tuple[int, int]] = []
    in_item: list[tuple[int, int]] = []
    while pool and any(y - x >= least for x, y in _free(in_item, len(item))):
        n = max(pool)
        a, q = (np.concatenate(x) for x in zip(*pool.pop(n), strict=True))
        order = np.lexsort((q, a))
        a, q = a[order], q[order]
        while len(a):
            busy = _marked(in_doc, a, n) | _marked(in_item, q, n)
            for x, y, size in _cut(a[busy], q[busy], n, in_doc, len(doc), in_item, len(item), least):
                pool.setdefault(size, []).append((x, y))
            a, q = a[~busy], q[~busy]
            if len(a):
                in_doc = sorted([*in_doc, (int(a[0]), int(a[0]) + n)])
                in_item = sorted([*in_item, (int(q[0]), int(q[0]) + n)])
                a, q = a[1:], q[1:]
    return sum(y - x for x, y in in_item)


def _cut(a, q, n: int, in_doc, n_doc: int, in_item, n_item: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The free stretches of matches, by length."""
    if not len(a):
        return
    parts = [(a, q, np.full(len(a), n))]
    for side, marks, whole in ((1, in_item, n_item), (0, in_doc, n_doc)):
        stretches = [x for x in _free(marks, whole) if x[1] - x[0] >= least]
        after = []
        for part in parts:
            at, size = part[side], part[2]
            for x, y in stretches:
                lo, hi = np.maximum(at, x), np.minimum(at + size, y)
                ok = hi - lo >= least
                if ok.any():
                    by = (lo - at)[ok]
                    after.append((part[0][ok] + by, part[1][ok] + by, (hi - lo)[ok]))
        parts = after
    for x, y, size in parts:
        for s in np.unique(size):
            yield x[size == s], y[size == s], int(s)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the benchmark item that each document covers best."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
