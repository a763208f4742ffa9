"""Operator 3, n-gram Jaccard self-join as a grouped prefix join.

Texts with equal shingle sets are one class. Shingles get one global order, rare ones first: (size of the shingle's
count, fingerprint), where counts are taken over all documents in 32-bit buckets and only the largest buckets are told
apart. The order need only be the same everywhere for the join to lose nothing, so the table of large buckets may be,
and is, bounded. Two sets of Jaccard similarity t or more share a shingle among their first n - ceil(t n) + 1.

Classes with the same prefix and size are one group; groups, not classes, are posted under their prefix shingles. Groups
under one shingle are never paired with each other outright. First each is compared with two others only, the most
typical one it meets and one of about its size, and its classes with their leader; that settles copies of one text,
however many. Then only pairs of classes, of one group or two, in different components so far are listed, pruned by size and position and verified. What
remains to be listed are links that bridge components, none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, U64, discard, mixed, numbered, signed, span, stash, sums, table, word_hashes
from tidemark.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Large buckets that are told apart, at most (5 bytes each).
LARGE = 1 << 19
#: The counts of 2**(32 - RANGE_BITS) buckets are held by one task at a time.
RANGE_BITS = 10
#: Buckets with fewer shingles than 2**LEAST_LOG are all alike.
LEAST_LOG = 3
#: Postings of one shingle beyond about this many are dealt to several tasks.
DEAL_LOG = 10
#: Classes that are compared with another one in one task.
ROOM = 500
#: Shingles that a task gathers before it hands on its counts.
FLUSH = 1 << 21


def ngram_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs without ASCII white space; a set holds the distinct ``shingle``-word shingles, or
    the whole text as one where it is shorter. Rows link when 100 * intersection >= ``percent`` * union; component_id is
    the smallest doc_id reachable. Texts of any length are read whole; at exactly ``percent`` rows link. Null, empty and blank texts have no shingles and stand alone. A null doc_id links
    like any other but gives no name to a component unless all in it are null. Repeated rows are linked. Other columns
    of ``docs``, whatever their names, are ignored. An empty table gives an empty result.
    """
    texts = numbered(docs)
    seen = stash(texts.mapInArrow(_sets(shingle), "rid long, doc_id long, n int, cls binary, part int, counts binary"))
    rows = stash(seen.where("part IS NULL").drop("part", "counts"))
    large = _large_buckets(seen)
    discard(seen)

    prefixes = stash(
        texts.mapInArrow(_prefixes(shingle, percent, *large), "cls binary, gid long, n int, keys array<long>, logs array<tinyint>")
    )
    members = stash(prefixes.groupBy("cls").agg(F.first("gid").alias("gid")))
    leaders = members.groupBy("gid").agg(F.min("cls").alias("leader"))
    groups = prefixes.groupBy("gid").agg(
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("logs").alias("logs"), (F.min("cls") < F.max("cls")).alias("several")
    )
    # Classes of one group share their whole prefix, so its first shingle is enough for them to meet below.
    posts = groups.select("gid", "n", "several", F.posexplode(F.arrays_zip("keys", "logs")).alias("pos", "x")).select(
        F.col("x.keys").alias("key"), F.col("x.logs").cast("int").alias("log"), "gid", "n", "pos", (F.col("several") & (F.col("pos") == 0)).alias("several")
    )
    deal = F.expr(f"CASE WHEN log > {DEAL_LOG} THEN pmod(gid, shiftleft(1L, log - {DEAL_LOG})) ELSE 0L END")
    by_size = Window.partitionBy("key", "deal").orderBy("n", "gid")
    shared = stash(
        posts.withColumn("deal", deal)
        .withColumn("lead", F.lead("gid").over(by_size))
        .withColumn("prev", F.lag(F.struct("gid", "n")).over(by_size))
        .withColumn("meets", F.expr(f"log > {DEAL_LOG} OR lead IS NOT NULL OR prev IS NOT NULL"))
        .where("meets OR several")
        .drop("lead", "several")
    )

    leaders = stash(leaders)
    discard(prefixes)

    # First comparisons: with the leader of the own group, with the group of the next smaller size, and with the most
    # typical group. An edit's shingles are rare and crowd shared ones out of a prefix, so the group with the largest
    # share of shared shingles is the text that the others are copies of.
    typical = shared.where("meets").groupBy("gid").agg((F.count("*") / F.first("n")).alias("typical"))
    pivots = shared.join(typical, "gid").groupBy("key").agg(F.max_by(F.struct("gid", "n"), F.struct("typical", "gid")).alias("pivot"))
    pivots = stash(pivots.where("pivot IS NOT NULL"))
    few = None
    for name, rel in (("pivot", shared.join(pivots, "key")), ("prev", shared)):
        met = (
            rel.where(f"{name}.gid <> gid AND {percent} * greatest(n, {name}.n) <= 100 * least(n, {name}.n)")
            .groupBy("gid", F.col(f"{name}.gid").alias("other")).agg(F.count("*").alias("met"))
            .groupBy("gid").agg(F.max_by("other", F.struct("met", "other")).alias("other"))
        )
        few = met if few is None else few.unionByName(met)
    first = few.distinct().join(leaders, "gid").select(F.col("leader").alias("a"), F.col("other").alias("gid")).join(leaders, "gid").select("a", F.col("leader").alias("b"))
    first = stash(first.unionByName(members.join(leaders, "gid").where("cls <> leader").select(F.col("cls").alias("a"), F.col("leader").alias("b"))))

    sources = stash(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("rid").alias("rid")))
    links = stash(_verified(first, sources, texts, shingle, percent))
    part = stash(components(links))

    # The rest: pairs under a common shingle that are not in one component yet.
    posts = shared.select("key", "gid", "n", "pos").join(members, "gid").drop("gid")
    placed = stash(_apart(posts, part))
    a, b = (placed.select("key", *(F.col(c).alias(c + s) for c in ("n", "pos", "cls", "component"))) for s in "ab")
    # At the first shingle that both prefixes share, what is left of either set bounds the intersection.
    rest = a.join(b, "key").where(
        f"(na < nb OR na = nb AND clsa < clsb) AND componenta <> componentb AND {percent} * nb <= 100 * na "
        f"AND (100 + {percent}) * least(na - posa, nb - posb) >= {percent} * (na + nb)"
    ).select(F.col("clsa").alias("a"), F.col("clsb").alias("b")).distinct()
    more = stash(_verified(rest, sources, texts, shingle, percent))
    if more.limit(1).count():
        part = stash(components(links.unionByName(more)))

    names = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    names = names.join(part.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = names.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = names.join(lowest, "component").select("cls", "component_id")
    return rows.join(names, "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _apart(posts: DataFrame, part: DataFrame) -> DataFrame:
    """Postings with their component, of shingles that stand in more than one."""
    placed = posts.join(part.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return placed.join(several, "key")


def _verified(pairs: DataFrame, sources: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link.

    Every b has a room, or several where very many classes a are to be compared with it. Texts, which are smaller than
    their sets, go to the rooms they are wanted in; there b comes first and the others pass by one after the other.
    """
    pairs = stash(pairs.distinct())
    rooms = pairs.groupBy("b").agg(F.ceil(F.count("*") / ROOM).alias("parts"))
    guests = pairs.join(rooms, "b").select(F.col("a").alias("cls"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("guest"))
    hosts = rooms.select(F.col("b").alias("cls"), "b", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), F.lit(0).alias("guest"))
    wanted = guests.unionByName(hosts).join(sources, "cls").groupBy("rid").agg(F.collect_list(F.struct("cls", "b", "part", "guest")).alias("to"))
    sent = texts.select("rid", "text").join(wanted, "rid").select("text", F.explode("to").alias("to")).select("to.*", "text")
    met = sent.repartition("b", "part").sortWithinPartitions("b", "part", "guest")
    return met.mapInArrow(_rooms(shingle, percent), "a binary, b binary").distinct()


def _rooms(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, own = None, np.empty(0, U64)
        for batch in batches:
            a, b = [], []
            rows = zip(*(batch[c].to_pylist() for c in ("cls", "b", "guest")), word_hashes(batch["text"].to_pylist(), LOWER), strict=True)
            for cls, room, guest, words in rows:
                items = _shingles(words, k)
                if not guest:
                    host, own = room, items
                elif host != room:
                    raise RuntimeError("a room without its host")
                elif (100 + percent) * _common(items, own) >= percent * (len(items) + len(own)):
                    a.append(cls)
                    b.append(room)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of a text's words as sorted fingerprints."""
    if not len(words):
        return np.empty(0, U64)
    c = sums(words)
    if len(words) < k:
        return span(c, np.array([0]), np.array([len(words)])) + U64(len(words))
    at = np.arange(len(words) - k + 1)
    return np.unique(span(c, at, at + k))


def _class(items: np.ndarray) -> bytes:
    return np.array([mixed(items).sum(dtype=U64), mixed(items ^ U64(BIT_MIX)).sum(dtype=U64)]).tobytes()


BIT_MIX = 0x5851F42D4C957F2D


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def counts() -> pa.RecordBatch:
            buckets = np.sort(np.concatenate(held))
            low = 32 - RANGE_BITS
            part = np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64) << U64(low)
            ends = np.searchsorted(buckets, part)
            rows = [(p, _packed(buckets[i:j] & np.uint32((1 << low) - 1))) for p, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if j > i]
            m = len(rows)
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                ["rid", "doc_id", "n", "cls", "part", "counts"],
            )

        for b in batches:
            n, cls = [], []
            for words in word_hashes(b["text"].to_pylist(), LOWER):
                items = _shingles(words, k)
                n.append(len(items))
                cls.append(_class(items) if len(items) else None)
                held.append((items >> U64(32)).astype(np.uint32))
                n_held += len(items)
                if n_held >= FLUSH:
                    yield counts()
                    held, n_held = [], 0
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [b["rid"], b["doc_id"], pa.array(n, pa.int32()), pa.array(cls, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                ["rid", "doc_id", "n", "cls", "part", "counts"],
            )
        if n_held:
            yield counts()

    return run


def _packed(low: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit steps; a step of 65535 is followed by no number."""
    steps = np.diff(low.astype(np.int64), prepend=0)
    wide, rest = steps // 65535, steps % 65535
    out = np.full(len(low) + int(wide.sum()), 65535, np.uint16)
    out[np.cumsum(wide + 1) - 1] = rest
    return out.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    steps = np.frombuffer(b, np.uint16)
    return np.cumsum(steps.astype(np.int64))[steps != 65535]


def _large_buckets(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with the most shingles, sorted, and the size of the count of each as a power of two.

    The least size kept is the smallest for which no more than ``LARGE`` buckets qualify, so the table is bounded.
    """
    found = stash(
        seen.where("part IS NOT NULL").select("part", "counts").repartition("part").sortWithinPartitions("part")
        .mapInArrow(_counted, "log int, n int, buckets binary")
    )
    least, total = 33, 0
    for log, n in sorted((tuple(r) for r in found.groupBy("log").agg(F.sum("n")).collect()), reverse=True):
        total += n
        if total > LARGE:
            break
        least = log
    rows = found.where(F.col("log") >= least).select("log", "buckets").collect()
    buckets = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(r["buckets"], np.uint32) for r in rows)])
    logs = np.concatenate([np.empty(0, np.uint8), *(np.full(len(r["buckets"]) // 4, r["log"], np.uint8) for r in rows)])
    order = np.argsort(buckets)
    return buckets[order], logs[order]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts bucket by bucket, one range after the other, and tells the large ones."""
    low = 32 - RANGE_BITS
    now, count = None, np.zeros(1 << low, np.uint32)

    def large():
        at = np.flatnonzero(count >= 1 << LEAST_LOG)
        logs = np.log2(count[at]).astype(np.int32)
        rows = [(int(g), (at[logs == g] | (now << low)).astype(np.uint32)) for g in np.unique(logs)]
        yield pa.RecordBatch.from_pydict({
            "log": pa.array([g for g, _ in rows], pa.int32()), "n": pa.array([len(x) for _, x in rows], pa.int32()),
            "buckets": pa.array([x.tobytes() for _, x in rows], pa.binary()),
        })

    for b in batches:
        for part, packed in zip(b["part"].to_pylist(), b["counts"].to_pylist(), strict=True):
            if part != now:
                if now is not None:
                    yield from large()
                now = part
                count[:] = 0
            values, times = np.unique(_unpacked(packed), return_counts=True)
            count[values] += times.astype(np.uint32)
    if now is not None:
        yield from large()


def _prefixes(k: int, percent: int, buckets: np.ndarray, logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, gid, sizes, keys, sized = [], [], [], [], []
            for words in word_hashes(b["text"].to_pylist(), LOWER):
                items = _shingles(words, k)
                n = len(items)
                if not n:
                    continue
                log = np.zeros(n, np.uint8)
                if len(buckets):
                    own = (items >> U64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(buckets, own), len(buckets) - 1)
                    log = np.where(buckets[at] == own, logs[at], 0).astype(np.uint8)
                order = np.argsort(log, kind="stable")[: n - (percent * n + 99) // 100 + 1]
                prefix = items[order]
                ranks = np.arange(1, len(prefix) + 1, dtype=U64) * U64(2 * BIT_MIX + 1 & (2**64 - 1))
                cls.append(_class(items))
                gid.append(int(signed(mixed(mixed(prefix + ranks).sum(dtype=U64, keepdims=True) + U64(n)))[0]))
                sizes.append(n)
                keys.append(signed(prefix))
                sized.append(log[order].astype(np.int8))
            if cls:
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls, pa.binary()), pa.array(gid, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, np.concatenate(keys)), pa.ListArray.from_arrays(ends, np.concatenate(sized))],
                    ["cls", "gid", "n", "keys", "logs"],
                )

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: set size and component of every document."""
    return ngram_components(table(spark, sf_dir, "documents"))
