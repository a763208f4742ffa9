"""Operator 8, substring dedup by relative Lempel-Ziv parsing.

The reference of the parse is the whole corpus in doc_id order, cut into content-defined blocks (``passages``) that are
indexed by fingerprint with the smallest doc_id they stand in. Each document is parsed into factors against it. A block
that stands in an earlier document is copied whole, and a run of such blocks is one factor. At factor boundaries, that
is in blocks which are first seen here while their anchor also stands in other blocks, every window is looked up on its
own, so factors extend to the last word they share. A factor of ``window`` words or more is a duplicate span.

Joins are by fingerprint and run on counts and minima that are combined before the shuffle: a passage in a third of all
rows costs as many rows as it has occurrences, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import passages
from tidemark.llm.common import discard, numbered, signed, span, stash, sums, table, with_carried, word_hashes

WINDOW = 50
#: Words in an anchor.
K = 6
#: A block's first window and number of windows are packed into one number; the latter takes the low bits.
AT_BITS = 20
#: A block is known by its own fingerprint and its anchor's: 64 bits need tell apart only what shares an anchor, so false
#: equals stay out of reach at any size.
BLOCK = ["anchor", "block"]


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove words of passages that an earlier document has.

    Words are the runs without ASCII white space, unchanged. A word goes if a window of ``window`` words that covers it
    also starts in a document with a smaller doc_id. Returns one row per input row: doc_id, n_words, n_removed, kept
    (the remaining words joined by one space) and ``carry`` columns as a struct ``carried``.

    A null text has no words. Rows with a null doc_id take no part: they lose nothing and are nobody's source. Rows with
    the same doc_id do not remove words from each other. Texts shorter than a window keep everything; texts of any length
    are read whole, in pieces that overlap by a window less one. Other columns of ``docs``, whatever their names, are
    ignored. An empty table gives an empty result.
    """
    if not 0 < k <= window:
        raise ValueError("an anchor has between 1 and window words")
    texts = numbered(docs)
    known = texts.where("doc_id IS NOT NULL")
    every = stash(known.mapInArrow(_occurrences(window, k), "doc_id long, tag int, anchor long, block long, at long"))
    # Only windows with the same anchor can be equal: what has an anchor of its own is done with.
    # The table of the others is written, so that both sides of the join are plain exchanges and Spark may split a hot key.
    shared = stash(every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
    seen = stash(every.join(shared, "anchor"))
    for t in (every, shared):
        discard(t)
    index = stash(
        seen.groupBy(*BLOCK).agg(F.min(F.struct("doc_id", "tag", "at")).alias("first"), F.max("doc_id").alias("last"))
        .select(*BLOCK, "first", (F.col("last") > F.col("first.doc_id")).alias("again"))
    )

    # Factor boundaries: blocks whose anchor also stands in other blocks. These anchors are written for the same reason.
    several = stash(index.groupBy("anchor").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("anchor"))
    edges = index.join(several, "anchor").groupBy("first.doc_id", "first.tag").agg(
        F.collect_list(F.struct(*BLOCK, "first.at")).alias("edges")
    )
    looked = stash(
        known.join(edges, ["doc_id", "tag"]).select("doc_id", "text", "edges")
        .mapInArrow(_windows(window), "anchor long, block long, doc_id long, prints array<long>")
    )
    each = looked.select(*BLOCK, "doc_id", F.posexplode("prints").alias("off", "print"))
    earlier = each.groupBy("anchor", "print").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("b")).where("source < b")
    hits = stash(
        each.join(earlier.select("anchor", "print", "source"), ["anchor", "print"]).where("source < doc_id")
        .groupBy(*BLOCK).agg(F.first("doc_id").alias("owner"), F.collect_list("off").alias("offs"))
    )
    for t in (several, looked):
        discard(t)

    # What is known of each block: from which document on it is copied whole, and what its first document has elsewhere.
    known_blocks = index.where("again").select(*BLOCK, F.col("first.doc_id").alias("source")).join(hits, BLOCK, "full")
    whole = (F.col("doc_id") > F.col("source"))
    start, n = F.shiftright("at", AT_BITS), F.col("at").bitwiseAND((1 << AT_BITS) - 1)
    factors = stash(
        seen.join(known_blocks, BLOCK).select(
            "doc_id", "tag",
            F.when(whole, F.array(F.struct(start.alias("start"), n.alias("n"))))
            .when(F.col("owner") == F.col("doc_id"), F.transform("offs", lambda o: F.struct((start + o).alias("start"), F.lit(1).cast("long").alias("n"))))
            .alias("factors"),
        ).where("factors IS NOT NULL")
        .groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("factors")).alias("factors"))
        .select("doc_id", "tag", F.col("factors.start").alias("starts"), F.col("factors.n").alias("lens"))
    )
    for t in (seen, index, hits):
        discard(t)
    kept = numbered(docs, carry).join(factors, ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "lens", "carried")
    out = kept.mapInArrow(_cut(window), with_carried("doc_id long, n_words long, n_removed long, kept string", kept))
    return out if carry else out.drop("carried")


def _occurrences(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {}
            for doc, tag, words in zip(b["doc_id"].to_pylist(), b["tag"].to_pylist(), word_hashes(b["text"].to_pylist()), strict=True):
                if len(words) < window:
                    continue
                found = passages.rows(words, window, k)
                m = len(found["start"])
                at = found["start"] << AT_BITS | found["n"]
                row = (np.full(m, doc), np.full(m, tag, np.int32), found["anchor"], found["block"], at)
                for name, x in zip(("doc_id", "tag", "anchor", "block", "at"), row, strict=True):
                    cols.setdefault(name, []).append(x)
            if cols:
                yield pa.RecordBatch.from_pydict({name: np.concatenate(x) for name, x in cols.items()})

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, prints = [], []
            for doc, words, edges in zip(b["doc_id"].to_pylist(), word_hashes(b["text"].to_pylist()), b["edges"].to_pylist(), strict=True):
                c = sums(words)
                for e in edges:
                    start, n = e["at"] >> AT_BITS, e["at"] & ((1 << AT_BITS) - 1)
                    at = np.arange(start, start + n)
                    rows.append((e["anchor"], e["block"], doc))
                    prints.append(signed(span(c, at, at + window)))
            if rows:
                ends = np.cumsum([0, *map(len, prints)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(prints))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)), lists], ["anchor", "block", "doc_id", "prints"]
                )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, lens in zip(*(b[c].to_pylist() for c in ("text", "starts", "lens")), strict=True):
                words = text.split()
                n_words.append(len(words))
                if starts:
                    gone = passages.covered(len(words), starts, np.asarray(lens) + window - 1)
                    n_removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), b["carried"]],
                ["doc_id", "n_words", "n_removed", "kept", "carried"],
            )

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: removed words and digest of what is left, for every document."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
