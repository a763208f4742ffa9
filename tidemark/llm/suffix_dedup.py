"""Operator 9, dedup of repeated byte strings by prefix-free parsing.

Triggers found by a rolling hash cut every text into phrases (``passages``): a trigger is the k-byte string with the
smallest fingerprint in some window, so phrases depend on content alone and no window lacks a trigger. The dictionary
holds each distinct phrase, with the window that overhangs its end, once with its count; the parse is the list of
phrases of each text. Work after the parse is on the dictionary, which for repetitive text is far smaller than it.

Positions are then brought into the order in which equal strings meet, level by level, each level only where the one
above leaves a tie open: phrases (equal ones are equal in all their windows), within phrases of the same trigger cells
of ``CELL`` neighbouring windows, within cells with the same core single windows. Only equality up to one window length
matters for this operator, so order within a level is by fingerprint, not by bytes: one suffix array of the whole
corpus would be one sequential object, grouped counts are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import passages
from tidemark.llm.common import BYTES, U64, discard, mixed, numbered, signed, span, stash, sums, table

WINDOW = 400
#: Bytes in a trigger.
K = 32
#: Neighbouring windows in a cell.
CELL = 16
#: A phrase is known by its own fingerprint and its trigger's: 64 bits need tell apart only what shares a trigger, so
#: false equals stay out of reach at any size.
PHRASE = ["anchor", "block"]


def suffix_dedup(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; strings do not cross texts; a second start in the same text counts, overlaps too; all starts
    lose their bytes. Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept
    (the remaining bytes, as binary: a cut may fall inside a character).

    A null text is empty. A null doc_id is a row like any other. Repeated rows are repeated text. Texts shorter than a
    window keep everything. Texts of any length are read whole, in pieces that overlap by a window less one. Other columns
    of ``docs``, whatever their names, are ignored. An empty table gives an empty result.
    """
    if not 0 < k <= window - CELL + 1 <= 1 << 15:
        raise ValueError("a trigger fits in the core that the windows of a cell share, and a window in 32 kB")
    texts = numbered(docs)
    every = stash(texts.mapInArrow(_parse(window, k), "rid long, anchor long, block long, start int, n short, rel short"))
    # Only windows with the same trigger can be equal: what has a trigger of its own is done with. The table of the
    # others is written, so that both sides of the join are plain exchanges and Spark may split a hot trigger.
    shared = stash(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    parse = stash(every.join(shared, "anchor"))
    for t in (every, shared):
        discard(t)
    phrases = stash(parse.groupBy(*PHRASE).agg(
        F.count("*").alias("c"), F.min(F.struct("rid", "start", "n", "rel")).alias("at")
    ))

    ties = phrases.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least"))
    tied = stash(ties.where("kinds > 1 AND least = 1").select("anchor"))
    open_ = stash(phrases.join(tied, "anchor"))
    wanted = open_.groupBy(F.col("at.rid").alias("rid")).agg(
        F.collect_list(F.struct(*PHRASE, "c", "at.start", "at.n", "at.rel")).alias("phrases")
    )
    words = stash(texts.join(wanted, "rid").select("text", "phrases").mapInArrow(
        _contexts(window), "anchor long, block long, c long, n int, rel int, bytes binary"
    ))

    cells = words.mapInArrow(_cells(window), "anchor long, block long, c long, core long, whole long, off int, m int")
    kinds = stash(cells.groupBy("core", "whole").agg(
        F.sum("c").alias("c"), F.min(F.struct(*PHRASE, "off", "m")).alias("at")
    ))
    same = cells.where("c = 1").join(kinds.where("c > 1").select("core", "whole"), ["core", "whole"])
    ties = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("c").alias("least"))
    fine = (
        kinds.join(ties.where("kinds > 1 AND least = 1").select("core"), "core")
        .groupBy(F.col("at.anchor").alias("anchor"), F.col("at.block").alias("block"))
        .agg(F.collect_list(F.struct("c", "at.off", "at.m")).alias("cells"))
    )
    single = stash(words.select(*PHRASE, "bytes").join(fine, PHRASE).mapInArrow(
        _prints(window), "anchor long, block long, c long, off int, print long"
    ))
    again = single.groupBy("anchor", "print").agg(F.sum("c").alias("total")).where("total > 1").select("anchor", "print")
    found = same.select(*PHRASE, "off", "m").unionByName(
        single.where("c = 1").join(again, ["anchor", "print"]).select(*PHRASE, "off", F.lit(1).alias("m"))
    )

    whole = parse.join(phrases.where("c > 1").select(*PHRASE), PHRASE).select("rid", "start", F.col("n").cast("int").alias("n"))
    partly = found.join(open_.where("c = 1").select(*PHRASE, "at"), PHRASE).select(
        F.col("at.rid").alias("rid"), (F.col("at.start") + F.col("off")).alias("start"), F.col("m").alias("n")
    )
    gone = stash(whole.unionByName(partly).groupBy("rid").agg(
        F.collect_list("start").alias("starts"), F.collect_list("n").alias("lens")
    ))
    for t in (parse, phrases, tied, open_, words, kinds, single):
        discard(t)
    return texts.join(gone, "rid", "left").select("doc_id", "text", "starts", "lens").mapInArrow(
        _cut(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def _units(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, np.uint8)]


def _ints(rows: list[tuple], names: list[str], short: tuple[str, ...]) -> dict:
    return {c: pa.array(x, pa.int32() if c in short else pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)}


def _parse(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {}
            for rid, text in zip(b["rid"].to_pylist(), b["text"].to_pylist(), strict=True):
                if len(text) >= window:
                    found = passages.rows(_units(text), window, k)
                    for name, x in (found | {"rid": np.full(len(found["n"]), rid)}).items():
                        cols.setdefault(name, []).append(x)
            if cols:
                col = {name: np.concatenate(x) for name, x in cols.items()}
                yield pa.RecordBatch.from_pydict({
                    "rid": col["rid"], "anchor": col["anchor"], "block": col["block"], "start": col["start"].astype(np.int32),
                    **{c: col[c].astype(np.int16) for c in ("n", "rel")},
                })

    return run


def _contexts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, phrases in zip(b["text"].to_pylist(), b["phrases"].to_pylist(), strict=True):
                rows = [(p["anchor"], p["block"], p["c"], p["n"], p["rel"]) for p in phrases]
                cut = [text[p["start"] : p["start"] + p["n"] - 1 + window] for p in phrases]
                yield pa.RecordBatch.from_pydict(
                    _ints(rows, ["anchor", "block", "c", "n", "rel"], ("n", "rel")) | {"bytes": pa.array(cut, pa.binary())}
                )

    return run


def _cells(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {x: [] for x in ("anchor", "block", "c", "core", "whole", "off", "m")}
            for anchor, block, count, n, rel, text in zip(*(b[x].to_pylist() for x in ("anchor", "block", "c", "n", "rel", "bytes")), strict=True):
                c = sums(_units(text))
                cell = np.arange((rel - n + 1) // CELL, rel // CELL + 1)
                near, wide = np.maximum(cell * CELL, rel - n + 1), np.minimum(cell * CELL + CELL - 1, rel)
                off = rel - wide
                core = rel - cell * CELL
                key = mixed(span(c, core, core - CELL + 1 + window) ^ mixed(np.full(len(cell), anchor).view(U64) + cell.astype(U64)))
                whole = mixed(span(c, off, rel - near + window) + (near * 4096 + wide).astype(U64))
                m = len(cell)
                for name, x in (("anchor", np.full(m, anchor)), ("block", np.full(m, block)), ("c", np.full(m, count)), ("core", signed(key)), ("whole", signed(whole)), ("off", off), ("m", wide - near + 1)):
                    out[name].append(x)
            if out["off"]:
                yield pa.RecordBatch.from_pydict({x: np.concatenate(y).astype(np.int32 if x in ("off", "m") else np.int64) for x, y in out.items()})

    return run


def _prints(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {x: [] for x in ("anchor", "block", "c", "off", "print")}
            for anchor, block, text, cells in zip(*(b[x].to_pylist() for x in ("anchor", "block", "bytes", "cells")), strict=True):
                c = sums(_units(text))
                for e in cells:
                    at, m = np.arange(e["off"], e["off"] + e["m"]), e["m"]
                    for name, x in (("anchor", np.full(m, anchor)), ("block", np.full(m, block)), ("c", np.full(m, e["c"])), ("off", at), ("print", signed(span(c, at, at + window)))):
                        out[name].append(x)
            if out["off"]:
                yield pa.RecordBatch.from_pydict({x: np.concatenate(y).astype(np.int32 if x == "off" else np.int64) for x, y in out.items()})

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kept = [], []
            for text, starts, lens in zip(*(b[x].to_pylist() for x in ("text", "starts", "lens")), strict=True):
                if not starts:
                    rows.append((len(text), 0, 0))
                    kept.append(text)
                    continue
                gone = passages.covered(len(text), starts, np.asarray(lens) + window - 1)
                rows.append((len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            if rows:
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": b["doc_id"], **_ints(rows, ["n_bytes", "n_removed", "n_spans"], ()), "kept": pa.array(kept, pa.binary())}
                )

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: removed bytes, runs and digest of what is left, for every document."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
