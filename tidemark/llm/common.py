"""Helpers that several operators share: reading, cutting lineage, word and span fingerprints."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: Base of the polynomial span fingerprints (odd, so it has an inverse modulo 2**64).
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors.

    The folder goes when the session's JVM ends. Shuffle files of finished steps are freed at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    del df
    free(spark)
    return out


def discard(df: DataFrame) -> None:
    """Remove a stashed table that nothing will read again."""
    where, fs = _place(df.sparkSession, df.stashed_at)
    fs.delete(where, True)


def _place(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def free(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and broadcasts that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(rid, doc_id, tag, text as bytes, carried): rid, and (doc_id, tag), tell rows apart that share only a doc_id.

    carried is a struct of the ``carry`` columns, out of the way of an operator's own names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.xxhash64("doc_id", text).alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.hash(text).alias("tag"),
        text.cast("binary").alias("text"),
        F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])).alias("carried"),
    )


def with_carried(schema: str, rows: DataFrame) -> StructType:
    """A schema with the type of ``rows.carried`` as last field; its names may hold anything."""
    return StructType.fromDDL(schema).add("carried", rows.schema["carried"].dataType)


_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    if len(_powers[0]) < n:
        m = max(2 * n, 4096)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            f = np.full(m, b, U64)
            f[0] = 1
            _powers[k] = np.cumprod(f, dtype=U64)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all of them (a bijection of 64-bit words)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def sums(v: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span`` reads the fingerprint of any span of ``v``."""
    out = np.zeros(len(v) + 1, U64)
    np.cumsum(v * powers(len(v) + 1)[0][: len(v)], out=out[1:])
    return out


def span(c: np.ndarray, start, stop) -> np.ndarray:
    """Fingerprints of the spans [start, stop), alike wherever in a text they stand."""
    return mixed((c[stop] - c[start]) * powers(len(c))[1][start])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours, in linear time."""
    m = len(x)
    pad = -m % w
    if pad:
        x = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)])
    rows = x.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: m - w + 1], before[w - 1 : m])


#: A random 64-bit value for each byte; the same with A-Z as a-z.
BYTES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
#: What ends a word: ASCII white space, or also ASCII punctuation.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = SPACE.copy()
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Bytes that are looked at in one go, so that memory stays bounded and in the cache.
_GO = 1 << 16
#: Bytes from which on a word is too long for a polynomial modulo 2**64, where patterns of two letters and their mirror
#: images meet: it gets a print that nobody can make collide.
LONG_WORD = 32


def word_hashes(texts: list[bytes], values: np.ndarray = BYTES, between: np.ndarray = SPACE) -> list[np.ndarray]:
    """A fingerprint of each word of each text, without making the words."""
    out, group, size = [], [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= _GO:
            out += _hashed(group, values, between)
            group, size = [], 0
    return out + _hashed(group, values, between) if group else out


def _hashed(texts: list[bytes], values: np.ndarray, between: np.ndarray) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = between[raw]
    starts, hashes, lo = [], [], 0
    while lo < len(raw):
        hi = min(lo + 4 * _GO, len(raw))
        if hi < len(raw):  # not within a word
            hi += int(np.argmax(gap[hi:]))
        turns = np.flatnonzero(np.diff(gap[lo:hi].view(np.int8), prepend=1, append=1))
        first, last = turns[::2], turns[1::2]
        prints = span(sums(values[raw[lo:hi]]), first, last)
        folded = values[65] == values[97]  # A as a
        for i in np.flatnonzero(last - first > LONG_WORD):
            word = raw[lo + first[i] : lo + last[i]].tobytes()
            prints[i] = int.from_bytes(hashlib.blake2b(word.lower() if folded else word, digest_size=8).digest(), "little")
        hashes.append(prints)
        starts.append(first + lo)
        lo = hi
    start, h = np.concatenate(starts), np.concatenate(hashes)
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return np.split(h, ends[:-1])
