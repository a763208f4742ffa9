"""Sources and sinks: ordered sequences, score streams, dictionaries, scores, reports and tables of trials."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(rows: DataFrame, key: str, order: list[str], token: Column) -> DataFrame:
    """The long form (seq_id, pos, token): pos counts from 0 in the given order, which should have no ties."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select(F.col(key).alias("seq_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), token.alias("token"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type"))


#: The order of a supplier's lines.
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def line_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "lineitem"), "l_suppkey", LINE_ORDER, F.concat("l_returnflag", "l_linestatus"))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, tenant, ts, label, score): errors are the attack class, values the scores."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("tenant"), "ts",
        F.when(F.col("event_type") == "error", "attack").otherwise("benign").alias("label"), F.col("value").alias("score"),
    )


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) from lines ``id abi name ...``.

    Blank lines, lines that start with #, lines of fewer than three fields, ids that are not numbers and the x32
    interface are skipped; of a name's entries the one furthest down in its file holds.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    fields = lines.where("line <> '' AND NOT startswith(line, '#')").select(F.split("line", r"\s+").alias("f"), "at")
    kept = fields.where("size(f) >= 3").select(F.expr("try_cast(f[0] AS BIGINT)").alias("id"), F.col("f")[1].alias("abi"), F.col("f")[2].alias("token"), "at")
    return kept.where("id IS NOT NULL AND abi <> 'x32'").groupBy("token").agg(F.max_by("id", "at").alias("id"))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place that ``spark.checkpoint.dir`` names; under a temporary one where that is unset."""
    sc = spark.sparkContext
    if not (base := sc.getConf().get("spark.checkpoint.dir", None)):
        if sc.getCheckpointDir() is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = sc.getCheckpointDir()
    path = f"{base}/out-{uuid.uuid4().hex}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what several branches of a plan read is computed once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing will read again."""
    _remove(df.sparkSession, df.written_at)


#: Where each shared result of an application lies, its columns, and the state of the source that it was made of.
_ONCE: dict[tuple[str, ...], tuple[str, StructType, tuple[int, int, int]]] = {}


def once(spark: SparkSession, name: str, sf_dir: str, source: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A result that several queries of one application read, written when the first of them asks for it.

    It holds as long as the files of the table ``source`` are the ones it was made of, and is made anew when they change.
    """
    key, state = (spark.sparkContext.applicationId, name, sf_dir), _state(spark, f"{sf_dir}/{source}.parquet")
    if key in _ONCE and _ONCE[key][2] != state:
        _remove(spark, _ONCE.pop(key)[0])
    if key not in _ONCE:
        rows = build(spark, sf_dir)
        path = scratch(spark)
        rows.write.parquet(path)
        _ONCE[key] = (path, rows.schema, state)
    path, schema, _ = _ONCE[key]
    return spark.read.schema(schema).parquet(path)


def _state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files under a path, their bytes, and when one was last changed."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    found, n, size, last = where.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(where, True), 0, 0, 0
    while found.hasNext():
        f = found.next()
        n, size, last = n + 1, size + f.getLen(), max(last, f.getModificationTime())
    return n, size, last


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores as Parquet in folders by arm and label; kept in single precision, as calibration reads them back."""
    scores.withColumn("score", F.col("score").cast("float")).write.partitionBy("arm", "label").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """One nested JSON object for each row."""
    metrics.write.json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header."""
    rows.write.option("header", True).csv(path)
