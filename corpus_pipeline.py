"""A training corpus from raw documents: each stage calls one operator and returns what it kept.

All stages but the last return the columns of documents, whatever else they are called: a row travels as one struct,
apart from the columns that a stage works with. Every stage reads the whole of what the one before it wrote.

Alike in all stages: null texts are empty; a null doc_id is a row like any other unless a stage says otherwise; repeated
rows share their fate; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stash, table
from tidemark.llm.decontaminate import overlaps
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_components
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.toxicity import toxicity

#: What the last stage adds to the columns of documents.
MIX = ("mix_domain", "mix_tokens", "copies")


def _fields(docs: DataFrame, changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of documents out of a struct ``carried``, some of them changed."""
    return [(changed or {}).get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    A prediction depends on the text alone, so equal texts share it and there are no ties; empty texts are not toxic
    unless the labels say so of most of them.
    """
    scored = toxicity(docs, table(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return scored.where("predicted = 0").select(*_fields(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates linked by n-gram Jaccard similarity the one with the smallest doc_id stays.

    Rows of that doc_id that tie are kept if their texts differ; repeated rows, equal in doc_id and text, stay once. Rows
    without a doc_id cannot be told apart by it and stay, each text once. Texts without words are near nothing.
    """
    others = ngram_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.hash(text).alias("tag"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried"),
    )
    kept = rows.join(others, "doc_id", "left_anti").dropDuplicates(["doc_id", "print", "tag"])
    return kept.select(*_fields(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go.

    Earlier means a smaller doc_id, so rows of one doc_id tie and keep what they share; without a doc_id a row keeps all.
    What is cut has its words joined by single spaces and its n_chars counted anew; all else stays as it is.
    """
    cut = substring_dedup(docs, carry=tuple(docs.columns)).where("n_removed = 0 OR kept <> ''")
    own = F.col("carried").getField
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(own("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return cut.select(*_fields(docs, changed))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go. It does not matter which, so there are no ties.

    An item of a word or two is held by every document that has them: a benchmark with such items drops all of these, so
    leave such items out of the table where that is not wanted. Texts of any length are read whole.
    """
    found = overlaps(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return found.where("NOT contaminated").select(*_fields(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with where it places them and how often it takes them (``MIX``).

    Ties of its order are settled by doc_id, size and text. A column of documents that is called like one of ``MIX`` is
    kept as input_<name>.
    """
    taken = mix(docs, carry=tuple(docs.columns)).where("copies > 0")
    names = {c.lower() for c in docs.columns}
    kept = []
    for c in docs.columns:
        name = c
        while name.lower() in MIX or name != c and name.lower() in names:
            name = f"input_{name}"
        kept.append(F.col("carried").getField(c).alias(name))
    return taken.select(*kept, F.col("domain").alias("mix_domain"), F.col("n_tokens").alias("mix_tokens"), "copies")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
]
#: The first stage is a trained model, which SQL does not express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
