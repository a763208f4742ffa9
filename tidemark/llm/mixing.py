"""Operator 5, mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A budget of tokens starts at the root; at each node it is split among the children
by weight, and what a child cannot supply goes to its siblings by their weights, and to the ancestors' other children
only when all siblings are exhausted. As a node's capacity is the sum of its leaves', that is one split from the top
down with known capacities, in closed form at each level. A leaf supplies whole epochs and then a prefix of one more, in
an order seeded for that epoch.

Leaves are few next to documents. A leaf's order is dealt into 4096 buckets by the leading digits of the order; only
within buckets are documents sorted, so a leaf with a third of all rows is no single task. What one task adds up for a
leaf is the sums of its buckets: 4096 rows at most, however large the leaf.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stash, table

#: Tokens wanted, as a share of all there are; most epochs of a leaf; seed of the orders.
SHARE, EPOCHS, SEED = 0.5, 2, 17
LEAF = ("domain", "lang", "source")
#: Leading hexadecimal digits of an order that make a bucket.
DIGITS = 3
#: Target weights of children below their parents; what is not named weighs 1.
WEIGHTS: dict[str, Mapping[str, float]] = {
    "domain": {"d0": 3.0, "d1": 2.0},
    "lang": {"en": 4.0, "de": 2.0},
    "source": {"src0": 2.0},
}
BETWEEN = r"[\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Number of runs without ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), lambda w: w != "")).cast("long")


def domain(source: str = "source") -> Column:
    """d0 to d3 by the number that a source's name ends in, else other."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.try_cast("long") % 4).cast("string")))


def mix(
    docs: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document is taken.

    Returns one row per input row: doc_id, domain, lang, source, n_tokens (words), copies and the ``carry`` columns as a
    struct ``carried``. Null and empty languages and sources are named ``unknown``. Texts without words, null ones too,
    add nothing to a prefix and are taken with the rows around them. Null doc_ids are ordered like an empty string; ties
    of the order go by doc_id, n_tokens, then a hash of the text, so only wholly repeated rows are left to tie: as many of
    them are taken as fit. Very long texts count whole, and may alone exceed what is left of a budget. Weights must not be
    negative; a child of weight 0 gets nothing. Other columns of ``docs``, whatever their names, are ignored. An empty
    table gives an empty result.
    """
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(c))
    rows = stash(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tag"),
        domain().alias("domain"), known("lang").alias("lang"), known("source").alias("source"), words().alias("n_tokens"),
        F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])).alias("carried"),
    ))
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    for level in LEAF:
        named = [x for k, v in weights.get(level, {}).items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*named)[F.col(level)], F.lit(1.0)) if named else F.lit(1.0)
        leaves = leaves.withColumn(f"w_{level}", weight)
    leaves = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    leaves = leaves.crossJoin(F.broadcast(leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * share).alias("budget"))))
    for depth, level in enumerate(LEAF):
        leaves = _split(leaves, LEAF[:depth], level)
    whole = F.floor(F.when(F.col("tokens") > 0, (F.col("budget") + 1e-6) / F.col("tokens")).otherwise(0.0))
    leaves = stash(leaves.select(*LEAF, whole.alias("whole"), F.floor(F.col("budget") + 1e-6 - whole * F.col("tokens")).alias("rest")))

    # A leaf's documents may be many, leaves are not: the table is broadcast by Spark where small, else joined by sort.
    placed = rows.join(leaves, list(LEAF))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = placed.withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = placed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("own"))
    sums = sums.withColumn("before", F.sum("own").over(Window.partitionBy(*LEAF).orderBy("bucket")) - F.col("own")).drop("own")
    inside = Window.partitionBy(*LEAF, "bucket").orderBy("key", "doc_id", "n_tokens", "tag").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n_tokens").over(inside)
    out = placed.join(sums, [*LEAF, "bucket"]).withColumn("upto", upto).select(
        "doc_id", *LEAF, "n_tokens", (F.col("whole") + (F.col("upto") <= F.col("rest")).cast("long")).alias("copies"), "carried"
    )
    return out if carry else out.drop("carried")


def _split(leaves: DataFrame, parents: tuple[str, ...], level: str) -> DataFrame:
    """Replace each leaf's budget, its parent's so far, by that of its node at ``level``."""
    node = [*parents, level]
    nodes = leaves.where(f"w_{level} > 0").groupBy(*node).agg(F.first("budget").alias("b"), F.first(f"w_{level}").alias("w"), F.sum("cap").alias("cap"))
    group = Window.partitionBy(*(F.col(p) for p in parents)) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("cap") / F.col("w")), level).rowsBetween(Window.unboundedPreceding, 0)
    # A child is exhausted if filling all to its ratio of capacity to weight would not exceed the budget.
    nodes = nodes.withColumns({"caps": F.sum("cap").over(order) - F.col("cap"), "rest_w": F.sum("w").over(group) - F.sum("w").over(order) + F.col("w")})
    full = F.col("caps") + F.col("cap") / F.col("w") * F.col("rest_w") <= F.col("b") + 1e-6
    nodes = nodes.withColumn("full", full)
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(group)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(group)
    nodes = nodes.select(*node, F.when(F.col("full"), F.col("cap")).otherwise((F.col("b") - used) * F.col("w") / F.nullif(open_w, F.lit(0.0))).alias("given"))
    return leaves.join(nodes, node, "left").withColumn("budget", F.coalesce("given", F.lit(0.0))).drop("given")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: copies of every document in the mix."""
    return mix(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def weight(level: str) -> str:
        return "CASE " + level + "".join(f" WHEN '{k}' THEN {float(v)}" for k, v in WEIGHTS[level].items()) + " ELSE 1.0::DOUBLE END"

    sql = f"""
        WITH r AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '(\\d{{1,9}})$', 1) = '' THEN 'other'
                ELSE 'd' || (regexp_extract(source, '(\\d{{1,9}})$', 1)::BIGINT % 4)::VARCHAR END AS domain,
            coalesce(nullif(lang, ''), 'unknown') AS lang, coalesce(nullif(source, ''), 'unknown') AS source,
            len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BETWEEN}'), lambda w: w <> ''))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS tag FROM documents),
        s AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens) * {EPOCHS}::DOUBLE AS cap,
            {weight("domain")} AS w_domain, {weight("lang")} AS w_lang, {weight("source")} AS w_source FROM r GROUP BY ALL),
        b_root AS (SELECT *, (SELECT sum(tokens) FROM s) * {SHARE} AS budget FROM s)"""
    last = "b_root"
    for depth, level in enumerate(LEAF):
        node, over = ", ".join(LEAF[: depth + 1]), "PARTITION BY " + ", ".join(LEAF[:depth]) if depth else ""
        sql += f""",
        n_{level} AS (SELECT {node}, any_value(budget) AS b, any_value(w_{level}) AS w, sum(cap) AS cap FROM {last} GROUP BY {node}),
        o_{level} AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, sum(w) OVER after AS rest_w FROM n_{level}
            WINDOW before AS ({over} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            after AS ({over} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        f_{level} AS (SELECT *, caps + cap / w * rest_w <= b + 1e-6 AS filled FROM o_{level}),
        g_{level} AS (SELECT *, CASE WHEN filled THEN cap ELSE (b - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({over})) * w
            / sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({over}) END AS given FROM f_{level}),
        b_{level} AS (SELECT x.* REPLACE (given AS budget) FROM {last} x JOIN g_{level} USING ({node}))"""
        last = f"b_{level}"
    return sql + f""",
        t AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN floor((budget + 1e-6) / tokens) ELSE 0 END::BIGINT AS whole, tokens, budget FROM {last}),
        u AS (SELECT *, floor(budget + 1e-6 - whole * tokens)::BIGINT AS rest FROM t)
        SELECT doc_id, domain, lang, source, n_tokens, whole + (sum(n_tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY md5('{SEED}|' || whole || '|' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, n_tokens, tag ROWS UNBOUNDED PRECEDING) <= rest)::BIGINT AS copies
        FROM r JOIN u USING (domain, lang, source)"""


ORACLE = _oracle()
