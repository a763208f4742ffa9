"""Fixed-length features of windows, as column expressions."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freq(tokens: Column, alphabet: list[str]) -> Column:
    """Share of the window that each token of the alphabet takes."""
    n = F.greatest(F.lit(1), F.size(tokens)).cast("double")
    return F.array(*(F.size(F.filter(tokens, _is(a))) / n for a in alphabet))


def _is(*wanted: str):
    return lambda x: x.isin(*wanted)


def presence(tokens: Column, rare: list[str]) -> Column:
    """1 for each rare token that stands in the window at all: a long window does not dilute it."""
    return F.array(*(F.array_contains(tokens, r).cast("double") for r in rare))


def entropy(freqs: Column) -> Column:
    """Shannon entropy in bits."""
    return F.aggregate(F.filter(freqs, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def unique_ratio(tokens: Column, size: int) -> Column:
    """Distinct tokens by the size of the alphabet."""
    return F.size(F.array_distinct(tokens)) / F.lit(float(size))


def assemble(windows: DataFrame, alphabet: list[str], rare: list[str]) -> DataFrame:
    """Add features: frequencies, presences, entropy, unique ratio and highest frequency, in this order."""
    f = freq(F.col("tokens"), alphabet)
    d = windows.withColumn("freq", f).withColumn("pres", presence(F.col("tokens"), rare))
    return d.withColumn("features", F.concat("freq", "pres", F.array(entropy(F.col("freq")), unique_ratio(F.col("tokens"), len(alphabet)), F.array_max("freq"))))


def top_vocabulary(windows: DataFrame, k: int = 20) -> DataFrame:
    """(token, n, rank): the commonest tokens over all windows, overlaps counted; ties in alphabetical order."""
    top = windows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")))


def vocabulary_freq(windows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Frequencies over a vocabulary that is data: its k tokens come as one row."""
    words = vocabulary.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("words"))
    n = F.greatest(F.lit(1), F.size("tokens")).cast("double")
    return windows.crossJoin(F.broadcast(words)).withColumn(
        "freq", F.transform("words", lambda w: F.size(F.filter("tokens", lambda x: x == w)) / n)
    ).drop("words")


def group_freq(windows: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Share of each functional group of tokens in the window."""
    n = F.greatest(F.lit(1), F.size("tokens")).cast("double")
    names = sorted(set(groups.values()))
    of = {g: [t for t, x in groups.items() if x == g] for g in names}
    return windows.withColumns({f"grp_{g}": F.size(F.filter("tokens", _is(*of[g]))) / n for g in names})


def gaps(rows: DataFrame, key: str, order: list[str], ts: str, per: int) -> DataFrame:
    """(key, block, n, mean, std, longest): seconds between neighbours, by blocks of ``per`` rows."""
    w = Window.partitionBy(key).orderBy(*order)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    d = rows.select(key, ((F.row_number().over(w) - 1) / per).cast("long").alias("block"), ((us - F.lag(us).over(w)) / 1e6).alias("gap"))
    return d.where("gap IS NOT NULL").groupBy(key, "block").agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("std"), F.max("gap").alias("longest")
    )


def frequent_patterns(windows: DataFrame, support: float = 0.5, longest: int = 3) -> DataFrame:
    """(pattern, freq): ordered patterns that many windows have."""
    rows = windows.select(F.transform("tokens", lambda t: F.array(t)).alias("sequence"))
    found = PrefixSpan(minSupport=support, maxPatternLength=longest).findFrequentSequentialPatterns(rows)
    return found.select(F.array_join(F.transform("sequence", lambda s: s[0]), ">").alias("pattern"), "freq")


def pattern_match(windows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add ``matched``, which of the patterns (in alphabetical order) stand in the window in their order, gaps allowed,
    and ``match_ratio``, the share of them. The patterns are data: they come as one row. Without any, the ratio is 0."""
    known = patterns.agg(F.transform(F.array_sort(F.collect_set("pattern")), lambda p: F.split(p, ">")).alias("_p"))

    def stands(p: Column) -> Column:
        step = lambda i, t: F.when(t == F.get(p, i), i + 1).otherwise(i)
        return F.aggregate("tokens", F.lit(0), step) == F.size(p)

    d = windows.crossJoin(F.broadcast(known)).withColumn("matched", F.transform("_p", stands)).drop("_p")
    hits = F.size(F.filter("matched", lambda m: m)).cast("double")
    return d.withColumn("match_ratio", F.coalesce(hits / F.nullif(F.size("matched"), F.lit(0)), F.lit(0.0)))
