"""Operator 1, license scans by a positional rare-token index, in DataFrame functions only.

Templates are notices of known licences, each with a mandatory key phrase, and further key phrases on their own.
Document frequencies of the phrases' words are counted over the whole corpus in one pass; the word of a phrase with the
highest IDF is its probe. In the second pass each text's postings are the positions of probes. A posting proposes one
start; the phrase's second-rarest word must stand at the right relative position, and what is left is verified word by
word. A phrase found by its rarest word is found wherever it stands, so IDF decides the work but not the result. A
verified key phrase lays its notice over the text, and the words of the notice that stand at their relative positions
are its coverage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Fixed values: (label, mandatory key phrase). The first three are the base, whose places are counted.
BASE = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
#: Key phrases of notices and full texts beyond the base.
MORE = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("boost", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc", "creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal"),
    ("epl", "eclipse public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge"),
    ("mpl", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Fixed values: (key phrase, notice that holds it), in the words of the licences.
NOTICES = (
    (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at",
    ),
    (
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met",
    ),
    (
        "under the terms of the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation",
    ),
    (
        "permission to use copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public"
        " license as published by the free software foundation",
    ),
    (
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files the software to deal in the software without restriction including without limitation the rights to use copy modify"
        " merge publish distribute sublicense and or sell copies of the software",
    ),
    (
        "mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed"
        " with this file you can obtain one at",
    ),
    (
        "this is free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile"
        " sell or distribute this software",
    ),
)
PHRASES = tuple((label, tuple(phrase.split()), base) for rows, base in ((BASE, True), (MORE, False)) for label, phrase in rows)
#: (index of the key phrase, words of the notice, place of the phrase in it).
TEMPLATES = tuple(
    ([words for _, words, _ in PHRASES].index(tuple(key.split())), tuple(notice.split()), len(notice[: notice.index(key)].split())) for key, notice in NOTICES
)
VOCABULARY = sorted({w for _, words, _ in PHRASES for w in words})
#: What stands between words: ASCII characters other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """The words of a text column, lower-cased A-Z; null and empty texts have none."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(clean, BETWEEN), lambda w: w != "")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """One row, df: for each template word the number of rows whose text has it."""
    words = docs.select(F.array_intersect(words_of("text"), F.array(*map(F.lit, VOCABULARY))).alias("words"))
    # A sum for each word of the fixed vocabulary: nothing is exploded and one row per task is shuffled.
    sums = words.agg(*(F.sum(F.array_contains("words", w).cast("long")).alias(f"d{i}") for i, w in enumerate(VOCABULARY)), F.count("*").alias("n_docs"))
    return sums.select(
        "n_docs", F.map_from_arrays(F.array(*map(F.lit, VOCABULARY)), F.array(*(F.coalesce(F.col(f"d{i}"), F.lit(0)) for i in range(len(VOCABULARY))))).alias("df")
    )


def scan(docs: DataFrame) -> DataFrame:
    """Where licence phrases stand in each text.

    Returns one row per input row: doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest
    and largest start among them, words from 0, else null), base_labels, labels (of all phrases; both distinct, sorted,
    comma-joined, empty if none), coverage (the largest share of a notice's words that stand where its key phrase puts
    them, 0 without one), score: 1 - (1 - coverage) / (1 + places of all phrases), so 0 without any and 1 for a notice in full.

    Null and empty texts have no words and no labels. Of several places of a notice the one with the largest coverage
    counts, so ties change nothing. Texts of any length are read whole. Null doc_ids and repeated rows are rows like any other. Other
    columns of ``docs``, whatever their names, are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # One row; the probes of a phrase are its two words of highest IDF, that is smallest df.
    order = document_frequencies(docs).select(F.array(*(
        F.array_sort(F.array(*(F.struct(F.element_at("df", w).alias("df"), F.lit(i).alias("at"), F.lit(w).alias("word")) for i, w in enumerate(words))))
        for _, words, _ in PHRASES
    )).alias("probes"))
    candidate = F.array(*(F.lit(w) for w in VOCABULARY))
    rows = docs.select("doc_id", words_of("text").alias("words")).withColumn("n_words", F.size("words").cast("long"))
    rows = rows.withColumn("known", F.array_intersect("words", candidate)).crossJoin(F.broadcast(order))
    for i, (_, words, _) in enumerate(PHRASES):
        rows = rows.withColumn(f"p{i}", _places(words, F.element_at("probes", i + 1)))
    base = F.flatten(F.array(*(F.col(f"p{i}") for i, x in enumerate(PHRASES) if x[2])))
    places = sum((F.size(f"p{i}") for i in range(1, len(PHRASES))), F.size("p0"))

    def labels(kinds: list[int]) -> Column:
        found = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(PHRASES[i][0])) for i in kinds)))
        return F.array_join(F.array_sort(F.array_distinct(found)), ",")

    shares = [F.array_max(F.transform(f"p{i}", _share(t, at))) for i, t, at in TEMPLATES]
    rows = rows.withColumn("coverage", F.coalesce(F.greatest(*shares), F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        labels([i for i, x in enumerate(PHRASES) if x[2]]).alias("base_labels"), labels(list(range(len(PHRASES)))).alias("labels"),
        "coverage", (1 - (1 - F.col("coverage")) / (1 + places).cast("double")).alias("score"),
    )


def _share(notice: tuple[str, ...], at: int) -> Callable[[Column], Column]:
    """From a place of the key phrase, ``at`` words into a notice, the share of the notice's words that stand at theirs."""
    words = F.array(*map(F.lit, notice))

    def share(place: Column) -> Column:
        met = F.filter(F.sequence(F.lit(0), F.lit(len(notice) - 1)), lambda j: F.get("words", place - at + j) == F.get(words, j))
        return F.size(met) / F.lit(float(len(notice)))

    return share


def _places(words: tuple[str, ...], probes: Column) -> Column:
    """Starts of a phrase: postings of its rarest word, shifted, met by the second-rarest and verified."""
    rare, second, size = probes[0], probes[1], len(words)
    phrase = F.array(*map(F.lit, words))

    def fits(p: Column) -> Column:
        start = p - rare["at"]
        inside = (start >= 0) & (start + size <= F.size("words"))
        met = F.get("words", start + second["at"]) == second["word"]
        return inside & met & (F.slice("words", F.when(inside, start + 1).otherwise(1), size) == phrase)

    postings = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda p: F.get("words", p) == rare["word"])
    starts = F.transform(F.filter(postings, fits), lambda p: p - rare["at"])
    present = F.size(F.array_intersect(F.col("known"), phrase)) == len(set(words))
    return F.when(present, starts).otherwise(F.array().cast("array<int>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: licence phrases of every document."""
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '%s', '%s'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')" % (UPPER, LOWER)
    found = ", ".join(
        "list_filter(range(len(words) - %d), lambda p: %s) AS p%d" % (len(x) - 1, " AND ".join(f"words[p + {j + 1}] = '{w}'" for j, w in enumerate(x)), i)
        for i, (_, x, _) in enumerate(PHRASES)
    )
    base = [i for i, x in enumerate(PHRASES) if x[2]]
    joined = "p%d || p%d || p%d" % tuple(base)
    labels = lambda kinds: "array_to_string(list_sort(list_distinct(list_filter([%s], lambda x: x IS NOT NULL))), ',')" % ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{PHRASES[i][0]}' END" for i in kinds)
    shares = ", ".join(
        "list_max(list_transform(p%d, lambda p: len(list_filter(range(%d), lambda j: p - %d + j >= 0 AND words[p - %d + j + 1] = [%s][j + 1])) / %d.0::DOUBLE))"
        % (i, len(x), at, at, ", ".join(f"'{w}'" for w in x), len(x)) for i, x, at in TEMPLATES
    )
    return f"""
        WITH w AS (SELECT doc_id, {words} AS words FROM documents),
        f AS (SELECT doc_id, words, len(words) AS n_words, {found} FROM w),
        g AS (SELECT *, coalesce(greatest({shares}), 0)::DOUBLE AS coverage FROM f)
        SELECT doc_id, n_words::BIGINT AS n_words, len({joined})::BIGINT AS n_base, list_min({joined})::BIGINT AS first_word,
            list_max({joined})::BIGINT AS last_word, {labels(base)} AS base_labels, {labels(range(len(PHRASES)))} AS labels,
            coverage, 1 - (1 - coverage) / (1 + {" + ".join(f"len(p{i})" for i in range(len(PHRASES)))})::DOUBLE AS score
        FROM g"""


ORACLE = _oracle()
