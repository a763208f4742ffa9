"""Operator 11, quality rules as a short-circuit cascade.

A rule rejects a text by a few measures of it. Each task measures its first rows with every rule, and so learns what a
measure costs and which rows a rule rejects; then it orders the rules greedily by rows newly rejected for the seconds
newly spent, and a later row is tried by the next rule only while no rule has rejected it. A row is kept if no rule
rejects it, so the order, which depends on clocks, decides the work and never the result: a task that is run again after
a lost executor gives the same rows.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import table

#: Rows that a task measures by all rules before it orders them.
SAMPLE = 256
#: What counts as a symbol, a capital, a letter.
SYMBOLS, CAPITALS, LETTERS = "#*$%&|<>", re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
SPACES = " \t\n\x0b\x0c\r"


class Rule(NamedTuple):
    """Rejects a text if ``limit`` per cent of one measure are exceeded by, or (below) not reached by, another."""

    name: str
    measure: str
    of: str
    percent: int
    below: bool = False

    def rejects(self, m: Text) -> bool:
        value, bound = 100 * m[self.measure], self.percent * m[self.of]
        return value < bound if self.below else value > bound


#: The rules of the base, then those of this operator.
BASE = (Rule("few_words", "n_words", "one", 5000, below=True), Rule("repeated_words", "n_repeat_words", "n_words", 50))
MORE = (
    Rule("symbols", "n_symbols", "n_words", 40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 40),
    Rule("capitals", "n_capitals", "n_letters", 40),
    Rule("short_words", "word_chars", "n_words", 200, below=True),
    Rule("long_words", "word_chars", "n_words", 2000),
    Rule("few_letters", "n_letters", "word_chars", 50, below=True),
)
RULES = BASE + MORE
#: What the query returns of every text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text(dict):
    """Measures of one text, each made when it is first asked for; ``spent`` adds up what the making took, by measure."""

    def __init__(self, text: str, spent: dict[str, float] | None = None):
        super().__init__(one=1)
        self.text, self.spent = text, spent

    def __missing__(self, name: str):
        if self.spent is None:
            self[name] = value = _MEASURES[name](self)
            return value
        began, inner = time.perf_counter(), sum(self.spent.values())
        self[name] = value = _MEASURES[name](self)
        took, inner = time.perf_counter() - began, sum(self.spent.values()) - inner
        self.spent[name] = self.spent.get(name, 0.0) + took - inner  # without the measures that it asked for
        return value


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that stand in the text twice or more. Words are numbered, so nothing is taken for equal
    that is not."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]  # below the number of words
    _, which, n = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def _lines(text: str) -> list[str]:
    return [line for line in text.split("\n") if line.strip(SPACES)]


_MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda m: m.text.encode("utf-8", "surrogatepass").split(),  # at ASCII white space alone
    "n_words": lambda m: len(m["words"]),
    "word_chars": lambda m: len(m.text) - sum(map(m.text.count, SPACES)),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "lines": lambda m: _lines(m.text),
    "n_lines": lambda m: len(m["lines"]),
    "n_dup_lines": lambda m: len(m["lines"]) - len(set(m["lines"])),
    "n_repeat_words": lambda m: _repeated(m["words"]),
    "n_capitals": lambda m: len(m.text) - len(CAPITALS.sub("", m.text)),
    "n_letters": lambda m: len(m.text) - len(LETTERS.sub("", m.text)),
}
#: What each measure is made of.
_PARTS = {"n_words": ("words",), "n_repeat_words": ("words",), "n_lines": ("lines",), "n_dup_lines": ("lines",)}


def _needs(rule: Rule) -> set[str]:
    direct = {rule.measure, rule.of} - {"one"}
    return direct | {p for m in direct for p in _PARTS.get(m, ())}


def order_rules(rules: Sequence[Rule], rejected: np.ndarray, cost: dict[str, float], made: Sequence[str] = ()) -> list[int]:
    """Indices of rules, greedily by rows newly rejected per second newly spent.

    ``rejected`` tells for each row of the sample and each rule whether the rule rejects the row; ``cost`` is what a
    measure costs a row; measures in ``made`` are there anyway. Rules share measures, so one becomes cheap by what stands
    before it. Ties go to the rule named first.
    """
    have = {*made, *(p for m in made for p in _PARTS.get(m, ()))}
    left, order, alive = list(range(len(rules))), [], np.ones(len(rejected), bool)
    while left:
        price = lambda i: sum(cost.get(m, 0.0) for m in _needs(rules[i]) - have) + 1e-7  # noqa: E731  a comparison costs something too
        best = max(left, key=lambda i: ((rejected[alive, i].sum() + 1e-6) / price(i), -i))
        left.remove(best)
        order.append(best)
        have |= _needs(rules[best])
        alive &= ~rejected[:, best]
    return order


def _cascade(rules: Sequence[Rule], measures: Sequence[str], sample: int):
    base = [i for i, r in enumerate(rules) if r in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, spent, seen = list(range(len(rules))), {}, []
        for b in batches:
            cols, kept, failed, tried = [[] for _ in measures], [], [], []
            for text in b["text"].to_pylist():
                if len(seen) < sample:
                    m = Text(text, spent)
                    hits = [r.rejects(m) for r in rules]
                    seen.append(hits)
                    first = next((i for i in order if hits[i]), None)
                    n = len(rules)
                    if len(seen) == sample:
                        order = order_rules(rules, np.array(seen), {k: v / sample for k, v in spent.items()}, measures)
                else:
                    m, first, n = Text(text), None, 0
                    for i in order:
                        n += 1
                        if rules[i].rejects(m):
                            first = i
                            break
                tried.append(n)
                kept.append(first is None)
                failed.append(first is not None and any(rules[i].rejects(m) for i in base))
                for c, name in zip(cols, measures, strict=True):
                    c.append(m[name])
            out = [b["doc_id"], *(pa.array(c, pa.int64()) for c in cols), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(tried, pa.int32()), b["carried"]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *measures, "base_failed", "kept", "n_tried", "carried"])

    return run


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, measures: Sequence[str] = COUNTS, sample: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the ``measures`` (long), base_failed (a base rule rejects it), kept (no rule does),
    n_tried (rules tried until one rejected; it depends on the order that a task found) and ``carry`` columns as a struct
    ``carried``. Measures that are not returned are made only if a rule that is reached asks for them.

    Words are runs without ASCII white space; lines are what \\n splits and has a word. A null text is empty: no words, so
    it is rejected. Texts are measured whole, whatever their length. Null doc_ids and repeated rows are rows like any
    other. A tie at a limit is no rejection. Other columns of ``docs``, whatever their names, are ignored. An empty table
    gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])).alias("carried"),
    )
    fields = "".join(f"{m} long, " for m in measures)
    schema = StructType.fromDDL(f"doc_id long, {fields}base_failed boolean, kept boolean, n_tried int").add("carried", rows.schema["carried"].dataType)
    out = rows.mapInArrow(_cascade(tuple(rules), tuple(measures), sample), schema)
    return out if carry else out.drop("carried")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: measures and verdict of every document."""
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    side = lambda r, own: f"100 * {own(r.measure)} {'<' if r.below else '>'} {r.percent} * {own(r.of)}"
    own = lambda m: "1" if m == "one" else m
    any_of = lambda rules: " OR ".join(side(r, own) for r in rules)
    without = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        t AS (SELECT r, k, words[k + 1] || ' ' || words[k + 2] || ' ' || words[k + 3] AS g FROM (SELECT r, words, unnest(range(len(words) - 2)) AS k FROM w WHERE len(words) > 2)),
        a AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM t) WHERE n > 1),
        p AS (SELECT r, count(DISTINCT k + j) AS n FROM a, (SELECT unnest(range(3)) AS j) GROUP BY r),
        m AS (SELECT doc_id, len(words)::BIGINT AS n_words, ({without(r'[^\x20\x09-\x0D]')})::BIGINT AS word_chars, ({without('[#*$%&|<>]')})::BIGINT AS n_symbols,
            len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
            {without('[A-ZÀ-ÖØ-Þ]')} AS n_capitals, {without('[A-Za-zÀ-ÖØ-öø-ÿ]')} AS n_letters FROM w LEFT JOIN p USING (r))
        SELECT doc_id, {", ".join(COUNTS)}, {any_of(BASE)} AS base_failed, NOT ({any_of(RULES)}) AS kept FROM m"""


ORACLE = _oracle()
