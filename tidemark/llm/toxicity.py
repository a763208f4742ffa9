"""Operator 7, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, those with the smallest fingerprint of their doc_id, so that the
lookup tables and the labels can be broadcast. Rows are dealt to folds by crc32 of the doc_id: fold 0 is held out from
everything, 3 and 4 give the lexicon, 2 the trees, 1 the calibration; a token that fits one fold by chance misleads no
other. Scoring is a narrow pass over all rows: one table look-up a word, then trees and a step function in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stash, table, with_carried

#: Bound of the labelled rows that are fitted on.
TRAIN_ROWS = 40_000
#: Bounds of the token tables: candidates that are counted, and lexicon entries.
CANDIDATES, LEXICON = 50_000, 400
#: A lexicon token is in this many toxic texts at least, and this many times as frequent there as elsewhere.
LEAST_TEXTS, LEAST_RATIO = 4, 6.0
TREES, DEPTH = 20, 3
#: Words around a second-person pronoun that count as addressed.
NEAR = 5

#: Plain insults that are in the lexicon from the start.
INSULTS = """
asshole bastard bitch clown creep cretin crap dimwit disgusting dumb dumbass fool freak fuck garbage hate idiot imbecile
jerk kill loser lunatic moron nasty pathetic pig psycho retard scum shit sick slut stupid trash ugly useless vermin
whore worthless arschloch dumm hure idiotin schlampe trottel abschaum connard con salope imbécile ordure débile
estúpido gilipollas idiota imbécil mierda puta basura
""".split()
#: Second-person pronouns in four languages.
SECOND_PERSON = set("""
you your yours yourself youre u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted
ustedes vosotros vos
""".split())
#: Look-alike characters and the letters they stand for.
LOOK_ALIKES = str.maketrans("013457$@!|€", "oieastsaiie")

FEATURES = (
    "log_words", "lexicon_rate", "log_lexicon", "weight_rate", "top_weight", "addressed_rate", "second_person_rate",
    "capital_rate", "capital_words", "exclamation_rate", "question_rate", "punctuation_rate", "obfuscated_rate",
)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MIXED = re.compile(r"\w*[^\W\d_][\d$@!|*€_.-]+[^\W_]|[\d$@]+[^\W\d_]+\w*[\d$@]*[^\W\d_]")
_EDGES = ".,;:!?\"'()[]{}<>«»„“”¿¡…-*_"


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every text for toxicity as ``labels.toxic`` marks it.

    Returns one row per input row: doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (1 if score >=
    0.5, else 0) and the ``carry`` columns as a struct ``carried``. A score depends on the text alone.

    Repeated rows are scored alike, and texts of any length are read whole. Null and empty texts get the score of a text without words. Rows with a null doc_id are scored, and not held out.
    Null labels are left out; labels repeated for a doc_id count as toxic if any is. Where labels are missing or of one
    kind, the score is 1 - exp(-50 * lexicon_rate) with the fixed lexicon; without calibration rows of both kinds the
    trees' own probability stands. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    fold = lambda c: F.crc32(F.col(c).cast("string")) % 5
    marked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])).alias("carried"),
    )
    # Bounded by train_rows times (a long and an int).
    train = stash(texts.drop("carried").join(F.broadcast(marked), "doc_id").withColumn("fold", fold("doc_id").cast("int")))
    lexicon = _lexicon(train.where("fold >= 3"))

    made = texts.mapInArrow(_features(lexicon, "carried"), with_carried("doc_id long, features array<double>", texts))
    known = stash(train.where("fold < 3").mapInArrow(_features(lexicon, "toxic", "fold"), "doc_id long, features array<double>, toxic int, fold int"))
    known = known.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("toxic"), "fold")
    both = {r["fold"]: r["kinds"] == 2 for r in known.groupBy("fold").agg(F.count_distinct("toxic").alias("kinds")).collect()}

    rate = F.get("features", FEATURES.index("lexicon_rate"))
    if both.get(2):
        fitted_on = known.where("fold = 2").coalesce(4).cache()
        trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7).fit(fitted_on)
        fitted_on.unpersist()
        scored = trees.transform(made.withColumn("dense", F.col("features")).withColumn("features", array_to_vector("features")))
        score = vector_to_array("probability")[1]
        if both.get(1):
            own = trees.transform(known.where("fold = 1")).select(score.alias("p"), "toxic")
            steps = IsotonicRegression(featuresCol="p", labelCol="toxic").fit(own)
            score = _stepped(score, steps.boundaries.toArray(), steps.predictions.toArray())
    else:
        scored, score = made, 1 - F.exp(-50 * rate)
    out = scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), score.alias("score"), "carried")
    out = out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "carried")
    return out if carry else out.drop("carried")


def _stepped(x: Column, boundaries: np.ndarray, values: np.ndarray) -> Column:
    """Linear between the boundaries, level beyond them, as isotonic regression predicts; a little of x breaks ties."""
    bounds, out = F.array(*map(F.lit, boundaries.tolist())), F.array(*map(F.lit, values.tolist()))
    after = F.size(F.filter(bounds, lambda b: b <= x))
    x0, x1, y0, y1 = F.get(bounds, after - 1), F.get(bounds, after), F.get(out, after - 1), F.get(out, after)
    y = F.when(after == 0, out[0]).when(after == len(values), out[len(values) - 1]).otherwise(y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.998 * F.coalesce(y, y0) + 0.002 * x))


def _tokens(text: str) -> set[str]:
    """Words, and starts of words as ^start."""
    words = {w.strip(_EDGES) for w in text.lower().split()}
    words.discard("")
    return words | {"^" + w[:k] for w in words for k in (4, 5) if len(w) >= k}


def _lexicon(train: DataFrame) -> dict[str, float]:
    """Tokens that mark toxic texts, with their log odds."""
    def count(kind: str, wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter[str] = Counter()
            for b in batches:
                for text in b["text"].to_pylist():
                    n.update(_tokens(text) if wanted is None else _tokens(text) & wanted)
                if len(n) > 500_000:
                    yield pa.RecordBatch.from_pydict({"token": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})
                    n.clear()
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        rows = train.where(F.col("toxic") == (1 if kind == "toxic" else 0)).select("text").mapInArrow(run, "token string, n long")
        return rows.groupBy("token").agg(F.sum("n").alias("n"))

    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    found = {w: 3.0 for w in INSULTS}
    if n1 and n0:
        frequent = count("toxic", None).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "token").limit(CANDIDATES).collect()
        often = {r["token"]: r["n"] for r in frequent}
        clean = {r["token"]: r["n"] for r in count("clean", frozenset(often)).collect()}
        rated = []
        for token, t in often.items():
            p, q = t / n1, (clean.get(token, 0) + 0.5) / (n0 + 1)
            if p >= LEAST_RATIO * q:
                expected = (t + clean.get(token, 0)) * n1 / (n1 + n0)
                rated.append((t * np.log(t / expected), token, float(np.log(p / q))))
        found |= {token: weight for gain, token, weight in sorted(rated, reverse=True)[:LEXICON] if gain > 5}
    return found


class _Words(dict):
    """What is known of each word: a weight in hundredths above bit 8, marks below."""

    ADDRESS, CAPITALS, OBFUSCATED, LETTER = 1, 2, 4, 8

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def weight(self, word: str) -> float:
        found = self.lexicon
        return max(found.get(word, 0.0), found.get("^" + word[:4], 0.0) if len(word) >= 4 else 0.0, found.get("^" + word[:5], 0.0) if len(word) >= 5 else 0.0)

    def __missing__(self, raw: str) -> int:
        if len(self) > 300_000:
            self.clear()
        word = raw.strip(_EDGES)
        low = word.lower()
        marks, weight = 0, self.weight(low)
        if low in SECOND_PERSON:
            marks |= self.ADDRESS
        if len(word) >= 3 and word.isupper():
            marks |= self.CAPITALS
        if len(low) == 1 and low.isalpha():
            marks |= self.LETTER
        if len(raw) < 40 and _MIXED.search(raw):
            marks |= self.OBFUSCATED
            plain = re.sub(r"[\W\d_]+", "", raw.lower().translate(LOOK_ALIKES))
            weight = max(weight, self.weight(plain))
        self[raw] = v = int(weight * 100) << 8 | marks
        return v


def _features(lexicon: dict[str, float], *keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(lexicon)
        for b in batches:
            rows = [_row(t, known) for t in b["text"].to_pylist()]
            flat = np.array(rows, np.float64).reshape(-1)
            ends = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(ends, flat), *(b[c] for c in keep)], ["doc_id", "features", *keep])

    return run


def _row(text: str, known: _Words) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    v = np.fromiter(map(known.__getitem__, words), np.int64, n)
    marks, weight = v & 255, v >> 8
    hit = weight > 0
    letters = np.flatnonzero(marks & _Words.LETTER)
    spelled = 0
    if len(letters) > 2:  # words spelled letter by letter
        for run in np.split(letters, np.flatnonzero(np.diff(letters) > 1) + 1):
            if len(run) > 2:
                w = known.weight("".join(words[i].strip(_EDGES) for i in run).lower())
                if w:
                    weight[run[0]], hit[run[0]] = int(w * 100), True
                    spelled += 1
    hits = int(hit.sum())
    person = np.flatnonzero(marks & _Words.ADDRESS)
    addressed = 0
    if hits and len(person):
        at = np.flatnonzero(hit)
        i = np.searchsorted(person, at)
        gap = np.minimum(np.abs(at - person[np.minimum(i, len(person) - 1)]), np.abs(at - person[np.maximum(i - 1, 0)]))
        addressed = int((gap <= NEAR).sum())
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = len(raw)
    return [
        np.log1p(n), hits / n, np.log1p(hits), weight.sum() / 100 / n, weight.max() / 100, addressed / n, len(person) / n,
        ((raw >= 65) & (raw <= 90)).sum() / size, (marks & _Words.CAPITALS > 0).sum() / n, (raw == 33).sum() / size,
        (raw == 63).sum() / size, _PUNCTUATION[raw].sum() / size, ((marks & _Words.OBFUSCATED > 0).sum() + spelled) / n,
    ]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
