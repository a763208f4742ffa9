"""Toxicity's parts against plain versions: features word by word, the lexicon by counting, isotonic steps by pooling."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T

EDGES = T._EDGES
LEXICON = {"idiot": 3.0, "trash": 3.0, "^blar": 1.5, "^blarg": 2.25, "zugh": 0.5}


def weight(word, lexicon):
    return max([lexicon.get(word, 0.0), *(lexicon.get("^" + word[:k], 0.0) for k in (4, 5) if len(word) >= k)])


def plain_features(text, lexicon):
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 13
    weights, hidden = [], 0
    for raw in words:
        low = raw.strip(EDGES).lower()
        w = weight(low, lexicon)
        if len(raw) < 40 and T._MIXED.search(raw):
            hidden += 1
            w = max(w, weight(re.sub(r"[\W\d_]+", "", raw.lower().translate(T.LOOK_ALIKES)), lexicon))
        weights.append(int(w * 100) / 100)
    hit = [w > 0 for w in weights]
    single = [len(x.strip(EDGES).lower()) == 1 and x.strip(EDGES).isalpha() for x in words]
    i = 0
    while i < n:
        j = i
        while j < n and single[j]:
            j += 1
        if j - i > 2 and sum(single) > 2:
            w = weight("".join(x.strip(EDGES) for x in words[i:j]).lower(), lexicon)
            if w:
                weights[i], hit[i] = int(w * 100) / 100, True
                hidden += 1
        i = max(j, i + 1)
    you = [k for k, x in enumerate(words) if x.strip(EDGES).lower() in T.SECOND_PERSON]
    near = sum(any(abs(k - y) <= T.NEAR for y in you) for k in range(n) if hit[k])
    raw = text.encode()
    size = len(raw)
    count = lambda test: sum(map(test, raw)) / size
    return [
        math.log1p(n), sum(hit) / n, math.log1p(sum(hit)), sum(weights) / n, max(weights), near / n, len(you) / n, count(lambda b: 65 <= b <= 90),
        sum(len(x.strip(EDGES)) >= 3 and x.strip(EDGES).isupper() for x in words) / n, text.count("!") / size, text.count("?") / size,
        count(lambda b: chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), hidden / n,
    ]


def texts(seed=4, n=150):
    r = random.Random(seed)
    words = "you the an idiot IDIOT! tr4sh i d i o t blarging blargfoo Your ... zugh? ÜBER a1b2 $tupid 1d10t é ß u *** word,s (trash) tu t r a s h".split()
    made = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(n)]
    return [*made, "", " \n\t", "i d i o t", "a b", "x" * 5000, "you " * 3000 + "idiot", "!!!", "i d i", *made[:3]]


def test_features(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(T._features(LEXICON), "doc_id long, features array<double>").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["features"] == pytest.approx(plain_features(rows[r["doc_id"]][1], LEXICON), abs=1e-9), rows[r["doc_id"]]


def test_lexicon(spark):
    r = random.Random(9)
    rows = []
    for _ in range(400):
        toxic = int(r.random() < 0.3)
        words = [f"w{r.randrange(300)}" for _ in range(30)] + ["vilethings" if toxic and r.random() < 0.6 else "calm", "Rotter!" if toxic and r.random() < 0.3 else "fine"]
        rows.append((" ".join(words), toxic))
    rows += [("", 1), ("", 0), (rows[0][0], rows[0][1])]
    n = Counter(t for _, t in rows)
    held = {1: Counter(), 0: Counter()}
    for text, toxic in rows:
        words = {w.strip(EDGES) for w in text.lower().split()} - {""}
        held[toxic].update(words | {"^" + w[:k] for w in words for k in (4, 5) if len(w) >= k})
    rated = []
    for token, t in held[1].items():
        c = held[0][token]
        p, q = t / n[1], (c + 0.5) / (n[0] + 1)
        if t >= T.LEAST_TEXTS and p >= T.LEAST_RATIO * q:
            rated.append((t * math.log(t / ((t + c) * n[1] / (n[1] + n[0]))), token, math.log(p / q)))
    want = {w: 3.0 for w in T.INSULTS} | {token: w for gain, token, w in sorted(rated, reverse=True)[: T.LEXICON] if gain > 5}
    got = T._lexicon(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    assert got == pytest.approx(want) and {"vilethings", "^vile", "rotter"} <= set(got)


def pooled(points):
    """Pool adjacent violators over distinct p."""
    by = {}
    for p, y in points:
        by.setdefault(p, []).append(y)
    blocks = []
    for p in sorted(by):
        blocks.append([sum(by[p]), len(by[p]), [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ps]
    return [(p, s / n) for s, n, ps in blocks for p in ps]


def test_isotonic_steps(spark):
    r = random.Random(2)
    points = [(p := round(r.random(), 2), float(r.random() < p * p)) for _ in range(300)]
    fitted = IsotonicRegression(featuresCol="p", labelCol="toxic").fit(spark.createDataFrame(points, "p double, toxic double"))
    xs = [0.0, 0.001, 0.37, 0.371, 0.5, 0.555, 0.999, 1.0, *(p for p, _ in points[:20])]
    score = T._stepped(F.col("x"), fitted.boundaries.toArray(), fitted.predictions.toArray())
    got = [x["y"] for x in spark.createDataFrame([(x,) for x in xs], "x double").select(score.alias("y")).collect()]
    at, value = zip(*pooled(points))
    want = [min(1.0, max(0.0, 0.998 * float(np.interp(x, at, value)) + 0.002 * x)) for x in xs]
    assert got == pytest.approx(want, abs=1e-9)


def test_scores_of_equal_and_very_long_texts_agree(spark):
    """A text repeated, and one of a hundred thousand words: the score depends on the text alone."""
    rows = [(i, ("you idiot trash " if i % 3 == 0 else "calm words here ") * (2 + i % 5)) for i in range(300)]
    rows += [(i + 1000, t) for i, t in rows[:50]] + [(5000, "you idiot " * 50_000), (5001, "calm words " * 50_000), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in T.toxicity(docs, labels).collect()}
    assert all(got[i] == got[i + 1000] for i in range(50)) and got[None] == got[0]
    assert got[5000][1] == 1 and got[5001][1] == 0
