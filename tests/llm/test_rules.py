"""Quality rules, spelling variants and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.brute import corpus, frame
from tidemark.llm import fill_middle, quality, spelling


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            again |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, letters = len(re.findall("[A-ZÀ-ÖØ-Þ]", text)), len(re.findall("[A-Za-zÀ-ÖØ-öø-ÿ]", text))
    chars, symbols, dup, n = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(words)
    base = n < 50 or 100 * len(again) > 50 * n
    bad = base or 100 * symbols > 40 * n or 100 * dup > 40 * len(lines) or 100 * upper > 40 * letters or not 2 * n <= chars <= 20 * n or 2 * letters < chars
    return n, chars, symbols, dup, len(again), base, not bad


TEXTS = [
    "a b c " * 40, "one two three\n" * 60, "A\x0bB\x0cC\rd\te f " * 30, " \n\t\n", "x y  z " * 30, "#tag *b* 100% & <i> | " * 20,
    "ABER NEIN " * 40, "\n".join(f"line {i} of many that differ {i * i}" for i in range(40)) + "\n \n\t", "supercalifragilisticexpialidocious" * 3 + " " + "q" * 50,
    " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "a a a a", "a b a b a", " ".join(str(i * i) for i in range(80)), "é" * 70 + " ü " * 60,
]


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sample", [1, 7, 10_000])
def test_quality(spark, sample):
    rows = corpus(n=40) + rows_of(TEXTS)
    got = sorted((tuple(r)[:8] for r in quality.quality(frame(spark, rows), sample=sample).drop("n_tried").collect()), key=str)
    assert got == sorted(((i, *plain_quality(t)) for i, t, *_ in rows), key=str)


def test_quality_carries_and_takes_empty_tables(spark):
    rows = frame(spark, rows_of(TEXTS))
    out = quality.quality(rows, measures=("n_words",), carry=("text", "carried", "n"))
    assert [f.name for f in out.schema["carried"].dataType] == ["text", "carried", "n"]
    assert sorted(r["carried"]["text"] for r in out.collect()) == sorted(TEXTS)
    assert quality.quality(rows.where("false")).collect() == []


def test_rules_are_ordered_by_rejections_for_what_they_newly_cost():
    rules = [quality.Rule("dear", "n_repeat_words", "n_words", 50), quality.Rule("cheap", "n_symbols", "one", 0), quality.Rule("free", "n_words", "one", 50, below=True), quality.Rule("idle", "n_symbols", "one", 9)]
    rejected = np.array([[1, 0, 0, 0]] * 6 + [[1, 1, 0, 0]] * 4 + [[0, 0, 1, 0]] * 2 + [[0, 0, 0, 0]] * 8, bool)
    cost = {"n_repeat_words": 1e-3, "words": 1e-4, "n_words": 1e-6, "n_symbols": 1e-5}
    assert quality.order_rules(rules, rejected, cost) == [1, 2, 0, 3]
    # What is made anyway costs nothing: the rule that lives on it comes before the symbols.
    made = quality.order_rules(rules, rejected, cost, ("n_words",))
    assert made[0] == 2 and set(made) == {0, 1, 2, 3}


def test_a_rejected_row_is_not_tried_further(spark):
    bad = "#" * 30 + " and some more ordinary words"
    rows = spark.createDataFrame([(i, bad) for i in range(400)], "doc_id long, text string").coalesce(1)
    tried = [r["n_tried"] for r in quality.quality(rows, measures=(), sample=50).collect()]
    assert sum(n == len(quality.RULES) for n in tried) == 50 and max(tried[50:]) <= 2


def plain_words(rows, least=7, damage=31):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    return {w: k for w, k in n.items() if k >= 2}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_spelling(rows):
    n, out, form = plain_words(rows), [], {}
    near = {w: [x for x in n if apart_by_one(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def misspelt(seed=3):
    """Words over few letters, so that many are near each other, in very different numbers, with runs of one letter."""
    r = random.Random(seed)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(7, 11))) for _ in range(150)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaa", "aabaaaa", "Éaaaaaa", "éaaaaaa"]
    for w in list(words):
        k = r.randrange(len(w))
        words += [w[:k] + w[k + 1 :], w[:k] + r.choice("abÀ") + w[k:], w[:k] + "a" + w[k + 1 :]]
    texts = [" ".join(r.choice(words[: r.choice([3, 30, len(words)])]) for _ in range(300)) for _ in range(25)]
    return [*rows_of([*texts, None, "", "short ones", "straße×naïve÷ " * 20, texts[0].upper(), "x1234567y " * 9, "kkkkkkkkzz " * 4 + "kkkkkkkkz " * 60 + "kkkkkkkk " * 900]), (None, texts[1], None, None, 0), (3, texts[3], "en", "s", 1), (3, texts[3], "en", "s", 1)]


@pytest.mark.parametrize("block", [4096, 5])
def test_spelling(spark, block):
    rows = misspelt()
    got = spelling.spelling(frame(spark, rows), block=block).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_spelling(rows)
    assert sorted(map(tuple, got)) == want
    assert sum(w[3] is not None for w in want) > 50 and any(w[5] != (w[3] or w[0]) for w in want)


def test_every_near_pair_is_under_exactly_one_half():
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(7, 10))) for _ in range(400)})
    found = Counter()
    halves = {}
    for w in words:
        for m in (len(w), len(w) - 1):
            h = m // 2
            halves.setdefault((False, m, w[:h]), []).append(w)
            halves.setdefault((True, m, w[len(w) - (m - h) :]), []).append(w)
    for (end, m, half), group in halves.items():
        index = spelling.Index(group, end, m, half)
        for w in group:
            found.update((w, x) for j, x in enumerate(group) if index.near(w) >> j & 1)
    assert found == Counter((a, b) for a in words for b in words if apart_by_one(a, b))


def test_spelling_of_nothing(spark):
    assert spelling.spelling(frame(spark, rows_of([None, "", "a b"]))).collect() == []
    assert spelling.spelling(frame(spark, rows_of(["x"])).where("false")).collect() == []


def plain_middle(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_fill_middle(spark):
    odd = ["<P>", "a <S> b", "<M", "S>", "<P<S<M", ">P>S>M>", "a\nb\r\n\x00c", "😀é😀 x", "abc", "…", "<<SS>>" * 50, "P>" * 40]
    rows = corpus(n=40) + [(1000 + k, t, "en", "s", 1) for k, t in enumerate(odd * 6)] + [(7, "ab, " * 300_000, "en", "s", 1), (-5, "minus five", None, None, None)]
    out = fill_middle.fill_middle(frame(spark, rows)).withColumn("back", fill_middle.restored())
    got = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back")) for r in out.collect()), key=str)
    want = sorted(((i, *plain_middle(i, t), t or "") for i, t, *_ in rows), key=str)
    assert got == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fill_middle_carries_and_takes_empty_tables(spark):
    rows = frame(spark, rows_of(TEXTS))
    assert sorted(r["carried"]["text"] for r in fill_middle.fill_middle(rows, carry=("text", "n")).collect()) == sorted(TEXTS)
    assert fill_middle.fill_middle(rows.where("false")).collect() == []
