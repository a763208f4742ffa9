"""Plain versions of the operators, and small tables that hold every awkward case."""

import hashlib
import random
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Rows with copies, near copies, shared passages, nulls, empty, tiny and long texts, and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    passage = " ".join(word() for _ in range(80))
    texts = [" ".join(word() for _ in range(r.randrange(1, 300))) for _ in range(n)]
    for i in range(0, n, 6):
        texts.append(texts[i])
        words = texts[i].split()
        if len(words) > 40:
            words[len(words) // 2] = "edited"
            texts.append(" ".join(words))
        texts.append(texts[i + 1] + " " + passage + "\n" + texts[i + 2])
    long_ = " ".join(word() for _ in range(4000))
    texts += [None, "", " \t\n", "a", "a b c d", "a b c d", "ab " * 700, "x" * 2000, long_, long_ + " end", "é ü ß " * 200]
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", "src1", None, ""][i % 4 if i % 2 else 0], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[7], "en", "src0", 1), (None, None, None, None, None)]


def frame(spark, rows):
    """With columns whose names clash with the operators' own."""
    extra = "rid long, anchor string, n long, start string, text2 string, carried string, node int"
    return spark.createDataFrame([(*r, 1, "x", 2, "y", None, "z", 3) for r in rows], f"{SCHEMA}, {extra}")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def substring(rows, window):
    first = {}
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def suffix(rows, window):
    docs = [(i, (t or "").encode()) for i, t, *_ in rows]
    n = Counter(b[s : s + window] for _, b in docs for s in range(len(b) - window + 1))
    out = []
    for i, b in docs:
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if n[b[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def ngram(rows, k=5, percent=80):
    sets = [shingles(t, k) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    names = defaultdict(list)
    for i, r in enumerate(rows):
        names[root(i)].append(r[0])
    low = {c: min((x for x in ids if x is not None), default=None) for c, ids in names.items()}
    return sorted(((r[0], len(sets[i]), low[root(i)] if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def tiling(a, b, least):
    ma, mb, total = [0] * len(a), [0] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best >= least:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best] = mb[j : j + best] = [1] * best
                total += best
