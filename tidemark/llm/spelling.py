"""Operator 12, spelling variants by a bit-sliced position index.

Two words that differ by one insertion, deletion or replacement share their first half or their last one, so words meet
under four halves at most. The words under one half are ordered by occurrences and indexed by bits: for each (position,
letter) one integer has a bit for every word with that letter there. A query word runs over the index letter by letter:
one set holds the words without an error so far, another those with one, and both move on by a few operations on whole
integers, at the same position for a replacement, one further or one back for a letter too many or too few. What is left
at the end are the near words: their number is a count of bits, the commonest of them is the lowest bit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stash, table
from tidemark.llm.licenses import LOWER, UPPER

#: Least code points of a word, least occurrences, and how many times commoner a word's form is.
LEAST, TWICE, TIMES = 7, 2, 10
#: One of so many runs loses a letter, by the hash of its document and itself.
DAMAGE = 31
#: Words of a half that are indexed, or asked for, together. A commoner half is dealt into a grid of such blocks.
BLOCK = 4096


def occurrences(docs: DataFrame, least: int = LEAST, twice: int = TWICE, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of the words that stand ``twice`` or more over all texts, in Spark's functions alone."""
    # A run shorter than ``least`` cannot be a word, even whole; greedy matches are maximal runs.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = each.select(F.when(h % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def _halves(words: DataFrame) -> DataFrame:
    """(end, size, half, word, n): a word under the halves of its own size and of the size below, where it is the longer."""
    size, word = F.length("word"), F.col("word")
    keys = []
    for less in (0, 1):
        m = size - less
        h = F.floor(m / 2).cast("int")
        last = (m - h).cast("int")
        keys += [F.struct(F.lit(False).alias("end"), m.alias("size"), F.substring(word, F.lit(1), h).alias("half")),
                 F.struct(F.lit(True).alias("end"), m.alias("size"), F.substring(word, size - last + 1, last).alias("half"))]
    return words.select(F.explode(F.array(*keys)).alias("key"), "word", "n").select("key.end", "key.size", "key.half", "word", "n")


KEY = ["end", "size", "half"]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best): for each of the distinct ``words`` (word, n) that has near words their number, and of the
    commonest of them (ties: smallest in code-point order) a struct (less: -n, word)."""
    halves = _halves(words)
    sizes = halves.groupBy(*KEY).agg(F.count("*").alias("n_key"))
    # Most halves fit one block and go on as they are; the few others are few rows here.
    large = sizes.where(F.col("n_key") > block).select(*KEY, F.ceil(F.col("n_key") / block).cast("int").alias("parts"))
    rows = halves.join(large, KEY, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    place = lambda known, asks: F.struct(known.alias("known"), asks.alias("asks"))
    # One block: both known and asking. A grid: known in a whole row of it, asking in a whole column.
    grid = F.concat(F.transform(each, lambda j: F.struct(place(own, j).alias("at"), F.lit(1).alias("role"))), F.transform(each, lambda i: F.struct(place(i, own).alias("at"), F.lit(2).alias("role"))))
    alone = F.array(F.struct(place(F.lit(0), F.lit(0)).alias("at"), F.lit(3).alias("role")))
    dealt = rows.select(*KEY, "word", "n", F.explode(F.when(F.col("parts") == 1, alone).otherwise(grid)).alias("x"))
    dealt = dealt.select(*KEY, F.col("x.at.known").alias("known"), F.col("x.at.asks").alias("asks"), F.col("x.role").alias("role"), "word", "n")
    group = [*KEY, "known", "asks"]
    # What is known comes before what only asks, the commonest first: the lowest bit is the best answer.
    ordered = dealt.repartition(*group).sortWithinPartitions(*group, F.col("role") == 2, F.desc("n"), "word")
    found = ordered.mapInArrow(_asked, "word string, n_near long, n_best long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n_best")).alias("less"), F.col("best").alias("word"))).alias("best"))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group; a group's index is built when its last known word has come, and rows that ask stream past it."""
    group, known, counts, index = None, [], [], None
    out: tuple[list, ...] = ([], [], [], [])

    def answer(word: str) -> None:
        hits = index.near(word)
        if hits:
            best = (hits & -hits).bit_length() - 1
            for c, v in zip(out, (word, hits.bit_count(), counts[best], known[best]), strict=True):
                c.append(v)

    def close() -> None:
        nonlocal index
        if index is None and len(known) > 1:
            index = Index(known, group[0], group[1], group[2])
            for word in known if both else ():
                answer(word)

    both = False
    for b in batches:
        cols = [b[c].to_pylist() for c in ("end", "size", "half", "known", "asks", "role", "word", "n")]
        for *key, role, word, n in zip(*cols, strict=True):
            if key != group:
                close()
                group, known, counts, index, both = key, [], [], None, role == 3
            if role != 2:
                known.append(word)
                counts.append(n)
            else:
                if index is None:
                    index = Index(known, group[0], group[1], group[2])
                answer(word)
        if out[0]:
            yield _batch(out)
            out = ([], [], [], [])
    close()
    yield _batch(out)


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["word", "n_near", "n_best", "best"])


class Index:
    """Bits of the words under one half: bit j of ``at[i][c]`` is set if word j has the letter c at position i.

    Words have ``size`` letters or one more. Under a first half, words are near by an error in what follows it. Under a
    last half the error is before it, and words that also share the first half are left to that one, so a pair of near
    words is found under exactly one half.
    """

    def __init__(self, words: Sequence[str], end: bool, size: int, half: str):
        self.end, self.size, self.cut = end, size, size // 2
        bits: list[defaultdict[str, list[int]]] = [defaultdict(list) for _ in range(size + 1)]
        short = []
        for j, word in enumerate(words):
            for letters, c in zip(bits, word):
                letters[c].append(j)
            if len(word) == size:
                short.append(j)
        n = len(words)
        self.all = (1 << n) - 1
        self.at = [{c: _bits(js, n) for c, js in letters.items()} for letters in bits]
        self.short = _bits(short, n)
        self.long = self.all ^ self.short

    def near(self, word: str) -> int:
        """The set of words that differ from ``word`` by exactly one insertion, deletion or replacement."""
        return self._fewer(word) if len(word) > self.size else self._same_or_more(word)

    def _same_or_more(self, word: str) -> int:
        at, cut = self.at, self.cut
        none = self.all  # words without an error so far
        replaced = added = 0
        if self.end:
            for i in range(cut):
                c, here, on = word[i], at[i], at[i + 1]
                same = here.get(c, 0)
                added = (added | none) & on.get(c, 0)
                replaced = (replaced & same) | (none & ~same)
                none &= same
            shared = none
            for i in range(cut, self.size):
                added &= at[i + 1].get(word[i], 0)
                replaced &= at[i].get(word[i], 0)
                if not (added or replaced):
                    return 0
            return ((replaced & self.short) | (added & self.long)) & ~shared
        for i in range(cut, self.size):
            c = word[i]
            same = at[i].get(c, 0)
            added = (added | none) & at[i + 1].get(c, 0)
            replaced = (replaced & same) | (none & ~same)
            none &= same
        return (replaced & self.short) | ((added | none) & self.long)

    def _fewer(self, word: str) -> int:
        at, cut = self.at, self.cut
        none, left_out = self.all, 0
        if not self.end:
            for i in range(cut, len(word)):
                left_out = (left_out & at[i - 1].get(word[i], 0)) | none
                none &= at[i].get(word[i], 0)
            return left_out & self.short
        for i in range(cut):
            left_out = (left_out & at[i - 1].get(word[i], 0) if i else 0) | none
            none &= at[i].get(word[i], 0)
        for i in range(cut, len(word)):
            left_out &= at[i - 1].get(word[i], 0)
            if not left_out:
                return 0
        return left_out & self.short & ~none


def _bits(js: list[int], n: int) -> int:
    if n <= 60 or len(js) < 8:
        x = 0
        for j in js:
            x |= 1 << j
        return x
    raw = bytearray(n // 8 + 1)
    for j in js:
        raw[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(raw, "little")


def spelling(docs: DataFrame, least: int = LEAST, twice: int = TWICE, times: int = TIMES, damage: int = DAMAGE, block: int = BLOCK) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n and root.

    Words are maximal runs of Latin letters of the texts in lower case (A-Z alone), one in ``damage`` without a letter,
    of ``least`` code points and ``twice`` occurrences. ``form`` is the commonest near word if it is ``times`` as common
    as the word, ``root`` the last of the forms that follow from it. Ties between near words go to the smallest in
    code-point order. Null and empty texts have no words, very long ones are read whole, a null doc_id hashes as one
    without digits, and a repeated row's words count again. Other columns of ``docs``, whatever their names, are ignored.
    An empty table gives an empty result.
    """
    words = stash(occurrences(docs, least, twice, damage))
    near = near_words(words, block)
    rows = words.join(near, "word", "left")
    good = -F.col("best.less") >= times * F.col("n")
    rows = stash(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.less")).cast("long").alias("form_n"),
    ))
    discard(words)
    roots = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = rows.join(roots, "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) where forms end. A form is at least ``times`` as common, so chains are short and have no rings; each
    round doubles what a step spans."""
    steps = stash(steps)
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        wider = stash(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not wider.where("moved").isEmpty()
        discard(steps)
        steps = wider
        if not moved:
            return steps.select("word", "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: spelling variants of all documents' words."""
    return spelling(table(spark, sf_dir, "documents"))


#: CRC-32 in SQL: its table of 256 remainders by rule, then byte by byte over the hexadecimal form.
_CRC = """rem AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    crc AS MATERIALIZED (SELECT id, run, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda k: ('0x' || x[2 * k + 1 : 2 * k + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM (SELECT DISTINCT id, run, hex(encode(id || ':' || run)) AS x FROM runs), rem)"""
ORACLE = f"""
    WITH RECURSIVE runs AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{{7,}}}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
    {_CRC},
    e AS (SELECT CASE WHEN h % 31 = 0 THEN run[: (h % length(run))] || run[h % length(run) + 2 :] ELSE run END AS word FROM runs JOIN crc USING (id, run)),
    v AS MATERIALIZED (SELECT word, count(*) AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
    l AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM l a JOIN l b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT l.word, v.word, v.n FROM l JOIN v ON l.rest = v.word UNION SELECT v.word, l.word, l.n FROM l JOIN v ON l.rest = v.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
    f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT word, n, n_near, form, form_n, r.root FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) r USING (word)""".replace("{{7,}}", "{7,}")
