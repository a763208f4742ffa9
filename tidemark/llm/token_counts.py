"""Operator 4, token counts by prefix dynamic programming.

A byte-level BPE encodes pre-tokens (words with the space before them) one by one. Of a pre-token, the table holds the
exact count at every byte prefix: the encoding of a prefix is that of a shorter prefix and one more token, the only one
that ends there and that the merges leave beside the token before it. Such neighbours are looked up in a memory of
pairs. A text's table is the running sum over its pre-tokens with their own tables in between, so totals, counts at any
cut and the longest cut within a budget follow from it; nothing is encoded again.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

LIMIT = 1024
#: Bytes that a task's remembered tables may take, about, and pairs that it remembers.
TABLE_BYTES, PAIRS = 96_000_000, 1_000_000
#: Longer pre-tokens are counted each time and not remembered.
LONG = 256
#: What a table takes beside its counts.
_OVERHEAD = 200
#: Characters of a pre-token whose prefix may be split differently once the text ends there: a space, a contraction.
_RESPLIT = 3
# Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, others from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


@lru_cache(maxsize=4)
def _counter(path: str) -> Counter:
    return Counter(path)


class Counter:
    """Exact token counts with the byte-level BPE of a tokenizer's .json file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.model = Tokenizer.from_file(path).model
        self.ending = ahocorasick.Automaton()
        for token in model["vocab"]:
            self.ending.add_word(token, (token, len(token)))
        self.ending.make_automaton()
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, array] = {}
        self.size = 0
        self.pairs: dict[tuple[str, str], bool] = {}

    def _stands(self, before: str, token: str) -> bool:
        """Whether the merges leave the two tokens beside each other; with nothing before it, the token as it is."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        made = [t.value for t in self.model.tokenize(before + token)]
        found = self.pairs[before, token] = made == ([before, token] if before else [token])
        return found

    def prefixes(self, word: str) -> array:
        """Tokens of each byte prefix of a pre-token, from the empty one to the whole."""
        known = self.known.get(word)
        if known is not None:
            return known
        letters = word.encode().decode("latin-1").translate(_LETTERS)
        n = len(letters)
        count, last, pairs = [0] * (n + 1), [""] * (n + 1), self.pairs
        for end, (token, size) in self.ending.iter(letters):
            end += 1
            if not last[end]:
                before = last[end - size]
                found = pairs.get((before, token))
                if found or found is None and self._stands(before, token):
                    last[end] = token
                    count[end] = count[end - size] + 1
        if not all(last[1:]):
            raise ValueError("a byte that the vocabulary lacks")
        count = array("i", count)
        if n <= LONG:
            self.size += 5 * n + _OVERHEAD
            if self.size > TABLE_BYTES:
                self.known.clear()
                self.size = 5 * n + _OVERHEAD
            self.known[word] = count
        return count

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """The text cut at special strings: (is one, string)."""
        if not self.special or not self.special.search(text):
            return [(False, text)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(False, text[at : m.start()]), (True, m[0])]
            at = m.end()
        return [*out, (False, text[at:])]

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens and special strings of a text and the tokens of each."""
        words: list[str] = []
        own: list[int] = []
        get, made = self.known.get, self.prefixes
        for special, piece in self.pieces(text):
            if special:
                words.append(piece)
                own.append(1)
            else:
                found = self.words(piece)
                words += found
                own += [(get(w) or made(w))[-1] for w in found]
        return words, own

    def table(self, text: str) -> Prefixes:
        return Prefixes(self, text)


class Prefixes:
    """The prefix table of one text."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text = counter, text
        self.words, own = counter.counts(text)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)))
        self.upto = np.cumsum(np.asarray(own, np.int64))

    @property
    def total(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def _before(self, i: int) -> tuple[int, int]:
        """Where pre-token i starts, and the tokens before it."""
        return (int(self.ends[i - 1]), int(self.upto[i - 1])) if i else (0, 0)

    def at(self, cut: int) -> int:
        """Tokens of text[:cut]."""
        cut = min(cut, len(self.text))
        # A text that ends at the cut may be split differently there: white space looks ahead, a contraction may be cut.
        i = max(0, bisect_right(self.ends, cut) - 2)
        at, tokens = self._before(i)
        for special, piece in self.counter.pieces(self.text[at:cut]):
            for w in [piece] if special else self.counter.words(piece):
                while i < len(self.words) and self.ends[i] <= at:
                    i += 1
                whole = self.words[i]
                if special:
                    tokens += 1
                elif self._before(i)[0] == at and whole.startswith(w) and len(whole) > LONG:
                    tokens += self._long(i)[len(w.encode())]
                else:
                    tokens += self.counter.prefixes(w)[-1]
                at += len(w)
        return tokens

    def _long(self, i: int) -> array:
        """The table of a long pre-token, kept with the text that has it."""
        if getattr(self, "_held", (None,))[0] != i:
            self._held = (i, self.counter.prefixes(self.words[i]))
        return self._held[1]

    def fit(self, budget: int) -> int:
        """The longest cut, in characters, of at most ``budget`` tokens."""
        i = bisect_right(self.upto, budget)
        if i == len(self.words):
            return len(self.text)
        start, before = self._before(i)
        word = self.words[i]
        count = self._long(i) if len(word) > LONG else self.counter.prefixes(word)
        inside, at = set(range(1, min(_RESPLIT, len(word)) + 1)), 0
        for c, letter in enumerate(word[:-1], 1):
            at += len(letter.encode())
            if count[at] <= budget - before:
                inside.add(c)
        for c in sorted(inside, reverse=True):
            if self.at(start + c) <= budget:
                return start + c
        return start


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), fits: the length in
    characters of the longest prefix of the text that has at most ``limit`` tokens.

    Tokens are those of the library with the tokenizer file at ``path`` on every executor, without begin and end tokens;
    special strings inside a text count as the one token that the library makes of them. A file that is not a plain
    byte-level BPE is refused. Null and empty texts have no tokens. Very long texts and pre-tokens are counted whole; what
    a task remembers is bounded in bytes. Null doc_ids and repeated rows are rows like any other; nothing depends on
    order, so there are no ties. Other columns of ``docs``, whatever their names, are ignored. An empty table gives an
    empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            total, fits = [], []
            for text in b["text"].to_pylist():
                prefixes = counter.table(text)
                total.append(prefixes.total)
                fits.append(prefixes.fit(limit) if prefixes.total > limit else len(text))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["n_bytes"], pa.array(total, pa.int64()), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "fits"]
            )

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fits long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: tokens of every document, and how much of it fits."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
