"""Operator 13, fill-in-the-middle by repeated-capture matching.

One full match of ``(unit)*`` by the regex library keeps every repetition of the group: the ends of its captures are the
ends of the units, so their number is n and two of them are the cuts. No unit is visited in Python. Which cuts and which
form a text gets follows from a hash of its doc_id, made by Spark's functions, as are the digests and the inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import table

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Per cent of texts that are cut at all, and of those that begin with their suffix.
CUT, SUFFIX_FIRST = 90, 20
#: Possessive, so nothing is kept for going back: a letter after letters never begins a unit of its own.
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")


def _draws(doc_id: Column, seed: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, seed: str = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars (code
    points; null if plain), output (the text in its form) and the ``carry`` columns as a struct ``carried``.

    A unit is a run of ASCII letters or one other character. A text that is empty or holds one of the three marks stays
    plain, so the marks of an output are its own and ``restored`` is exact. A null text is empty. A null doc_id draws as
    one without digits. Repeated rows are cut alike, and parts may be empty; there are no ties. Texts are matched whole: a
    very long one needs some tens of bytes for each of its units in its task. Other columns of ``docs``, whatever their
    names, are ignored. An empty table gives an empty result.
    """
    h1, h2, h3, h4 = _draws(F.col("doc_id").cast("long"), seed)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"),
        F.when(h3 % 100 >= cut, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
        F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])).alias("carried"),
    )
    schema = StructType.fromDDL("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string").add("carried", rows.schema["carried"].dataType)
    out = rows.mapInArrow(_formed, schema)
    return out if carry else out.drop("carried")


def _formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ns, forms, prefixes, middles, outputs = [], [], [], [], []
        for text, h1, h2, form in zip(*(b[c].to_pylist() for c in ("text", "h1", "h2", "form")), strict=True):
            ends = UNITS.fullmatch(text).ends(1)
            n = len(ends)
            ns.append(n)
            if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                form = "plain"
            forms.append(form)
            if form == "plain":
                prefixes.append(None)
                middles.append(None)
                outputs.append(text)
                continue
            first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, c = (ends[k - 1] if k else 0 for k in (first, last))
            prefix, middle, suffix = text[:a], text[a:c], text[c:]
            prefixes.append(a)
            middles.append(c - a)
            outputs.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
        made = [pa.array(x, t) for x, t in ((ns, pa.int64()), (forms, pa.string()), (prefixes, pa.int64()), (middles, pa.int64()), (outputs, pa.string()))]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *made, b["carried"]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "carried"])


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output in its form was made of. A mark cannot begin within a part and end in a mark, or the other
    way round, so splitting at marks finds the three that were put in."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    psm, spm = (F.concat(*(F.get(part, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document in its form, and rebuilt from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256")
    )


ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT,
        ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS h FROM d),
    f AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
            WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, array_to_string(units[:a], '') AS pre, array_to_string(units[a + 1 : b], '') AS mid, array_to_string(units[b + 1 :], '') AS suf FROM f),
    o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
    r AS (SELECT *, string_split_regex(output, '<[PSM]>') AS x FROM o)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
        sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256 FROM r"""
