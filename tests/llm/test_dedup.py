import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import components, ngram_join, passages, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("window,k", [(50, 6), (12, 3)])
def test_substring(spark, rows, window, k):
    out = substring_dedup.substring_dedup(brute.frame(spark, rows), window, k)
    assert got(out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))) == brute.substring(rows, window)


def test_substring_carries_rows(spark, rows):
    out = substring_dedup.substring_dedup(brute.frame(spark, rows), carry=("doc_id", "text", "carried"))
    assert out.count() == len(rows) and out.select("carried.carried").distinct().count() == 1


@pytest.mark.parametrize("window,k", [(400, 32), (60, 8)])
def test_suffix(spark, rows, window, k):
    out = suffix_dedup.suffix_dedup(brute.frame(spark, rows), window, k)
    assert got(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == brute.suffix(rows, window)


def test_long_texts_in_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 512)
    assert list(passages.pieces(1000, 50)) == [(0, 512), (463, 975), (926, 1000)]
    assert sum(hi - lo - 49 for lo, hi in passages.pieces(1000, 50)) == 951


def test_ngram_components(spark, rows):
    assert got(ngram_join.ngram_components(brute.frame(spark, rows))) == brute.ngram(rows)


def test_ngram_chain_and_threshold(spark):
    """Exactly 80 % links; a chain is one component; one less does not link."""
    base = [f"w{i}" for i in range(13)]  # 9 shingles
    chain = [(10, " ".join(base)), (5, " ".join(base + ["y"])), (7, " ".join(base + ["y", "z"])), (1, " ".join(base[:11] + ["q", "r", "s", "t", "u"]))]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert got(ngram_join.ngram_components(df)) == brute.ngram(chain)


def test_ngram_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(words[: i % 110] + [f"e{i}"] + words[i % 110 + 1 :])) for i in range(300)]
    assert {r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {0}


def test_ngram_group_whose_leader_links_with_none(spark):
    """Two of a group's three classes link, neither with the class that leads it, and no other group is near."""
    for seed in range(200):
        a = [f"s{seed}w{i}" for i in range(24)]
        near, lead = [*a[:23], "x"], [*a[:21], "y", *a[22:]]
        sets = [ngram_join._shingles(w, 5) for w in ngram_join.word_hashes([" ".join(t).encode() for t in (lead, a, near)], ngram_join.LOWER)]
        if len({x[:5].tobytes() for x in sets}) == 1 and ngram_join._class(sets[0]) == min(map(ngram_join._class, sets)):
            break
    else:
        raise AssertionError("no such group")
    rows = [(1, " ".join(lead)), (2, " ".join(a)), (3, " ".join(near)), (4, "apart from all of them here")]
    out = got(ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute.ngram(rows)
    assert [r[2] for r in out] == [1, 2, 2, 4]


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(50, 60), (60, 50), (70, 70)], "a long, b long")
    found = dict(map(tuple, components.components(links).collect()))
    assert found == {**{i: 0 for i in range(41)}, 50: 50, 60: 50}


@pytest.mark.parametrize("f", [ngram_join.ngram_components, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def mirrored(levels=10):
    """Two words of 1,024 letters that every polynomial modulo 2**64 with an odd base takes for the same."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_take_for_the_same(spark):
    a, b = mirrored()
    rows = [(1, a, None, None, 1), (2, b, None, None, 1), (3, b.upper(), None, None, 1)]
    assert got(ngram_join.ngram_components(brute.frame(spark, rows))) == brute.ngram(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 2)]
    around = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{around} {a} {around}", None, None, 1), (2, f"{around} {b} {around}", None, None, 1)]
    out = substring_dedup.substring_dedup(brute.frame(spark, rows))
    assert got(out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))) == brute.substring(rows, 50)


def test_texts_beyond_a_piece(spark):
    """Passages that stand across the cuts of a long text, through the operators."""
    words = [f"w{i * 7919 % 2_000_003}" for i in range(passages.PIECE + 5000)]
    long_ = " ".join(words)
    cut = passages.PIECE
    rows = [(5, long_, None, None, 1), (9, " ".join(words[cut - 200 : cut + 200]), None, None, 1), (7, "x " + " ".join(words[cut - 60 : cut + 20]), None, None, 1)]
    out = substring_dedup.substring_dedup(brute.frame(spark, rows))
    assert got(out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))) == [
        (5, len(words), 0, brute.sha(long_.encode())), (7, 81, 80, brute.sha(b"x")), (9, 400, 400, brute.sha(b""))
    ]
    raw = long_.encode()
    rows = [(1, long_, None, None, 1), (2, raw[cut - 700 : cut + 700].decode(), None, None, 1)]
    n, m = len(raw), 1400
    want = [(1, n, m, 1, brute.sha(raw[: cut - 700] + raw[cut + 700 :])), (2, m, m, 1, brute.sha(b""))]
    assert got(suffix_dedup.suffix_dedup(brute.frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == want
