import random
import re

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm import decontaminate, html_text, licenses, mixing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_licenses_equal_sql(spark, tmp_path):
    texts = ["MIT License", "the mit-license, MIT LICENSE.", None, "", "Permission is hereby granted, free of charge", "GNU  General\nPublic License v3",
             "mitlicense mit licenses", "general public general public license", "Licensed under CC BY-NC 4.0", "é MIT License ü", "mit mit license license", "mit license " * 500]
    texts += [x for _, notice in licenses.NOTICES for x in (notice, notice[:-30] + " x", "as published by " + notice.replace("software", "program"))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (0, "MIT License")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_words int, words string")
    docs.write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert ordered(licenses.scan(docs).collect()) == ordered(duck.sql(licenses.ORACLE).fetchall())
    assert licenses.scan(docs.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, rows):
    lib = Tokenizer.from_file(PATH)
    r = random.Random(2)
    odd = ["".join(r.choice(" \t\n'stdllABé你½٣\U0001f600\x85<|>") for _ in range(40)) for _ in range(200)] + ["a<|endoftext|>b <|endoftext|>"]
    texts = [t for _, t, *_ in rows] + odd + ["".join(r.choice("abcdefg") for _ in range(30_000)), "a  " * 9000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), (n := count(t or "")), n > 1024) for i, t in enumerate(texts)]
    got = token_counts.token_counts(df, PATH).collect()
    assert ordered(g[:4] for g in got) == ordered(want)
    for g in got:  # the longest prefix that fits
        t, end = texts[g["doc_id"]] or "", g["fits"]
        assert count(t[:end]) <= 1024 and (end == len(t) or all(count(t[:c]) > 1024 for c in range(end + 1, min(len(t), end + 30) + 1)))
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


def test_every_prefix():
    """Counts at all cuts and the longest cut within every budget, against the library on each prefix."""
    c, lib, r = token_counts.Counter(PATH), Tokenizer.from_file(PATH), random.Random(3)
    for _ in range(200):
        parts = [" ", "\n", "'", "s", "ab", "12", ".", "é", "<|endoftext|>", "'ll", "    ", " hello", "the"]
        text = "".join(r.choice(parts) for _ in range(25))
        n = [len(lib.encode(text[:cut], add_special_tokens=False).ids) for cut in range(len(text) + 1)]
        table = c.table(text)
        assert [table.at(cut) for cut in range(len(text) + 1)] == n and table.total == n[-1]
        for budget in range(0, 30, 4):
            assert table.fit(budget) == max(cut for cut, x in enumerate(n) if x <= budget)


def test_cuts_within_a_long_word_and_bounded_memory(monkeypatch):
    c, lib, r = token_counts.Counter(PATH), Tokenizer.from_file(PATH), random.Random(4)
    text = "x " + "".join(r.choice("etaoinshré") for _ in range(3000))
    table = c.table(text)
    for cut in (3, 700, 701, 2999):
        assert table.at(cut) == len(lib.encode(text[:cut], add_special_tokens=False).ids)
    monkeypatch.setattr(token_counts, "TABLE_BYTES", 5000)
    for i in range(300):
        assert c.table(f"word{i} again").total == len(lib.encode(f"word{i} again").ids)
    assert c.size <= 5000 and len(c.known) <= 25
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_mixing_equals_sql(spark, rows, tmp_path):
    docs = spark.createDataFrame([*rows, (3, "of other words", "en", "src0", 1), (3, "with other text", "en", "src0", 1)], brute.SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert ordered(mixing.query(spark, str(tmp_path)).collect()) == ordered(duck.sql(mixing.ORACLE).fetchall())


def test_mixing_meets_weights_and_moves_shortages(spark):
    docs = [(i, "w " * 10, "en", "src0", 0) for i in range(400)] + [(1000 + i, "w " * 10, "en", "src4", 0) for i in range(5)] + [(2000 + i, "w " * 10, "en", "src1", 0) for i in range(400)]
    df = spark.createDataFrame(docs, brute.SCHEMA)
    out = mixing.mix(df, weights={"domain": {"d0": 3.0, "d1": 1.0}}, share=0.5, epochs=2)
    taken = {r["source"]: r["t"] for r in out.groupBy("source").agg({"n_tokens": "sum", "copies": "sum"}).withColumnRenamed("sum(copies)", "t").collect()}
    assert taken["src4"] == 10  # both epochs, and its shortage goes to src0 of the same domain, not to src1
    assert taken["src0"] + taken["src4"] == pytest.approx(0.75 * 402.5, abs=2) and taken["src1"] == pytest.approx(0.25 * 402.5, abs=2)
    assert mixing.mix(df.limit(0)).count() == 0


def test_tiles_equal_brute_force():
    import numpy as np

    r = random.Random(3)
    for _ in range(300):
        kinds = r.choice([1, 2, 3, 6])
        a = [r.randrange(kinds) + 1 for _ in range(r.randrange(1, 50))]
        b = [r.randrange(kinds) + 1 for _ in range(r.randrange(1, 30))]
        assert decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3) == brute.tiling(a, b, 3)


def test_tiles_of_a_long_repetitive_text():
    import numpy as np

    text = np.full(1_000_000, 7, np.uint64)
    assert decontaminate.tiles(text, np.full(200, 7, np.uint64), 5) == 200
    a, q, n = decontaminate.runs(text, np.full(200, 7, np.uint64), 5)
    assert len(a) == 1_000_000 + 200 - 2 * 5 + 1  # a run for each diagonal, not a pair for each two places


def test_decontamination_equals_brute_force(spark, monkeypatch):
    """Ties, repeats, reordered passages, short items; items of one document in several rooms."""
    r = random.Random(8)
    words = lambda n, kinds: [f"v{r.randrange(kinds)}" for _ in range(n)]
    items = [(i, words(r.randrange(1, 25), 5)) for i in range(12)] + [(20, ["v1"] * 30), (21, ["v1"] * 30), (21, ["v2", "v2"])]
    texts = [(i, words(r.randrange(0, 60), 5)) for i in range(40)] + [(50, ["v1"] * 400)]
    texts += [(60, items[3][1][8:] + ["z"] + items[3][1][:8]), (61, items[4][1]), (61, items[4][1]), (None, items[5][1])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in [*items, items[0]]], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "AT_ONCE", 3)
    want = []
    for i, w in texts:
        best, n = (0.0, None), 0
        for item_id, v in items:
            k = min(5, len(v))
            if {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}:
                n += 1
                part = brute.tiling(w, v, k) / len(v)
                if part > best[0] or part == best[0] and item_id < best[1]:
                    best = (part, item_id)
        want.append((i, n, best[1], round(best[0], 9), best[0] >= 0.6))
    got = decontaminate.overlaps(docs, bench).select("doc_id", "n_items", "item_id", F.round("coverage", 9), "contaminated")
    assert ordered(got.collect()) == ordered(want)


def test_decontamination(spark):
    item = [f"q{i}" for i in range(20)]
    texts = [(0, "x " * 30 + " ".join(item)), (1, " ".join(item[10:] + ["m"] * 5 + item[:10])), (2, "x y z " * 40), (3, None), (4, ""), (5, " ".join(item[:6]) + " rest"),
             (None, " ".join(item).upper()), (6, " ".join(item[i] + ", z" if i % 3 == 0 else item[i] for i in range(20))), (7, "Short one.")]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in texts], "doc_id long, text string, coverage int, item_id string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (None, "a b"), (3, ""), (4, "short one"), (5, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_id"], r["coverage"]) for r in decontaminate.overlaps(docs, items).collect()}
    assert got[0] == got[1] == got[None] == (True, 1, 1.0)  # reordered halves too
    assert got[2] == got[3] == got[4] == got[6] == (False, None, 0.0)
    assert got[5][0] is False and got[5][2] == pytest.approx(0.3) and got[7] == (True, 4, 1.0)
    assert decontaminate.overlaps(docs, items.limit(0)).where("contaminated").count() == 0


PAGES = [
    (1, "http://www.a.example/x", "<html><body><header>Site</header><div class='promo box'>Buy</div><div id=x>Same words</div><div><p>One &amp; two<br>three<p>Four</div><footer>f</footer></body></html>"),
    (2, "http://a.example/y", "<html><body><div id=x>Same words</div><div><p>Other text</div><script>var x='</p>'</script></body></html>"),
    (3, "https://a.example:80/z", "<html><body><div id=x>Same words</div><div><p>Third text</div></body></html>"),
    (4, "http://u@a.example", "<html><body><div id=x>Same words</div><div><p>Fourth <b>bold</b>text</div></body></html>"),
    (5, "http://b.example", "<article><h1>T</h1><p>Body &lt;x&gt; &eacute;<ul><li>a<li>b</ul><div class=comments><p>me too</div></article><p>outside"),
    (6, None, None), (7, "nonsense", ""), (8, "http://b.example", "<p>unclosed <b>bold <!-- c"), (None, "http://b.example", "<nav>x</nav>"), (9, "http://b.example", "<div>" * 300 + "deep"),
]


def test_html(spark):
    df = spark.createDataFrame([(*p, "t", 1) for p in PAGES], "page_id long, url string, html string, text string, host int")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[1] == "One & two three\nFour" and got[2] == "Other text" and got[4] == "Fourth boldtext"
    assert got[5] == "T\nBody <x> é\na\nb" and got[6] == got[7] == got[None] == "" and got[8] == "unclosed bold" and got[9] == "deep"
    assert html_text.main_text(df.limit(0)).count() == 0


def test_html_articles_of_the_table(spark):
    import html

    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
        want[r["page_id"]] = "\n".join(x for x in parts if x)
    assert {r["page_id"]: r["text"] for r in html_text.query(spark, d).collect()} == want


def test_tree_matching():
    page = "page(html.(body.(div.a div.b p.)))"
    assert html_text.aligned(page, page).get(3) == 3
    assert html_text.aligned("page(html.(body.(div.b p.)))", page) == {0: 0, 1: 1, 2: 2, 3: 4, 4: 5}


def _html_texts(spark, bodies):
    rows = [(i, f"https://one.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return [r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_html_keeps_slots_that_some_pages_share(spark):
    """Half of the pages are one article with other lists, and a constant line differs on one page of twenty."""
    lead = ["the lead that two share", "the lead that two share", "a lead of its own", "another lead"]
    bodies = [f"<div><p>{x}</p></div><ul><li>list {i}</li></ul>" for i, x in enumerate(lead)]
    assert _html_texts(spark, bodies) == [f"{x}\nlist {i}" for i, x in enumerate(lead)]
    line = ["always the same"] * 19 + ["once not"]
    bodies = [f"<div><p>{x}</p></div><ul><li>list {i}</li></ul>" for i, x in enumerate(line)]
    assert _html_texts(spark, bodies) == [f"list {i}" for i in range(19)] + ["once not\nlist 19"]


def test_html_marks_never_take_the_article(spark):
    text = "a body of many words that is most of what the page says"
    for wrap in ("class='with-sidebar'", "class='has-comments no-sidebar'", "class='sidebar'", "id=comments", "class='tags-politics share-enabled'"):
        bodies = [f"<div {wrap}><article><p>{text}</p><div class='ad'>buy</div></article></div><p>out</p>", f"<article {wrap}><p>{text}</p></article>", f"<div {wrap}><p>{text}</p></div>"]
        for body in bodies:
            root, blocks = html_text.parse(body)
            assert any(x == text and not node.apart for node, x in blocks), body
            assert not any(x == "buy" and not node.apart for node, x in blocks)
    assert [x for node, x in html_text.parse("bare text at the root<div class='ad'>buy</div>")[1] if not node.apart] == ["bare text at the root"]
    inline = "x <math><mi>y</mi></math> <svg><text>z</text></svg> <object>o</object>"
    assert _html_texts(spark, [f"<article><p>{inline}</article>", "<article><p>a<select><option>b</article>", f"<article class=has-comments><p>{text}</article>"]) == [
        "x y z o", "ab", text
    ]


def test_html_of_pages_without_telling_names(spark):
    """Menus, adverts and comments' frames without names of their own go because they are constant; slots stay."""
    body = "<div><span>Home News Shop</span></div><div><p>{}</p><p>tail of it</p></div><ol><li>all rights kept</li></ol>"
    bodies = [body.format(f"what page {i} says of its own") for i in range(6)]
    assert _html_texts(spark, bodies) == [f"what page {i} says of its own\ntail of it" for i in range(6)]
    assert "Home News Shop" in _html_texts(spark, bodies[:1])[0]  # one page has nothing to be aligned with


def test_html_letters_that_grow_and_open_quotes(spark):
    page = "<article><p>İİİİİİİİ</p><SCRIPT>x('</p>')</script ><p>Hello world this is text</p></article>"
    assert _html_texts(spark, [page]) == ["İİİİİİİİ\nHello world this is text"]
    assert _html_texts(spark, ["<article><p>a<a href=\"x>b</a><p>c</article>"]) == ["ab\nc"]


def test_html_long_pages():
    import time

    page = lambda n: "page(html.(" + " ".join(["h2.", "p."] * n + ["ul.(li.(p.) b.)"]) + "))"
    begun = time.time()
    to = html_text.aligned(page(3000), page(3001))
    assert len(to) == 2 + 6000 + 4 and time.time() - begun < 5
    root, blocks = html_text.parse("<div>" * 100 + "deep" + "</div>" * 99 + "less")
    form, count = html_text.shape(root)
    assert count == html_text.DEPTH and {node.home.index for node, _ in blocks} == {count - 1, 1}


@pytest.mark.parametrize("extra", [
    "<div class='comments-area'><p>reader says hi there and more</div>", "<div id='post-comments'><p>me too</div>", "<div class='ad-slot'>buy this</div>", "<div class=\"cookie-banner x\">we use cookies</div>",
    "<section id='comments'><ol><li class='comment'><article class='comment'><p>me too, and at some length, so that it is longer than all else on the page</article></ol></section>",
    "<ul class='related-posts'><li><article><h2>Another teaser that is rather long, longer than the article</h2></article></ul>", "<div class='social_share'>tell all</div>",
])
def test_html_marks_by_parts_of_names(spark, extra):
    text = "the words of the article itself"
    states = "<body class='has-sidebar comments-open no-related'>"
    for page in (f"<article><p>{text}</p></article>{extra}", f"<div class='post comments-open'><article class='post has-comments'><p>{text}</p>{extra}</article></div>",
                 f"<main>{extra}<article><p>{text}</p></article></main>"):
        blocks = html_text.parse(f"<html>{states}{page}</body></html>")[1]
        marked = any(node.main for node, _ in blocks)
        assert [x for node, x in blocks if not node.apart and (node.main or not marked)] == [text], page


def planted_pages(seed=6):
    """Pages of three hosts without telling names: constant frames around an article of some paragraphs, optional blocks,
    lists of different lengths; what an article is is known."""
    import random

    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], {}
    for h in range(3):
        top, side, end = line(8), [line(3) for _ in range(5)], line(12)
        for i in range(40):
            body = [line(r.randrange(5, 30)) for _ in range(r.randrange(1, 6))]
            items = [line(3) for _ in range(r.randrange(0, 4))]
            extra = f"<blockquote>{line(4)}</blockquote>" if r.random() < 0.4 else ""
            quote = re.findall(r">(.*)<", extra)
            html = (f"<html><body><div><span>{top}</span></div><table><tr>{''.join(f'<td>{s}</td>' for s in side)}</tr></table><div><h1>{body[0]}</h1>"
                    f"{''.join(f'<p>{x}</p>' for x in body[1:])}{extra}<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></div><div><pre>{end}</pre></div></body></html>")
            pages.append((100 * h + i, f"https://h{h}.example/{i}", html))
            want[100 * h + i] = "\n".join([*body, *quote, *items])
    return pages, want


def test_html_induction_carries_the_result(spark):
    """With the hosts' other pages every article comes out alone; page by page, none does."""
    pages, want = planted_pages()
    texts = lambda rows: {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts(pages) == want
    alone = texts([(i, f"https://alone{i}.example/", h) for i, _, h in pages])
    assert all(alone[i] != t and set(t.split("\n")) <= set(alone[i].split("\n")) for i, t in want.items())
    twice = [*pages, *pages[:40]]
    assert texts(twice) == want


def test_html_hosts_of_few_pages(spark):
    pages, want = planted_pages()
    few = [p for p in pages if p[0] % 100 < html_text.LEAST_PAGES - 1]
    got = html_text.main_text(spark.createDataFrame(few, "page_id long, url string, html string")).collect()
    assert all(set(want[r["page_id"]].split("\n")) < set(r["text"].split("\n")) for r in got)
