"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from tessel.llm.decontamination import contaminated
from tessel.llm.neardup import near_duplicates
from tessel.llm.packing import pack, tokenizer_path
from tessel.llm.pii import personal_data
from tessel.llm.quality_classifier import quality
from tessel.llm.quality_rules import quality_rules
from tessel.llm.secrets import scan
from tessel.llm.sharding import shard
from tessel.llm.templates import extract
from tessel.llm.toxicity import toxicity

CLASH = "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean, component_id string, words int, size string, vslot int, rank int, part string, path string, th int, h string, score string, shard int, piece int, features string, votes int, n_words string, window int, k1 string, held_out string"


def _rows():
    rnd = random.Random(3)
    prose = lambda n: " ".join(rnd.choice("alpha beta gamma delta omega sigma lambda kappa".split()) + str(rnd.randrange(50)) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "two words", prose(40), prose(40), prose(30_000), "É ß “quoted” 漢字   nb", "x" * 5000]
    texts += [texts[5], texts[5]]  # ties under other ids
    out = [(i, t, "en" if i % 2 else None, None if i % 3 else "src0") for i, t in enumerate(texts)]
    out += [out[5], out[6]]  # repeated rows
    out.append((None, texts[5], None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    n = len(CLASH.split(",")) - 4
    return spark.createDataFrame([(*r, *[None] * n) for r in _rows()], CLASH).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, _rows()[5][1]), (2, "one"), (3, None), (4, ""), (1, _rows()[5][1])]
    return spark.createDataFrame([(*r, None) for r in rows], "item_id long, text string, words string")


def run(name, docs, labels, items):
    return {
        "rules": lambda: quality_rules(docs),
        "pii": lambda: personal_data(docs),
        "quality": lambda: quality(docs),
        "shard": lambda: shard(docs),
        "near": lambda: near_duplicates(docs),
        "leaks": lambda: contaminated(docs, items),
        "secrets": lambda: scan(docs),
        "toxicity": lambda: toxicity(docs, labels),
        "pack": lambda: pack(docs, tokenizer_path()),
    }[name]().collect()


PER_ROW = ("rules", "pii", "quality", "shard", "near", "toxicity")


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(name, docs, labels, items):
    assert len(run(name, docs, labels, items)) == len(_rows())


@pytest.mark.parametrize("name", [*PER_ROW, "leaks", "secrets", "pack"])
def test_empty_table(name, docs, labels, items):
    assert run(name, docs.limit(0), labels, items) == []


def test_no_labels(docs, labels):
    got = toxicity(docs, labels.limit(0)).collect()
    assert {r["score"] for r in got} == {0.5}


def test_near_duplicates_of_edges(docs):
    got = {}
    for r in near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[0] == got[1][:0] + [(0, 0, True)] and got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)]
    assert got[3] == [(1, 3, True)]
    assert got[5] == [(36, 5, True)] * 2 and got[10] == [(36, 5, False)] and got[None][0][:2] == (36, 5)


def test_shards_are_gapless(docs):
    got = shard(docs).collect()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_contamination_of_edges(docs, items):
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert got == {(5, 1), (10, 1), (11, 1), (None, 1), (3, 2)}
    assert contaminated(docs, items.limit(0)).collect() == []


def test_packing_of_edges(docs):
    got = pack(docs, tokenizer_path()).collect()
    assert sum(r["length"] == 1 for r in got) >= 3  # null, empty and blank texts
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_pages_of_edges(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://h.org/a", "<p>One &amp; <b>two<p>three</b>"), (3, "http://h.org/a", "<p>One &amp; <b>two<p>three</b>"), (4, "http://h.org/b", "plain text only"), (5, "http://H.org/c", "<div class='ad'>buy</div><article><h1>T</h1><p>x\n y<br>z</p><aside>no</aside></article><footer>f</footer>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "One & two\n\nthree", 16), (3, "One & two\n\nthree", 16), (4, "plain text only", 15), (5, "T\n\nx y z", 8)]
    assert extract(pages.limit(0)).collect() == []
    assert extract(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_articles_own_header(spark):
    page = "<header>Site</header><article><header><h1>Title</h1></header><div class='entry-header'>By line</div><p>Text</p><div class='share-box'>Share</div></article><div class='cookie-notice'>Cookies</div>"
    pages = spark.createDataFrame([(1, "http://q.org/", page)], "page_id long, url string, html string")
    assert extract(pages).head()["text"] == "Title\n\nBy line\n\nText"


def test_lost_columns(spark):
    docs = spark.createDataFrame([(1, "some words here and there")], "doc_id long, text string")
    assert quality_rules(docs).select("kept", F.lit(1)).count() == 1
    assert scan(docs).count() == 0
