"""Operators on literal inputs: ties, nulls, empty tables, parameters."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.functions import vector as V
from tessel.operators import catalog as C
from tessel.operators import search as S
from tessel.operators import segment as G
from tessel.operators import state as X
from tessel.plans import providers as P
from tessel.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).head()["v"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"a{i % 3}", [math.cos(i / 7), math.sin(i / 7)], f"P {i % 2} > s{i}") for i in range(30)] + [(99, "zero", [0.0, 0.0], "P 0")]
    return spark.createDataFrame(data, "id long, author string, vector array<double>, section_path string")


def test_knn_orders_ties_by_id(rows):
    twice = rows.union(rows.withColumn("id", F.col("id") + 100))
    assert [r["id"] for r in S.knn(twice, [1.0, 0.0], 3).collect()] == [0, 100, 1]
    assert S.knn(rows, [0.0, 0.0], 2).select("similarity").distinct().collect() == [(0.0,)]
    assert S.knn(rows.limit(0), [1.0, 0.0], 3).collect() == []


def test_threshold_never_widens(rows):
    assert S.at_least(S.knn(rows, [1.0, 0.0], 5), 0.99).count() <= 5


def test_filters(rows):
    assert rows.where(S.equal_filters(author=None, id=[])).count() == 31
    assert rows.where(S.equal_filters(author=["a0", "a1"])).count() == 20


def test_diverse_quota(rows):
    got = S.diverse(rows, [1.0, 0.0], 30, 3, 2, 9).collect()
    assert len(got) == 9 and {r["author"] for r in got} == {"a0", "a1", "a2"}
    assert len(S.diverse(rows, [1.0, 0.0], 30, 1, 2, 9).collect()) == 9


def test_batch_forms_agree(rows):
    q = rows.where("id < 4").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    a = {(r["query_id"], r["rank"]): round(r["similarity"], 6) for r in S.batch_knn(rows, q, 3).collect()}
    assert a == {(r["query_id"], r["rank"]): round(r["similarity"], 6) for r in S.batch_knn_blocked(rows, q, 3).collect()}


def test_index_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    m = centres[rng.integers(0, 20, 2000)] + 0.2 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    index = S.HyperplaneIndex(16, bits=5, tables=8)
    built = index.build(df).cache()
    hit = 0
    for q in m[::400]:
        true = {r["id"] for r in S.knn(df, q.tolist(), 10).collect()}
        hit += len(true & {r["id"] for r in index.search(built, q, 10).collect()})
    assert hit >= 0.9 * 10 * len(m[::400])


@pytest.mark.parametrize(("answer", "kept"), [("ALL", 5), ("none", 0), ("1, 3, 4", 3), ("2", 5), ("what", 5), ("", 5), ("[1,2,9]", 5)])
def test_rerank(spark, answer, kept):
    hits = spark.range(1, 6).withColumnRenamed("id", "position")
    assert S.rerank(hits, answer).count() == kept


def test_pairwise_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        S.pairwise_l2(spark.range(20).select("id", F.array(F.lit(1.0)).alias("vector")), most=10)


def test_pairwise_blocks_take_any_table(spark, tmp_path):
    from tessel.queries import QUERIES

    n = 5100
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.lit(3).alias("label"), F.array(F.col("id").cast("float")).alias("embedding"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["pairwise_distances"](spark, str(tmp_path)).where("distance = b_id - a_id").count() == n * (n - 1) // 2


def test_tensor_recursion_takes_every_vector(spark, small):
    from tessel.queries import QUERIES

    v = [np.array(r["embedding"], float) for r in spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()]
    assert len(v) > 108
    state, rates = v[:8], (0.1, 0.2, 0.3, 0.2, 0.1, 0.1, 0.05, 0.05)
    for e in v[8:]:
        state = [s + r * 0.001 * (e - s) for s, r in zip(state, rates, strict=True)]
        state = [s / np.linalg.norm(s) for s in state]
    got = {r["dim"]: r["first"] for r in QUERIES["tensor_recursion"](spark, small).collect()}
    assert all(abs(got[i] - s[0]) < 1e-8 for i, s in enumerate(state))


def test_consistency_without_evidence(rows):
    assert S.consistency({"x": rows.limit(0)}, [1.0, 0.0]).head().asDict() == {"evidence": 0, "score": 1.0, "label": "consistent"}


def test_evidence_is_the_nearest_of_all_sources(rows):
    sources = {"b": rows, "a": rows}
    got = [(r["type"], r["id"]) for r in S.consistency_evidence(sources, [1.0, 0.0], k=2, shown=3).collect()]
    assert got == [("a", 0), ("b", 0), ("a", 1)]
    assert S.consistency_evidence({"x": rows.limit(0)}, [1.0, 0.0]).collect() == []


@pytest.fixture(scope="module")
def library(spark):
    """Nested sections of three works; one without a text, one without text and title, one of no known work."""
    turn = lambda a: [math.cos(a), math.sin(a)]
    sections = [("W1", "one", "left", "t", turn(0.1)), ("W1 > A", "one", "", "up", turn(0.2)), ("W2", "two", None, None, turn(0.3)), ("W3", "none", "up", "t", turn(0.0)), ("W4", None, "up", "t", turn(0.05))]
    chunks = [(i, f"W{1 + i % 4}" + (" > A" if i % 8 == 0 else ""), ("one", "two", "none", None)[i % 4], f"author {i % 2}", turn(i / 5)) for i in range(80)]
    return (
        spark.createDataFrame(sections, "path string, work_title string, text string, title string, vector array<double>"),
        spark.createDataFrame(chunks, "id long, section_path string, work_title string, author string, vector array<double>"),
        spark.createDataFrame([("one", "author 0"), ("one", "author 0"), ("two", "author 1"), ("", "author 0")], "title string, author string"),
        sections, chunks,
    )


SPOKEN = {"left": [-1.0, 0.0], "up": [0.0, 1.0]}


def speak(texts):
    return np.array([SPOKEN.get(t, [1.0, 1.0]) for t in texts])


@pytest.mark.parametrize("author, work", [(None, None), (None, "one"), ("author 0", None), ("author 1", "two"), ("author 1", "one"), ("nobody", None)])
def test_sections_probed_with_their_texts_against_brute_force(library, author, work):
    sections, chunks, works, s_rows, c_rows = library
    query, limit = [1.0, 0.0], 10
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    near = sorted(s_rows, key=lambda s: (-cos(s[4], query), s[0]))[:4]
    if author or work:
        titles = {t for t, a in (("one", "author 0"), ("two", "author 1")) if work in (None, t) and author in (None, a)}
        near = [s for s in near if s[1] in titles]
    want = []
    for path, _, text, title, _ in near:
        probe = SPOKEN[text] if text else SPOKEN[title] if title else query
        mine = [(cos(c[4], probe), c[0]) for c in c_rows if c[1].startswith(path) and work in (None, c[2]) and author in (None, c[3])]
        want += [(-round(x, 9), path, i) for x, i in sorted(mine, key=lambda p: (-p[0], p[1]))[: max(3, limit // len(near))]]
    got = S.hierarchical(sections, chunks, query, 4, limit, works, author, work, embed=lambda df, text, name: P.embedded(df, text, speak, name=name)).collect()
    assert sorted((-round(r["similarity"], 9), r["path"], r["id"]) for r in got) == sorted(want)
    assert [r["similarity"] for r in got] == sorted((r["similarity"] for r in got), reverse=True)


def test_filters_need_works(library):
    with pytest.raises(ValueError):
        S.hierarchical(*library[:2], [1.0, 0.0], 4, 10, author="author 0")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.norm(a), V.cosine(a, b), V.normalised(a), V.normalised(b), V.clamped(a, 1.0), V.l2(a, b), V.flattened(F.array(a, b)), V.stacked(F.flatten(F.array(a, b)), 2)).head()
    assert list(got) == [5.0, 0.0, [0.6, 0.8], [0.0, 0.0], [0.6000000000000001, 0.8], 5.0, [3.0, 4.0, 0.0, 0.0], [[3.0, 4.0], [0.0, 0.0]]]


def test_drift_of_one_state(spark):
    t = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "state_id long, dim int, v array<double>")
    assert X.drift(t).head()["cumulative"] == 0.0


def test_dissonance_of_context_free_event(spark):
    t = spark.createDataFrame([], "vector array<double>")
    row = X.enhanced_dissonance(F.lit(0.2), t, F.array(F.lit(1.0))).head()
    assert row["novelty"] == 1.0 and abs(row["total"] - 0.3) < 1e-9


def test_pages(spark):
    df = spark.range(10)
    assert [r["id"] for r in C.page(df, ["id"], 3, 8).collect()] == [8, 9]
    assert C.page(df, ["id"], 3, 8).head()["total_count"] == 10
    assert [r["id"] for r in C.after(df, "id", 7, 5).collect()] == [8, 9]


def test_deletion_needs_confirmation(spark):
    with pytest.raises(ValueError):
        C.delete_cascade({"a": spark.range(3)}, "id", spark.range(1))


def test_insert_and_update(spark):
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "k long, v string")
    assert {(r["k"], r["v"]) for r in C.insert_absent(have, new, "k").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {(r["k"], r["v"]) for r in C.updated(have, new.where("k = 2"), "k").collect()} == {(1, "a"), (2, "x")}


def test_work_counts(spark):
    df = spark.createDataFrame([(1, "B", "y"), (2, "B", "z"), (3, "a", None), (4, " ", "q"), (5, None, "q")], "id long, work_title string, author string")
    assert [tuple(r) for r in C.work_counts(df).collect()] == [("a", 1, "Unknown"), ("B", 2, "y")]


@pytest.mark.parametrize(("text", "n"), [("XIV", 14), ("mcmxc", 1990), ("", 0), ("IIX?", 10)])
def test_roman(spark, text, n):
    assert one(spark, T.roman(F.col("t")), t=text) == n


@pytest.mark.parametrize(("text", "want"), [("x <JSON>\n{\"a\": 1}\n</JSON>", '{"a": 1}'), ("pre {\"a\": {\"b\": 2}} post", '{"a": {"b": 2}}'), ("nothing", None)])
def test_json_block(spark, text, want):
    assert one(spark, T.json_block(F.col("t")), t=text) == want


def test_ocr_cleaning(spark):
    t = "<!-- Page 3 -->\n# T\n12\nab\nA full   line\n\n\n\nnext line here\n"
    assert one(spark, T.clean_chunk(F.col("t")), t=t) == "# T\nA full line\n\nnext line here"


def test_router(spark):
    asked = ["justice", "vertu et bien", "free will", "what is the nature of signs"]
    assert [one(spark, T.needs_hierarchy(F.col("t")), t=a) for a in asked] == [False, True, True, True]


def test_paragraph_chunks():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (60, 60, 20))
    assert [len(c.split()) for c in G.paragraph_chunks(text, 100, 30)] == [60, 80]
    assert G.paragraph_chunks("short", 100, 30) == ["short"] and G.paragraph_chunks(None) == []
    long = "one two three. " * 60
    assert all(len(c.split()) <= 100 for c in G.paragraph_chunks(long, 100, 10))


def test_overlap_chunks():
    text = " ".join(f"Sentence number {i} ends." for i in range(40))
    got = G.overlap_chunks(text, 40, 5, 8)
    assert all(b.split(". ")[0] in a for a, b in zip(got, got[1:], strict=False))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab .,\n", max_size=300))
def test_spoken_chunks_keep_all_words(text):
    assert " ".join(G.spoken_chunks(text, 8, 2)).split() == text.split()


def test_heading_paths(spark):
    text = "pre\n# A\n## B\nx\n#### D\n## C\n# E\n### F"
    df = spark.createDataFrame([(1, text)], "k long, t string")
    s = G.heading_sections(df, "k", "t")
    assert s.where("section = 0").head()["content"] == "pre"
    got = G.with_paths(s.where("level > 0"), "k", "section").orderBy("section").collect()
    assert [r["path"] for r in got] == ["A", "A > B", "A > B > D", "A > C", "E", "E > F"]
    assert [r["number"] for r in got] == ["1", "1.1", "1.1.1", "1.2", "2", "2.1"]


def test_section_numbers_of_whole_texts(spark, small):
    from tessel.queries import QUERIES

    texts = spark.read.parquet(f"{small}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    assert any(r["text"][3000:].count("\n") > 3 for r in texts)
    want = {r["doc_id"]: (r["text"].count("\n") + 2) // 3 for r in texts if "\n" in r["text"]}
    got = QUERIES["section_numbers"](spark, small).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == want


def test_providers(spark):
    df = spark.createDataFrame([(1, "not here"), (2, "here"), (3, None), (4, "here")], "id long, text string")
    v = {r["id"]: r["vector"] for r in P.embedded(df).collect()}
    assert v[2] == v[4] and len(v[1]) == 64 and set(v) == {1, 2, 3, 4}
    assert P.contradiction_scores(df.withColumn("b", F.lit("here")), "text", "b").where("id = 1").head()["nli"] == 0.9

    def fails(prompt):
        raise RuntimeError

    assert {r["answer"] for r in P.answered(df, "text", fails).collect()} == {None}


def test_word_files(tmp_path, spark):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = files.word(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["style"], r["text"], r["level"]) for r in got] == [("Heading 2", "Title", 2), ("Normal", "Body", None)]


def test_sources_and_copies(tmp_path, spark):
    (tmp_path / "m.md").write_text("# A\ntext\n# B\n")
    assert files.markdown(spark, str(tmp_path / "m.md")).head()["pages"] == 2
    (tmp_path / "c.csv").write_text("i,x\n0,1.5\n")
    assert files.csv(spark, str(tmp_path / "c.csv"), "i int, x double").head()["x"] == 1.5
    df = spark.createDataFrame([("7", "2024-01-02 03:04:05 x"), ("n", "y")], "n string, t string")
    assert files.migrate(df, str(tmp_path / "out"), ["n"]) == 2
    assert files.repaired_dates(df).head()["t"] == "2024-01-02T03:04:05 x"
    files.export_json({"a": df}, str(tmp_path / "bak"))
    assert files.restore_json(spark, str(tmp_path / "bak"), dry_run=True) == {"a": 2}


def test_plans_push_down(spark, small):
    from tessel.sources.tables import read

    plan = read(spark, small, "documents").where("doc_id = 17").select("doc_id", "lang")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,17)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    ranked = S.batch_knn(*(lambda v: (v, v.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")).limit(5)))(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")), 1)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().toString()


def test_timeline_takes_each_sources_nearest(spark):
    """A source with all the nearest rows leaves the other's place, and age alone orders."""
    import datetime as dt

    from tessel.operators.search import timeline

    day = lambda n: dt.datetime(2024, 1, n)
    schema = "id long, ts timestamp, content string, vector array<double>"
    near = spark.createDataFrame([(i, day(10 + i), "a", [1.0, 0.001 * i]) for i in range(6)], schema)
    old = spark.createDataFrame([(100, day(1), "b", [1.0, 1.0]), (101, day(2), "b", [0.0, 1.0])], schema)
    got = timeline({"near": near, "old": old}, [1.0, 0.0], 2).collect()
    assert [(r["type"], r["id"]) for r in got] == [("old", 100), ("near", 0)]
