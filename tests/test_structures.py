"""Contents, model chunking and stored collections against brute force, failures and repeats."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import chunking as K
from tessel.operators import contents as C
from tessel.sources import store as W

# --- contents from layout ---


def planted(seed, n):
    """Boxes of entries with planted levels and noise, and the entries."""
    rnd = random.Random(seed)
    boxes, want, stack = [], [], []
    level = 1
    for i in range(n):
        level = 1 if not i else rnd.randint(1, min(level + 1, 5))
        title, page = f"Title {i} of", i * 3 + 1
        x = 0.06 + 0.06 * (level - 1) + rnd.uniform(-0.008, 0.008)
        at, y = i // 12 + 1, (i % 12) * 0.07
        words = title.split() + (["....."] if i % 2 else []) + [str(page)]
        boxes += [(at, x + 0.09 * k, y + rnd.uniform(0, 0.004), w) for k, w in enumerate(words)]
        while stack and stack[-1][0] >= level:
            stack.pop()
        want.append((i, title, page, level, stack[-1][1] if stack else None, " > ".join([*(t for _, t in stack), title])))
        stack.append((level, title))
    rnd.shuffle(boxes)
    return boxes, want


def test_planted_indentations(spark):
    rows, want = [], []
    for doc in range(12):
        boxes, entries = planted(doc, 20 + doc * 5)
        levels = sorted({e[3] for e in entries})
        rows += [(doc, *b) for b in boxes]
        want += [(doc, *e[:3], levels.index(e[3]) + 1, *e[4:]) for e in entries]
    rows += [(None, 1, 0.1, 0.1, "Alone 4"), (99, 1, 0.1, 0.1, None), (99, 1, 0.1, 0.2, "no number"), (98, 9, 0.1, 0.1, "Late 7")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc long, page int, x double, y double, text string, title string").repartition(4)
    got = sorted((tuple(r) for r in C.contents_from_layout(df, "doc").collect()), key=str)
    assert got == sorted([*want, (None, 0, "Alone", 4, 1, None, "Alone")], key=str)
    assert sorted((tuple(r) for r in C.contents_from_layout(df.where("doc = 98"), "doc", pages=None).collect())) == [(98, 0, "Late", 7, 1, None, "Late")]
    assert C.contents_from_layout(df.limit(0), "doc").collect() == []


def test_lines_are_read_from_left_to_right(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.101, "9"), (1, 1, 0.1, 0.104, "Part"), (1, 1, 0.3, 0.1, "one"), (1, 1, 0.1, 0.2, "Next"), (1, 2, 0.1, 0.1, "Other")], "doc long, page int, x double, y double, text string")
    got = sorted((r["page"], r["line"], r["x"], r["text"]) for r in C.layout_lines(df, "doc").collect())
    assert got == [(1, 0, 0.1, "Part one 9"), (1, 1, 0.1, "Next"), (2, 0, 0.1, "Other")]


# --- trees ---


def tree(rnd, depth, name="t"):
    return [{"title": f"{name}{rnd.randrange(3)}", "level": rnd.randint(1, 4), "concepts": ["a"], "children": tree(rnd, depth - 1, name)} for _ in range(rnd.randint(1, 2))] if depth else []


def walked(items, above=""):
    out = []
    for x in items:
        path = f"{above} > {x['title']}" if above else x["title"]
        out += [(path, x["title"], x["level"]), *walked(x["children"], path)]
    return out


def test_trees_of_any_depth(spark):
    rnd = random.Random(1)
    trees = {d: tree(rnd, d % 11) for d in range(30)}
    deep = [{"title": "end", "level": 400, "children": []}]
    for k in reversed(range(300)):
        deep = [{"title": f"d{k}", "level": k + 1, "children": deep}]
    trees[30] = deep
    odd = [(40, None), (41, ""), (42, "{"), (43, '{"title": "x"}'), (44, '[1, null, {"level": "2"}]'), (45, "[]")]
    df = spark.createDataFrame([*((d, json.dumps(t)) for d, t in trees.items()), *odd], "doc long, tree string").repartition(3)
    said = spark.createDataFrame([(d, "t1", f"summary of {d}") for d in range(0, 30, 2)] + [(0, "t1", "a lesser one"), (1, "elsewhere", "x")], "doc long, title string, summary string")
    got = {}
    for r in C.summary_rows(df, "doc", "tree", said).orderBy("doc", "nth").collect():
        got.setdefault(r["doc"], []).append((r["section_path"], r["title"], r["level"], r["text"]))
    text = lambda d, t: t if t != "t1" or d % 2 or d >= 30 else "a lesser one" if d == 0 else f"summary of {d}"
    want = {d: [(p, t, n, text(d, t)) for p, t, n in walked(x)] for d, x in trees.items() if x}
    assert got == want | {44: [("", "", 1, "")]}


# --- volumes ---


def test_volumes_by_the_next_line(spark):
    toc = [("CP 1.42", 1), ("42. Ideas of order", 2), ("CP 2.42", 1), ("My philosophy of signs", 2), ("CP 3.42", 1), ("My philosophy again", 2), ("CP 5.7", 1), ("CP 6.7", 1), ("Seven things", 2), ("CP 8.9", 1), ("nine winds", 3), ("CP 4.77", 1)]
    contents = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(toc)], "idx long, title string, level int")
    asked = [(1, 42, "my PHILOSOPHY resuscitates"), (2, 42, "of order"), (3, 42, "a an"), (4, 7, "seven"), (5, 7, "cp 6"), (6, 9, "nine"), (7, 77, "none"), (8, 42, None), (9, None, "order")]
    lookups = spark.createDataFrame(asked, "lookup_id long, paragraph int, snippet string")

    def plain(paragraph, snippet):
        words = [w for w in (snippet or "").lower().split() if len(w) > 3]
        for (title, _), (said, level) in zip(toc, toc[1:], strict=False):
            if paragraph and title.endswith(f".{paragraph}") and level == 2 and words and words[0] in said.lower():
                return int(title[3])
        return None

    got = {r["lookup_id"]: r["volume"] for r in C.volume_of(lookups, contents, "CP").collect()}
    assert got == {i: plain(p, s) for i, p, s in asked}
    assert got[1] == 2 and got[2] == 1 and got[4] == 6 and got[6] is None


# --- model chunks ---

TEXT = "First line of words here.\nSecond line, 12 words.\n\nThird line ends.\nFourth."


def answer(*texts):
    return "<JSON>" + json.dumps({"chunks": [{"text": t, "summary": "s", "concepts": ["c"], "type": "argument"} for t in texts]}) + "</JSON>"


@pytest.mark.parametrize(
    ("said", "origin"),
    [
        (answer("First line of words here.\nSecond line, 12 words.", "Third line ends.\nFourth."), "model"),
        (answer("First line of words here.\nSecond line, 12 words.", "Third line ends."), "overlap"),  # text left out
        (answer("First line of words here.\nSecond line, 12 words.", "Second line, 12 words.\n\nThird line ends.\nFourth."), "overlap"),  # spans that overlap
        (answer("First line of other words.", "Third line ends.\nFourth."), "overlap"),  # not in the text
        (answer("Third line ends.\nFourth.", "First line of words here.\nSecond line, 12 words."), "overlap"),  # another order
        ("<JSON>{" + answer(TEXT)[7:40], "overlap"),
        ("no json", "overlap"),
        ('<JSON>{"chunks": [{"text": 3}, 4]}</JSON>', "overlap"),
        ('<JSON>[]</JSON>', "overlap"),
    ],
)
def test_answers_are_held_to_the_section(spark, said, origin):
    df = spark.createDataFrame([(1, TEXT, "S")], "id long, text string, title string")
    got = K.model_chunks(df, ["id"], "text", "title", lambda _: said, target=5).orderBy("chunk_no").collect()
    assert {r["origin"] for r in got} == {origin}
    assert "".join("".join(r["text"].split()) for r in got) == "".join(TEXT.split())
    for r in got:
        assert r["start"] is None or TEXT[r["start"] :].startswith(r["text"])


def test_failing_models_and_short_sections(spark):
    def fails(_):
        raise RuntimeError

    df = spark.createDataFrame([(1, TEXT, "S"), (2, "short one", "T"), (3, " ", "U"), (4, None, None), (5, "x" * 20_000 + " " + "y. " * 20, "V")], "id long, text string, title string")
    got = {}
    for r in K.model_chunks(df, ["id"], "text", "title", fails, target=5).collect():
        got.setdefault(r["id"], set()).add(r["origin"])
    assert got == {1: {"overlap"}, 2: {"short"}, 5: {"overlap"}}
    long = K.model_chunks(df.where("id = 5"), ["id"], "text", "title", lambda t: answer(t.strip()), target=5).collect()
    assert {r["origin"] for r in long} == {"overlap"}  # beyond the tokens a chunk may have


def test_no_text_is_lost(spark, small):
    from tessel.plans.structure_queries import model_chunking

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows, origins = {}, set()
    for r in model_chunking(spark, small).collect():
        rows.setdefault(r["doc_id"], []).append(r)
        origins.add(r["origin"])
    assert origins == {"model", "short", "overlap"}
    assert set(rows) == {d for d, t in texts.items() if t.strip()}
    for d, got in rows.items():
        if got[0]["origin"] != "overlap":
            covered = sorted((r["start"], r["n_chars"]) for r in got)
            kept = "".join(texts[d][a : a + n] for a, n in covered)
            assert "".join(kept.split()) == "".join(texts[d].split())


# --- stored collections ---


def store(spark, tmp_path):
    return W.Store(spark, f"file://{tmp_path}/store")


def test_rows_are_written_reread_and_refused(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.create("impact", "impact_id bigint, text string", "impact_id") and not s.create("impact", "other int")
    assert s.read("impact").collect() == []
    a = spark.createDataFrame([(1, "one"), (2, "two")], "impact_id long, text string")
    assert s.insert("impact", a) == 2
    for again in (a, a.where("impact_id = 2"), spark.createDataFrame([(3, "x"), (3, "y")], a.schema), spark.createDataFrame([(None, "x")], a.schema)):
        with pytest.raises(W.Conflict):
            s.insert("impact", again)
    with pytest.raises(ValueError):
        s.insert("impact", a.withColumn("more", F.lit(1)))
    assert s.insert("impact", spark.createDataFrame([(2, "again"), (3, "b"), (3, "a")], a.schema), existing="skip") == 3
    assert sorted(map(tuple, s.read("impact").collect())) == [(1, "one"), (2, "two"), (3, "a")]
    assert sorted(map(tuple, s.read("impact", 2).collect())) == [(1, "one"), (2, "two")]
    assert s.read("impact").where("impact_id = 3").head()["text"] == "a"
    s.insert("impact", spark.createDataFrame([(9,)], "impact_id int"))  # a lacking column is null
    assert s.read("impact").where("impact_id = 9").head()["text"] is None


def test_collections_are_made_verified_and_dropped(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.verify(["a", "b"]) == {"found": [], "missing": ["a", "b"], "unexpected": []}
    s.create("a", "x int")
    s.create("c", "x int")
    assert s.verify(["a", "b"]) == {"found": ["a"], "missing": ["b"], "unexpected": ["c"]}
    assert s.drop("c") and not s.drop("c")
    with pytest.raises(KeyError):
        s.read("c")


def test_writers_conflict_and_killed_writes_leave_no_trace(spark, tmp_path):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.create("t", "x int")
    one = spark.createDataFrame([(1,)], "x int")
    number, held = s._held("t")
    s.insert("t", one)
    with pytest.raises(W.Conflict):  # the other had read version 1 as well
        other._commit("t", number + 1, held | {"parts": [other._part("t", one)]})
    other._part("t", one)  # a writer killed before its version was made
    assert [r["x"] for r in s.read("t").collect()] == [1] and s.versions("t") == [1, 2]


def test_migrations_count_only_when_verified(spark, tmp_path):
    s = store(spark, tmp_path)
    s.create("t", "k bigint, text string", "k")
    s.insert("t", spark.createDataFrame([(i, f"text {i}") for i in range(50)], "k long, text string"))
    added = lambda df: df.withColumn("size", F.length("text"))
    for change, checks in ((lambda df: df.where("k < 40"), None), (lambda df: df.withColumn("k", F.col("k") + 1), None), (added, {"sizes": lambda _, new: new.where("size > 99").count() > 0})):
        with pytest.raises(ValueError, match="does not hold"):
            s.migrate("t", change, checks)
        assert s.read("t").columns == ["k", "text"] and s.versions("t") == [1, 2]

    def killed(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        s.migrate("t", killed)
    assert s.migrate("t", added, {"sizes": lambda _, new: new.where("size < 6").isEmpty()}) == 3
    assert s.read("t").agg(F.sum("size")).head()[0] == sum(len(f"text {i}") for i in range(50))
    s.insert("t", spark.createDataFrame([(50, "new")], "k long, text string"))  # a test insertion
    assert s.read("t").count() == 51 and s.read("t", 2).columns == ["k", "text"]


def test_occasions_are_logged_once(spark, tmp_path):
    s = store(spark, tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "occasion_id long, reply string")
    W.log_occasions(s, rows)
    W.log_occasions(s, rows.unionByName(spark.createDataFrame([(3, "c")], rows.schema)))
    got = sorted(map(tuple, s.read("occasions").collect()))
    assert [g[1] for g in got] == ["occasion_000001.json", "occasion_000002.json", "occasion_000003.json"]
    assert [json.loads(g[2]) for g in got] == [{"occasion_id": 1, "reply": "a"}, {"occasion_id": 2, "reply": "b"}, {"occasion_id": 3, "reply": "c"}]


def test_artefacts_hold_every_chunk(spark):
    docs = spark.createDataFrame([(1, "t"), (2, "u")], "doc long, title string")
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "doc long, chunk_no int, chunk string")
    got = {r["doc"]: (r["file"], json.loads(r["value"])) for r in W.chunk_artefacts(docs, chunks, "doc").collect()}
    assert got[1][1]["chunks"] == [{"chunk_no": 0, "chunk": "a"}, {"chunk_no": 1, "chunk": "b"}] and got[2][1]["chunks"] == []
    assert got[1][0] == "1_chunks.json"


def test_echoes(spark):
    got = [r["echo"] for r in W.echoed(spark.createDataFrame([("x" * 100,), ("y" * 101,), (None,)], "t string"), "t").collect()]
    assert got == ["x" * 100, "y" * 100 + "...", None]
