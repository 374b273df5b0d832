"""What a query holds, shuffles or writes as its tables grow."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F


def test_waiting_triggers_hold_no_context(spark, small):
    """a trigger waits as its stored vector and four numbers, not as the vectors that retrieval found."""
    from tessel.plans import cycle_queries as Q
    from tessel.streaming.cycles import _opened, _packed

    rows = Q._triggers(spark, small, spark.read.parquet(f"{small}/events.parquet"), Q._settings(spark, small))
    assert "context" not in rows.columns and dict(rows.dtypes)["e"] == "array<float>"
    r = rows.where("found IS NOT NULL").head()
    held = _packed(r["kind"], np.array(r["e"], np.float32), np.array(r["found"]))
    assert len(held) < 400
    kind, e, found = _opened(held)
    assert (kind, e.tolist(), list(found)) == (r["kind"], r["e"], r["found"])


def test_courses_shuffle_no_context(spark):
    """what the fold sorts holds no context, and gives what a context gave."""
    from tessel.operators.cycle import Settings, cycles, summarised, unit

    m = unit(np.random.default_rng(1).normal(size=(12, 4)))
    s = Settings(start=m[:8], reference=m[4:], articles=m[8:10], anchors=m[10:])
    rows = [(1, float(i), i, "corpus", m[i % 12].tolist(), m[: i % 4].tolist() or None) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, at double, nth long, kind string, e array<double>, context array<array<double>>")
    plan = cycles(df, s)._jdf.queryExecution().optimizedPlan()
    assert not any("context" in str(p.output()) for p in (plan.children().head(), plan.children().head().children().head()))
    assert sorted(cycles(df, s).collect()) == sorted(cycles(summarised(df, s), s).collect())


def test_stamps_of_far_years(spark):
    """years of five digits have no sign."""
    from tessel.operators.rendering import stamp

    rows = spark.createDataFrame([(None,), (0,), (1_700_000_000,), (260_000_000_000,)], "s long")
    assert [r[0] for r in rows.select(stamp(F.col("s"))).collect()] == ["—", "—", "14 11 2023 à 22:13", "27 01 10209 à 06:13"]
    assert dt.datetime.fromtimestamp(1_700_000_000, dt.UTC).year == 2023


def test_contents_match_by_distinct_places(spark):
    """F8: the windows hold distinct places, none looks ahead, and places that are missing or equally near decide as in SQL."""
    from tessel.operators.segment import match_toc

    toc = spark.createDataFrame([(0, "a", 0, 1, 40), (1, "b", 2, 1, 10), (2, "c", 4, 1, 20), (3, "d", 6, 1, 20), (4, "e", 8, 1, None)], "idx long, title string, number long, level long, place long")
    places = [None, -5, 10, 14, 15, 16, 20, 29, 30, 31, 99] * 40
    chunks = spark.createDataFrame([(i, "x", 1, p) for i, p in enumerate(places)], "chunk_id long, title string, number long, place long")
    out = match_toc(chunks, toc)
    want = [0 if p is None else min((abs(p - q), i) for i, q in ((0, 40), (1, 10), (2, 20), (3, 20)))[1] for p in places]
    assert [r["idx"] for r in out.orderBy("chunk_id").collect()] == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.replace(" ", "").lower()


def test_providers_see_few_texts_at_a_time(spark, monkeypatch):
    """texts leave an Arrow batch by the provider's batches, and their vectors are sent on at once."""
    from tessel.plans.providers import embedded, hashed_bag

    run = _python(monkeypatch, lambda: embedded(spark.range(3).select(F.concat(F.lit("w "), "id").alias("text"))))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([f"w {i}" for i in range(300)]), pa.array(["k"] * 300), pa.array([1] * 300, pa.int32())], names=["_text", "_key", "_n"])
    parts = list(run(iter([batch])))
    assert max(p.num_rows for p in parts) <= 48 and sum(p.num_rows for p in parts) == 300
    assert np.allclose([v for p in parts for v in p.column(2).to_pylist()], hashed_bag([f"w {i}" for i in range(300)]))


def test_chunks_are_sent_on_some_sections_at_a_time(spark, monkeypatch):
    """a task never holds the chunks of a whole Arrow batch."""
    import pyarrow as pa

    from tessel.operators.chunking import model_chunks, paragraph_answer

    df = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("t").alias("title"))
    run = _python(monkeypatch, lambda: model_chunks(df, ["doc_id"], "text", "title", paragraph_answer))
    batch = pa.RecordBatch.from_arrays([pa.array(range(950)), pa.array(["a b"] * 950), pa.array(["t"] * 950)], names=["doc_id", "_text", "_title"])
    parts = list(run(iter([batch])))
    assert len(parts) >= 9 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(950))


def _python(monkeypatch, make):
    """The function that make() gives to mapInArrow."""
    from pyspark.sql import DataFrame
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    seen, before = [], Classic.mapInArrow

    def held(self: DataFrame, f, *more, **named):
        seen.append(f)
        return before(self, f, *more, **named)

    monkeypatch.setattr(Classic, "mapInArrow", held)
    make()
    return seen[-1]
