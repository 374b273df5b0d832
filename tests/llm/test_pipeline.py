"""The pipeline against its operators, stage by stage."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, small), name)
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns)
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] >= 0.7 * sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[-1]


def test_edges(spark, small):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "same words in a row here", "en", "s", 24), (4, "same words in a row here", "en", "s", 24), (4, "same words in a row here", "en", "s", 24), (None, "quite another text of words", "en", "s", 27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).collect() == []


def test_rows_without_ids_and_repeated_ids(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key string, ROW_KEY int"
    item = spark.read.parquet(f"{small}/benchmark.parquet").where("length(text) > 150").head()["text"]
    toxic = spark.read.parquet(f"{small}/documents.parquet").join(spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1"), "doc_id")
    scored = corpus_pipeline.toxicity(toxic, spark.read.parquet(f"{small}/labels.parquet"))
    bad = toxic.join(scored.where("predicted = 1"), "doc_id").head()["text"]
    key = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
    clean = ["first words about rivers and hills", "second words on ships and seas", "third words of towns and roads"]
    rows = [(None, t) for t in clean] + [(5, "one text under five, of trees"), (5, "other text under five, of birds"), (None, bad), (6, bad), (None, f"so it is {item} and so on"), (5, f'a token = "{key}" here'), (None, f'a token = "{key}" here')]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), None, None) for i, t in rows], schema)
    texts = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    every = sorted((str(i), t) for i, t in rows)
    stages = dict(corpus_pipeline.STAGES)
    real = spark.read.parquet(f"{small}/documents.parquet")
    more = real.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6).select(*real.columns))
    left = [t for _, t in texts(stages["toxicity"](spark, more, small).where("doc_id is null or doc_id > 900000"))]
    assert bad not in left and set(clean) <= set(left)
    left = texts(stages["near_duplicates"](spark, docs, small))
    assert len(left) == len(rows) - 2 and {t for _, t in left} == {t for _, t in rows} and ("6", bad) in left
    assert texts(stages["decontamination"](spark, docs, small)) == [x for x in every if item not in x[1]]
    out = stages["secrets"](spark, docs, small)
    assert texts(out) == sorted((i, t.replace(key, "[SECRET]")) for i, t in every) and out.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_run_deletes_what_it_no_longer_needs(spark, small):
    from tessel.llm.common import tables_written

    before = tables_written()
    assert corpus_pipeline.run(spark, small).count() > 0
    assert tables_written() == before + 1
