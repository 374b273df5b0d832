"""Queries over stored vectors and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions import vector as V
from tessel.operators import search as S
from tessel.plans.providers import embedded, hashed_bag
from tessel.sources.tables import CHUNKS_SQL, chunks, read, stored, vectors

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = "list_inner_product(vector, q) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(q, q)))"


def _first(spark, d):
    return S.stored_vector(vectors(spark, d), "id", 0)


@query(f"SELECT id, language, work_title, round({_COS} * 100, 1) AS similarity_pct FROM {CHUNKS_SQL}, {_Q0} WHERE language = 'en' ORDER BY {_COS} DESC, id LIMIT 10")
def knn_simple(spark, d):
    hits = S.knn(chunks(spark, d), _first(spark, d), 10, S.equal_filters(language="en", author=None))
    return hits.select("id", "language", "work_title", F.round(F.col("similarity") * 100, 1).alias("similarity_pct"))


@query(f"SELECT id, section_path, round(s, 4) AS similarity FROM (SELECT id, section_path, {_COS} AS s FROM {CHUNKS_SQL}, {_Q0} ORDER BY s DESC, id LIMIT 40) WHERE s >= 0.2")
def knn_threshold(spark, d):
    hits = S.at_least(S.knn(chunks(spark, d), _first(spark, d), 40), 0.2)
    return hits.select("id", "section_path", F.round("similarity", 4).alias("similarity"))


@query(f"SELECT id, level, round(s, 6) AS similarity FROM (SELECT id, label % 5 + 1 AS level, {_COS} AS s FROM {CHUNKS_SQL}, {_Q0}) WHERE level BETWEEN 2 AND 3 ORDER BY s DESC, id LIMIT 15")
def knn_summaries_by_level(spark, d):
    rows = chunks(spark, d).withColumn("level", F.col("label") % 5 + 1)
    return S.knn(rows, _first(spark, d), 15, F.col("level").between(2, 3)).select("id", "level", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH c AS {CHUNKS_SQL}, m AS (SELECT 'Part ' || label AS path, list(x ORDER BY pos) AS vector FROM (
 SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM c) GROUP BY ALL) GROUP BY label),
 top AS (SELECT path, vector AS sv, {_COS} AS ss FROM m, {_Q0} ORDER BY ss DESC, path LIMIT 4),
 r AS (SELECT path, ss, id, list_inner_product(vector, sv) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(sv, sv))) AS s FROM c JOIN top ON starts_with(section_path, path)),
 k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s DESC, id) AS rn FROM r)
 SELECT path, round(ss, 6) AS section_similarity, id, round(s, 6) AS similarity FROM k WHERE rn <= greatest(3, 20 // (SELECT count(*) FROM top))""")
def hierarchical_search(spark, d):
    c = chunks(spark, d)
    sections = V.mean_by(c.withColumn("path", F.concat(F.lit("Part "), F.col("label"))), ["path"], "vector")
    out = S.hierarchical(sections, c, _first(spark, d), 4, 20)
    return out.select("path", F.round("section_similarity", 6).alias("section_similarity"), "id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH c AS {CHUNKS_SQL}, m AS (SELECT path, work_title, list(x ORDER BY pos) AS vector FROM (
 SELECT path, work_title, pos, avg(x) AS x FROM (SELECT section_path AS path, work_title, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM c) GROUP BY ALL) GROUP BY ALL),
 top AS (SELECT path, work_title, vector AS sv, {_COS} AS ss FROM m, {_Q0} ORDER BY ss DESC, path LIMIT 100),
 kept AS (SELECT * FROM top WHERE work_title IN (SELECT source FROM documents WHERE source = 'src1')),
 r AS (SELECT path, ss, id, list_inner_product(vector, sv) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(sv, sv))) AS s FROM c JOIN kept ON starts_with(section_path, path) WHERE c.work_title = 'src1'),
 k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s DESC, id) AS rn FROM r)
 SELECT path, round(ss, 6) AS section_similarity, id, round(s, 6) AS similarity FROM k WHERE rn <= greatest(3, 20 // nullif((SELECT count(*) FROM kept), 0))""")
def hierarchical_of_work(spark, d):
    c = chunks(spark, d)
    sections = V.mean_by(c.withColumn("path", F.col("section_path")), ["path", "work_title"], "vector")
    works = read(spark, d, "documents").select(F.col("source").alias("title"))
    out = S.hierarchical(sections, c, _first(spark, d), 100, 20, works, work="src1")
    return out.select("path", F.round("section_similarity", 6).alias("section_similarity"), "id", F.round("similarity", 6).alias("similarity"))


@query()
def hierarchical_by_text(spark, d):
    """Each near section probed with its own text: that of its first document, embedded like all texts."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("work_title"), F.concat("source", F.lit(" > "), "lang").alias("section_path"))
    c = embedded(docs)
    first = docs.groupBy(F.col("section_path").alias("path")).agg(F.min_by("text", "id").alias("text"))
    sections = V.mean_by(c.withColumn("path", F.col("section_path")), ["path"], "vector").join(first, "path")
    query = [float(x) for x in hashed_bag(["the nearest sections of all sources"])[0]]
    out = S.hierarchical(sections, c, query, 5, 20, embed=lambda df, text, name: embedded(df, text, name=name))
    return out.select("path", F.round("section_similarity", 6).alias("section_similarity"), "id", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT id, s_work AS work_title, n_chars AS work_chars, round(s, 6) AS similarity, icon FROM (
 SELECT id, work_title AS s_work, {_COS} AS s FROM {CHUNKS_SQL}, {_Q0}) JOIN (
 SELECT source, sum(n_chars)::BIGINT AS n_chars, CASE WHEN contains(lower(source), '1') THEN 'one' WHEN contains(lower(source), '2') THEN 'two' ELSE 'other' END AS icon FROM documents GROUP BY source) ON s_work = source
 WHERE s_work IN ('src1', 'src2', 'src3') ORDER BY s DESC, id LIMIT 12""")
def summaries_with_work(spark, d):
    work = read(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("work_chars"))
    icon = F.when(F.lower("source").contains("1"), "one").when(F.lower("source").contains("2"), "two").otherwise("other")
    rows = chunks(spark, d).where(S.equal_filters(work_title=["src1", "src2", "src3"])).join(work.withColumn("icon", icon), F.col("work_title") == F.col("source"))
    return S.knn(rows, _first(spark, d), 12).select("id", "work_title", "work_chars", F.round("similarity", 6).alias("similarity"), "icon")


@query(f"""WITH near AS (SELECT author, id, round({_COS} * 100, 1) AS pct, {_COS} AS s FROM {CHUNKS_SQL}, {_Q0} ORDER BY s DESC, id LIMIT 100),
 n AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY pct DESC, id) AS rn FROM near),
 a AS (SELECT author, avg(CASE WHEN rn <= 3 THEN pct END) AS score FROM n GROUP BY author ORDER BY score DESC, author LIMIT 5),
 p AS (SELECT *, row_number() OVER (ORDER BY score DESC, author) AS place, count(*) OVER () AS k FROM a)
 SELECT author, id, pct, round(score, 6) AS score FROM n JOIN p USING (author)
 WHERE rn <= CASE WHEN k = 1 THEN 15 WHEN k <= 3 THEN greatest(4, 15 // k) ELSE 4 END ORDER BY place, rn LIMIT 15""")
def diverse_authors(spark, d):
    out = S.diverse(chunks(spark, d), _first(spark, d), 100, 5, 4, 15)
    return out.select("author", "id", "pct", F.round("score", 6).alias("score"))


_SOURCES = f"""src AS (SELECT 'thought' AS type, id, make_timestamp(2024, 1, 1, 0, 0, 0) + to_hours((id % 500)::INT) AS ts, vector FROM {CHUNKS_SQL} WHERE id % 2 = 0
 UNION ALL SELECT 'conversation', id, make_timestamp(2024, 1, 1, 0, 0, 0) + to_hours((id % 500)::INT), vector FROM {CHUNKS_SQL} WHERE id % 2 = 1)"""


def _memory(spark, d):
    rows = chunks(spark, d).select("id", (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.lit(0), (F.col("id") % 500).cast("int"))).alias("ts"), F.substring("text", 1, 100).alias("content"), "vector")
    return {"thought": rows.where("id % 2 = 0"), "conversation": rows.where("id % 2 = 1")}


@query(f"""WITH {_SOURCES}, s AS (SELECT type, id, ts, {_COS} AS similarity FROM src, {_Q0} WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-15'),
 k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY similarity DESC, id) AS rn FROM s)
 SELECT type, id, ts, round(similarity, 6) AS similarity FROM k WHERE rn <= 12 ORDER BY k.similarity DESC, type, id LIMIT 12""")
def memory_search(spark, d):
    import datetime as dt

    out = S.unified(_memory(spark, d), _first(spark, d), 12, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 15))
    return out.select("type", "id", "ts", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_SOURCES}, k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS rn FROM src) SELECT type, id, ts FROM k WHERE rn <= 8 ORDER BY ts DESC, type, id LIMIT 8")
def memory_latest(spark, d):
    return S.unified(_memory(spark, d), None, 8, sort_by="date_desc").select("type", "id", "ts")


@query(f"""WITH {_SOURCES}, s AS (SELECT type, id, ts, {_COS} AS r FROM src, {_Q0}), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY r DESC, id) AS rn FROM s)
 SELECT type, id, ts, round(r, 6) AS relevance FROM k WHERE rn <= 10 AND 1 - r < 0.8 ORDER BY ts, type, id LIMIT 10""")
def concept_timeline(spark, d):
    return S.timeline(_memory(spark, d), _first(spark, d), 10).select("type", "id", "ts", F.round("relevance", 6).alias("relevance"))


@query(f"""WITH {_SOURCES}, s AS (SELECT type, id, {_COS} AS r FROM src, {_Q0}), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY r DESC, id) AS rn FROM s),
 a AS (SELECT count(*) AS evidence, coalesce(avg(r), 1.0) AS score FROM k WHERE rn <= 10 AND 1 - r < 0.7)
 SELECT evidence, round(score, 2) AS score, CASE WHEN score > 0.8 THEN 'consistent' WHEN score > 0.6 THEN 'partial' ELSE 'to verify' END AS label FROM a""")
def consistency_score(spark, d):
    return S.consistency(_memory(spark, d), _first(spark, d))


@query(f"""WITH {_SOURCES}, s AS (SELECT type, id, {_COS} AS r FROM src, {_Q0}), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY r DESC, id) AS rn FROM s)
 SELECT type, id, round(r, 6) AS similarity FROM k WHERE rn <= 10 AND 1 - r < 0.7 ORDER BY r DESC, type, id LIMIT 5""")
def consistency_evidence(spark, d):
    return S.consistency_evidence(_memory(spark, d), _first(spark, d)).select("type", "id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_SOURCES}, s AS (SELECT type, id, {_COS} AS r FROM src, {_Q0}), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY r DESC, id) AS rn FROM s)
 SELECT type AS source, id, round(r, 6) AS similarity FROM k WHERE rn <= 5""")
def cycle_context(spark, d):
    q = _first(spark, d)
    parts = [S.knn(df, q, 5).select(F.lit(n).alias("source"), "id", F.round("similarity", 6).alias("similarity")) for n, df in _memory(spark, d).items()]
    return parts[0].unionByName(parts[1])


_BATCH = f"""SELECT query_id, id, rn AS rank, round(s, 6) AS similarity FROM (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rn FROM (
 SELECT query_id, id, {_COS} AS s FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS vector FROM embeddings), (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0))) WHERE rn <= 5"""


@query(_BATCH)
def batch_knn(spark, d):
    v = vectors(spark, d).select("id", "vector")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return S.batch_knn(v, q, 5).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query(_BATCH)
def batch_knn_blocked(spark, d):
    v = vectors(spark, d).select("id", "vector")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return S.batch_knn_blocked(v, q, 5).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query("""SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS distance
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label""")
def pairwise_distances(spark, d):
    return S.pairwise_l2_blocked(stored(spark, d), within="label", places=6)


@query("""SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
 WHERE sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) < 0.3""")
def close_pairs(spark, d):
    return S.similar_pairs(stored(spark, d), 0.3).select("a_id", "b_id")


@query("""SELECT vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS distance
 FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)""")
def reference_distances(spark, d):
    q = S.vector_literal(_first(spark, d))
    return vectors(spark, d).select("id", F.round(V.l2(F.col("vector"), q), 6).alias("distance"))


@query()
def approximate_knn(spark, d):
    import numpy as np

    v = vectors(spark, d)
    q = np.array(_first(spark, d))
    index = S.HyperplaneIndex(len(q))
    return index.search(index.build(v), q, 10).select("id", F.round("similarity", 6).alias("similarity"))


_EXPLODED = "(SELECT vec_id AS id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)"


@query(f"SELECT label, pos::INT AS pos, round(avg(x), 6) AS x FROM {_EXPLODED} GROUP BY ALL")
def mean_vector_by_label(spark, d):
    return V.mean_by(vectors(spark, d), ["label"], "vector").select("label", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"SELECT pos::INT AS pos, round(sum((CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END) * x) / sum(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END), 6) AS x FROM {_EXPLODED} GROUP BY pos")
def weighted_mean_vector(spark, d):
    w = F.when(F.col("id") % 3 == 0, 2.0).otherwise(1.0)
    return V.mean_by(vectors(spark, d).withColumn("g", F.lit(1)), ["g"], "vector", w).select(F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"""SELECT label, pos::INT AS pos, round(sum(w * x) / sum(w), 6) AS x FROM {_EXPLODED} JOIN
 (SELECT vec_id AS id, exp(-0.01 * (row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1)) AS w FROM embeddings) USING (id) GROUP BY label, pos""")
def decayed_mean_vector(spark, d):
    age = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("id"))) - 1
    rows = vectors(spark, d).withColumn("age", age)
    return V.mean_by(rows, ["label"], "vector", F.exp(-0.01 * F.col("age"))).select("label", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (0.7 * x[1] + (1 - 0.7) * x[2]) * (0.7 * x[1] + (1 - 0.7) * x[2]))), 6) AS squared_norm
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def blended_vectors(spark, d):
    v = vectors(spark, d).select("id", "vector")
    after = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("after"))
    mix = V.added(V.scaled(F.col("vector"), 0.7), V.scaled(F.col("after"), 1 - 0.7))
    return v.join(after, "id").withColumn("mix", mix).select("id", F.round(V.dot(F.col("mix"), F.col("mix")), 6).alias("squared_norm"))


@query(f"""WITH m AS (SELECT pos, avg(CASE WHEN label = 1 THEN x END) - avg(CASE WHEN label = 2 THEN x END) AS x FROM {_EXPLODED} GROUP BY pos)
 SELECT pos::INT AS pos, round(x / sqrt((SELECT sum(x * x) FROM m)), 6) AS x FROM m""")
def contrast_direction(spark, d):
    from tessel.operators.state import contrast

    v = vectors(spark, d)
    return contrast(v.where("label = 1"), v.where("label = 2")).select(F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT vec_id AS id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(least(sqrt(list_inner_product(e, e)), 0.5), 6) AS clamped_norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def vector_norms(spark, d):
    v = F.col("vector")
    return vectors(spark, d).select("id", F.round(V.norm(v), 6).alias("norm"), F.round(V.norm(V.clamped(v, 0.5)), 6).alias("clamped_norm"))
