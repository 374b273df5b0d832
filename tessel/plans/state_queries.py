"""Queries over state tensors and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import vector as V
from tessel.operators import search as S
from tessel.operators import state as T
from tessel.sources.tables import TENSOR_SQL, tensor, vectors

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_WEIGHTS = [0.25, 0.2, 0.15, 0.1, 0.1, 0.1, 0.05, 0.05]
_Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


def _first(spark, d):
    return S.vector_literal(S.stored_vector(vectors(spark, d), "id", 0))


@query(f"SELECT state_id, round(sum({_WEIGHTS}[dim + 1] * (1 - {_cos('v', 'q')})), 6) AS total, sum({_WEIGHTS}[dim + 1] * (1 - {_cos('v', 'q')})) > 0.9 AS shock FROM {TENSOR_SQL}, {_Q0} GROUP BY state_id")
def dissonance_by_state(spark, d):
    out = T.dissonance(tensor(spark, d), _first(spark, d), F.array(*map(F.lit, _WEIGHTS)), 0.9)
    return out.select("state_id", F.round("total", 6).alias("total"), "shock")


@query(f"""WITH c AS (SELECT list_inner_product(embedding::DOUBLE[], q) AS s FROM embeddings, {_Q0} WHERE vec_id BETWEEN 1 AND 30), a AS (
 SELECT count(*) FILTER (s < 0.1) AS hard_negatives, max(s) AS top, count(*) AS n FROM c)
 SELECT hard_negatives, round(CASE WHEN n = 0 THEN 1 WHEN top < 0.3 THEN 1 - top ELSE 0 END, 6)::DOUBLE AS novelty, round(0.25 + 0.2 * hard_negatives / greatest(n, 1) + 0.1 * CASE WHEN n = 0 THEN 1 WHEN top < 0.3 THEN 1 - top ELSE 0 END, 6) AS total FROM a""")
def enhanced_dissonance(spark, d):
    context = vectors(spark, d).where(F.col("id").between(1, 30))
    out = T.enhanced_dissonance(F.lit(0.25), context, _first(spark, d))
    return out.select("hard_negatives", F.round("novelty", 6).alias("novelty"), F.round("total", 6).alias("total"))


@query(f"""WITH t AS {TENSOR_SQL} SELECT a.state_id, round(avg(1 - {_cos('a.v', 'b.v')}), 6) AS tension FROM t a JOIN t b ON a.state_id = b.state_id
 AND ((a.dim = 0 AND b.dim = 1) OR (a.dim = 2 AND b.dim = 3) OR (a.dim = 4 AND b.dim = 7)) GROUP BY 1""")
def internal_tension(spark, d):
    return T.tension(tensor(spark, d), [(0, 1), (2, 3), (4, 7)]).select("state_id", F.round("tension", 6).alias("tension"))


@query(f"SELECT state_id, round(avg(list_inner_product(v, q)), 4) AS mean_similarity, round(avg(list_inner_product(v, q)) * 100, 1) AS percent FROM {TENSOR_SQL}, {_Q0} GROUP BY 1")
def mean_similarity(spark, d):
    q = _first(spark, d)
    s = F.avg(V.dot(F.col("v"), q))
    return tensor(spark, d).groupBy("state_id").agg(F.round(s, 4).alias("mean_similarity"), F.round(s * 100, 1).alias("percent"))


@query(f"""WITH s AS (SELECT label, avg(list_inner_product(q, embedding::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)) AS m FROM embeddings, {_Q0} GROUP BY label)
 SELECT label, round(m, 6) AS corroboration, CASE WHEN m > 0.6 THEN 'strong' WHEN m > 0.3 THEN 'moderate' ELSE 'weak' END AS band FROM s""")
def corroboration(spark, d):
    v, q = F.col("vector"), _first(spark, d)
    m = vectors(spark, d).groupBy("label").agg(F.avg(V.dot(q, v) / (V.norm(v) + 1e-8)).alias("m"))
    return m.select("label", F.round("m", 6).alias("corroboration"), F.when(F.col("m") > 0.6, "strong").when(F.col("m") > 0.3, "moderate").otherwise("weak").alias("band"))


@query(f"""WITH a AS (SELECT state_id, t.dim, e.vec_id AS article, list_inner_product(t.v, e.embedding::DOUBLE[]) AS s FROM {TENSOR_SQL} t, embeddings e WHERE e.vec_id < 4 AND t.dim = e.vec_id % 8)
 SELECT state_id, round(avg(s), 6) AS alignment, count(*) FILTER (s < 0) AS violations, CASE WHEN bool_or(s < 0 AND article < 2) THEN 'critical' WHEN bool_or(s < 0) THEN 'important' ELSE 'aligned' END AS status FROM a GROUP BY state_id""")
def article_alignment(spark, d):
    articles = vectors(spark, d).where("id < 4").select(F.col("id").alias("article"), (F.col("id") % 8).cast("int").alias("dim"), "vector")
    s = tensor(spark, d).join(F.broadcast(articles), "dim").withColumn("s", V.dot(F.col("v"), F.col("vector")))
    status = F.when(F.bool_or((F.col("s") < 0) & (F.col("article") < 2)), "critical").when(F.bool_or(F.col("s") < 0), "important").otherwise("aligned")
    return s.groupBy("state_id").agg(F.round(F.avg("s"), 6).alias("alignment"), F.count_if(F.col("s") < 0).alias("violations"), status.alias("status"))


_DRIFT = f"""t AS {TENSOR_SQL}, p AS (SELECT a.state_id, sum(list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v)) AS c, sum(list_inner_product(b.v, b.v)) AS n
 FROM t a JOIN t b ON a.dim = b.dim AND b.state_id = a.state_id - 1 GROUP BY 1),
 dr AS (SELECT state_id, coalesce(sqrt(c) / sqrt(n), 0) AS drift FROM (SELECT DISTINCT state_id FROM t) LEFT JOIN p USING (state_id)),
 cu AS (SELECT state_id, drift, sum(drift) OVER (ORDER BY state_id) AS cumulative FROM dr)"""


@query(f"WITH {_DRIFT} SELECT state_id, round(drift, 6) AS drift, round(cumulative, 6) AS cumulative FROM cu")
def drift_per_cycle(spark, d):
    return T.drift(tensor(spark, d)).select("state_id", F.round("drift", 6).alias("drift"), F.round("cumulative", 6).alias("cumulative"))


_DIST = f"di AS (SELECT a.state_id, a.dim, 1 - {_cos('a.v', 'b.v')} AS distance FROM t a JOIN t b ON a.dim = b.dim AND b.state_id = 0)"


@query(f"WITH t AS {TENSOR_SQL}, {_DIST} SELECT state_id, dim, round(distance, 6) AS distance, CASE WHEN distance > 0.05 THEN 'red' WHEN distance > 0.02 THEN 'amber' ELSE 'green' END AS flag, repeat('#', least(20, floor(distance * 10)::INT)) AS bar FROM di")
def distance_to_reference(spark, d):
    t = tensor(spark, d)
    out = T.distances(t, t.where("state_id = 0"))
    flag = F.when(F.col("distance") > 0.05, "red").when(F.col("distance") > 0.02, "amber").otherwise("green")
    return out.select("state_id", "dim", F.round("distance", 6).alias("distance"), flag.alias("flag"), F.repeat(F.lit("#"), F.least(F.lit(20), F.floor(F.col("distance") * 10).cast("int"))).alias("bar"))


@query(f"""WITH {_DRIFT}, {_DIST}, g AS (SELECT state_id, count(*) FILTER (distance > 0.05) AS drifting, list(dim ORDER BY -distance, dim)[1:3] AS top FROM di GROUP BY 1)
 SELECT state_id, CASE WHEN cumulative > 40 THEN 'critical' WHEN cumulative > 20 OR drifting > 7 THEN 'warning' WHEN drift > 0.002 THEN 'warning' ELSE 'ok' END AS level, drifting, array_to_string(top, ',') AS top_dims FROM cu JOIN g USING (state_id)""")
def drift_alerts(spark, d):
    t = tensor(spark, d)
    dims = T.distances(t, t.where("state_id = 0"))
    out = T.alerts(T.drift(t), dims, 20.0)
    return out.select("state_id", "level", "drifting", F.array_join(F.transform("top_dims", lambda x: x.cast("string")), ",").alias("top_dims"))


_DIRECTIONS = "(SELECT 'd' || vec_id AS name, 'c' || label AS category, label % 8 AS dim, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id BETWEEN 100 AND 139)"


def _directions(spark, d):
    return vectors(spark, d).where(F.col("id").between(100, 139)).select(F.concat(F.lit("d"), F.col("id")).alias("name"), F.concat(F.lit("c"), F.col("label")).alias("category"), "label", "vector")


def _profile(spark, d):
    return T.projection(tensor(spark, d), _directions(spark, d), (F.col("label") % 8).cast("int")).drop("label")


_PROFILE = f"(SELECT state_id, category, name, list_inner_product(v, vector) AS value FROM {TENSOR_SQL} t JOIN {_DIRECTIONS} x ON t.dim = x.dim)"


@query(f"SELECT category, name, round(value, 4) AS value, CASE WHEN value > 0.5 THEN 'tres' WHEN value > 0.2 THEN 'moderement' WHEN value > -0.2 THEN 'neutre' WHEN value > -0.5 THEN 'peu' ELSE 'pas du tout' END AS band FROM {_PROFILE} WHERE state_id = 5")
def profile_projection(spark, d):
    return _profile(spark, d).where("state_id = 5").select("category", "name", F.round("value", 4).alias("value"), T.intensity(F.col("value")).alias("band"))


@query(f"""WITH p AS {_PROFILE}, c AS (SELECT a.category, a.name, a.value, coalesce(b.value, 0) AS other FROM (SELECT * FROM p WHERE state_id = 5) a LEFT JOIN (SELECT * FROM p WHERE state_id = 9 AND category <> 'c1') b USING (category, name)),
 r AS (SELECT *, abs(value - other) AS delta, row_number() OVER (ORDER BY round(abs(value - other), 9), category, name) AS lo, row_number() OVER (ORDER BY round(abs(value - other), 9) DESC, category, name) AS hi FROM c)
 SELECT category, name, round(delta, 6) AS delta, CASE WHEN lo <= 5 THEN 'convergent' ELSE 'divergent' END AS kind FROM r WHERE lo <= 5 OR hi <= 5""")
def profile_comparison(spark, d):
    from pyspark.sql.window import Window

    p = _profile(spark, d)
    c = T.compare_profiles(p.where("state_id = 5"), p.where("state_id = 9 AND category <> 'c1'"))
    key = F.round("delta", 9)
    # a profile holds at most the configured directions, so one ordering task suffices
    r = c.withColumn("lo", F.row_number().over(Window.orderBy(key, "category", "name"))).withColumn("hi", F.row_number().over(Window.orderBy(key.desc(), "category", "name")))
    return r.where("lo <= 5 OR hi <= 5").select("category", "name", F.round("delta", 6).alias("delta"), F.when(F.col("lo") <= 5, "convergent").otherwise("divergent").alias("kind"))


@query(f"""SELECT category, name, round(value, 4) AS computed, declared, round(declared / 10.0, 2) AS declared_scaled FROM {_PROFILE} LEFT JOIN
 (SELECT 'd' || i AS name, (i % 21 - 10)::INT AS declared FROM range(100, 120) t(i)) USING (name) WHERE state_id = 0""")
def declared_profile(spark, d):
    declared = spark.range(100, 120).select(F.concat(F.lit("d"), F.col("id")).alias("name"), (F.col("id") % 21 - 10).cast("int").alias("declared"))
    out = _profile(spark, d).where("state_id = 0").join(F.broadcast(declared), "name", "left")
    return out.select("category", "name", F.round("value", 4).alias("computed"), "declared", F.round(F.col("declared") / 10.0, 2).alias("declared_scaled"))


@query("""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
 f AS (SELECT label, rn, x AS s FROM e WHERE rn = 1 UNION ALL
 SELECT label, rn, list_transform(m, lambda y: y / sqrt(list_inner_product(m, m))) FROM (SELECT e.label, e.rn, list_transform(list_zip(f.s, e.x), lambda p: 0.85 * p[1] + 0.15 * p[2]) AS m FROM f JOIN e ON e.label = f.label AND e.rn = f.rn + 1))
 SELECT label, round(s[1], 6) AS first, round(s[64], 6) AS last, rn AS steps FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY rn DESC) = 1""")
def state_recursion(spark, d):
    steps = vectors(spark, d).select("label", F.col("id").alias("ord"), F.lit(0.85).alias("alpha"), F.lit(0.15).alias("beta"), F.col("vector").alias("e"))
    return T.evolve(steps, "label").select("label", F.round(F.col("state")[0], 6).alias("first"), F.round(F.col("state")[63], 6).alias("last"), "steps")


@query()
def tensor_recursion(spark, d):
    v = vectors(spark, d)
    start = [S.stored_vector(v, "id", i) for i in range(8)]
    steps = v.where("id >= 8").select(F.lit("main").alias("entity"), F.col("id").alias("ord"), F.col("vector").alias("e"), F.lit(0.001).alias("size"))
    out = T.evolve_dims(steps, start, [0.1, 0.2, 0.3, 0.2, 0.1, 0.1, 0.05, 0.05])
    return out.select("entity", F.posexplode("state").alias("dim", "v")).select("entity", "dim", F.round(F.col("v")[0], 9).alias("first"), F.round(V.norm(F.col("v")), 9).alias("norm"))


@query("""SELECT a.vec_id AS id, round(least(sqrt(list_inner_product(m, m)), 0.001), 9) AS size FROM (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: p[1] * 0.4 + p[2] * 0.3) AS m
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""")
def clamped_delta(spark, d):
    v = vectors(spark, d).select("id", "vector")
    other = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b"))
    delta = T.combined_delta([F.col("vector"), F.col("b")], [0.4, 0.3])
    return v.join(other, "id").withColumn("delta", delta).select("id", F.round(V.norm(F.col("delta")), 9).alias("size"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'user' WHEN value > 60 THEN 'dissonance' WHEN event_type = 'error' THEN 'drift' WHEN event_id % 7 >= 3 THEN 'hard_negatives' ELSE 'silent' END AS reason FROM events""")
def verbalise_decision(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    trigger = F.when(F.col("event_type") == "click", "user").otherwise("auto")
    alert = F.when(F.col("event_type") == "error", "warning").otherwise("ok")
    return e.select("event_id", T.verbalise(trigger, F.col("value") / 100, alert, F.col("event_id") % 7).alias("reason"))


@query(f"SELECT vec_id AS id, CASE WHEN s < 0.1 THEN true WHEN vec_id % 3 = 0 THEN s < 0.3 WHEN s > 0.7 THEN (vec_id % 10) / 10.0 > 0.8 ELSE (vec_id % 10) / 10.0 > 0.5 END AS hard_negative FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], q) AS s FROM embeddings, {_Q0})")
def contradiction_decision(spark, d):
    rows = vectors(spark, d).withColumn("s", V.dot(F.col("vector"), _first(spark, d)))
    nli = F.when(F.col("id") % 3 != 0, (F.col("id") % 10) / 10.0)
    return rows.select("id", T.contradiction(F.col("s"), nli).alias("hard_negative"))


@query("""WITH m AS (SELECT event_id, CASE WHEN event_type = 'view' THEN least(event_id % 6 * 0.03, 0.1) * 0.5 WHEN event_type = 'click' AND event_id % 400 > 200 THEN least(event_id % 6 * 0.03, 0.1) + 0.02 ELSE least(event_id % 6 * 0.03, 0.1) END AS m FROM events)
 SELECT event_id, round((0.85 - m) / (0.85 - m + 0.15 + m), 9)::DOUBLE AS alpha, round((0.15 + m) / (0.85 - m + 0.15 + m), 9)::DOUBLE AS beta FROM m""")
def adaptive_weights(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    trigger = F.when(F.col("event_type") == "view", "timer").when(F.col("event_type") == "click", "user").otherwise("auto")
    a, b = T.adaptive_rates(F.col("event_id") % 6, trigger, F.col("event_id") % 400)
    return e.select("event_id", F.round(a, 9).alias("alpha"), F.round(b, 9).alias("beta"))
