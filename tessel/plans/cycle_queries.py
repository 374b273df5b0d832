"""Queries of the semiotic cycle, as a table and as a stream, and of how a course begins."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from tessel.functions import vector as V
from tessel.operators import state as T
from tessel.operators.cycle import Settings, cycles, summarised, unit
from tessel.plans.pipeline_queries import scratch
from tessel.sources.tables import TENSOR_SQL, read, tensor, vectors
from tessel.streaming import events as E
from tessel.streaming.cycles import stream_cycles

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _settings(spark, d) -> Settings:
    """The first 37 stored vectors as configuration: state, reference, articles, anchors, themes."""
    v = {r["id"]: r["vector"] for r in vectors(spark, d).where("id < 37").select("id", "vector").collect()}
    some = lambda a, b: unit(np.array([v[i] for i in range(a, b)]))
    return Settings(start=some(0, 8), reference=some(8, 16), articles=some(16, 19), critical=(0,), anchors=some(19, 21), themes=some(21, 37), every=21600.0, vigilance=86400.0, hold=3600.0, cumulative=0.05, per_dimension=0.5)


def _inputs(spark, d, settings):
    """Per stored vector: its number, itself as it is stored, and the summary of what retrieval finds for it, here the five that follow it."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    follows = v.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("id") - k)).alias("id"), F.col("id").alias("other"), F.col("vector").alias("found"))
    context = follows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "found"))), lambda x: x["found"]).alias("context"))
    return summarised(v.join(context, "id", "left").select(F.col("id").alias("input"), F.col("vector").alias("e"), "context"), settings)


def _triggers(spark, d, events, settings):
    n = read(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n")).head()["n"]
    kind = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "veille").otherwise("corpus")
    rows = events.select("user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("nth"), kind.alias("kind"), (F.col("event_id") % n).alias("input"))
    return rows.join(_inputs(spark, d, settings), "input", "left").drop("input")


def _shown(df):
    return df.select("user_id", F.round("at", 3).alias("at"), "kind", "state_id", F.round("total", 6).alias("total"), "hard_negatives", "impact_id", F.round("magnitude", 9).alias("magnitude"), "thought", "speaks", "reason")


@query()
def semiotic_cycles(spark, d):
    """Every cycle and drift alert of each user's course over all events."""
    settings = _settings(spark, d)
    return _shown(cycles(_triggers(spark, d, read(spark, d, "events"), settings), settings))


@contextmanager
def rocks(spark):
    """The state store that keyed state with timers needs, for the streams started inside."""
    key, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@query()
def stream_semiotic_cycles(spark, d):
    """The same courses from a stream of events, in keyed state with event-time timers."""
    out, settings = scratch(spark), _settings(spark, d)
    with rocks(spark):
        E.run_to_table(stream_cycles(_triggers(spark, d, E.triggers(spark, d), settings), settings), f"{out}/t", f"{out}/c")
    return _shown(spark.read.parquet(f"{out}/t"))


_Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _probe(spark, d):
    return F.broadcast(vectors(spark, d).where("id = 0").select(F.col("vector").alias("q")))  # one row


@query(f"""SELECT state_id, round(avg(list_inner_product(v, q)), 6) AS coherence, CASE WHEN avg(list_inner_product(v, q)) > 0.5 THEN 'integrate' ELSE 'weak_integrate' END AS action
 FROM {TENSOR_SQL}, {_Q0} WHERE dim IN (0, 2, 4, 7) GROUP BY state_id""")
def apriori_coherence(spark, d):
    out = T.coherence(tensor(spark, d).crossJoin(_probe(spark, d)), F.col("q"))
    return out.select("state_id", F.round("coherence", 6).alias("coherence"), "action")


@query(f"SELECT state_id, round(list_inner_product(v, q), 6) AS confirmation, CASE WHEN list_inner_product(v, q) > 0.8 THEN 'reinforce' ELSE 'resist' END AS action FROM {TENSOR_SQL}, {_Q0} WHERE dim = 2")
def tenacity_confirmation(spark, d):
    out = T.tenacity(tensor(spark, d).crossJoin(_probe(spark, d)), F.col("q"))
    return out.select("state_id", F.round("confirmation", 6).alias("confirmation"), "action")


# --- how a course begins ---


def _declared(spark, d):
    """Every third user declares a profile: the stored vectors from eight times its number on."""
    return vectors(spark, d).select(F.floor(F.col("id") / 8).alias("user_id"), (F.col("id") % 8).cast("int").alias("dim"), "vector").where("user_id % 3 = 0")


def _observed(spark, d):
    """Users have observed states where their number leaves 1, 2 or 3 by four: the vectors labelled with its last digit, the latest weighing most."""
    v = vectors(spark, d).select(F.col("label").cast("long").alias("digit"), F.col("id").alias("ord"), "vector")
    users = read(spark, d, "events").select("user_id").distinct().where("user_id % 4 > 0").withColumn("digit", F.col("user_id") % 10)
    means = T.recent_mean(v, "digit", "ord", 100)
    return users.join(means, "digit").select("user_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dim"), "vector")


_BEGIN = """WITH u AS (SELECT DISTINCT user_id FROM events), dims AS (SELECT user_id, unnest(range(8))::INT AS dim FROM u),
 de AS (SELECT vec_id // 8 AS user_id, (vec_id % 8)::INT AS dim, embedding::DOUBLE[] AS v FROM embeddings WHERE (vec_id // 8) % 3 = 0),
 l AS (SELECT label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1 AS k FROM embeddings),
 o1 AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos, exp(-0.01 * k) AS w FROM l WHERE k < 100),
 o2 AS (SELECT label, pos, sum(w * x) / sum(w) AS x FROM o1 GROUP BY ALL), ob AS (SELECT label, list(x ORDER BY pos) AS v FROM o2 GROUP BY label),
 s AS (SELECT user_id, dim, list_transform(range(64), lambda i: ('0x' || substr(md5('42:' || user_id || ':' || dim || ':' || i), 1, 8))::BIGINT / 4294967296.0 - 0.5) AS v FROM dims),
 j AS (SELECT dims.user_id, dims.dim, de.v AS d, CASE WHEN dims.user_id % 4 > 0 THEN ob.v END AS o, s.v AS r, hd.user_id IS NOT NULL AS hasd FROM dims JOIN s USING (user_id, dim) LEFT JOIN de USING (user_id, dim) LEFT JOIN ob ON ob.label = dims.user_id % 10 LEFT JOIN (SELECT user_id FROM de GROUP BY 1 HAVING count(*) = 8) hd ON hd.user_id = dims.user_id),
 c AS (SELECT user_id, dim, CASE WHEN hasd AND o IS NOT NULL THEN 'hybrid' WHEN hasd THEN 'declared' WHEN o IS NOT NULL THEN 'history' ELSE 'seeded' END AS origin,
 CASE WHEN hasd AND o IS NOT NULL THEN list_transform(list_zip(d, o), lambda p: 0.7 * p[1] + 0.3 * p[2]) WHEN hasd THEN d WHEN o IS NOT NULL THEN o ELSE r END AS v FROM j)
 SELECT user_id, dim, origin, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM c"""


@query(_BEGIN)
def reference_cascade(spark, d):
    """Each user's reference: declared and observed states blended, else the one there is, else seeded vectors."""
    users = read(spark, d, "events").select("user_id").distinct()
    out = T.beginnings(users, _declared(spark, d), _observed(spark, d), width=64)
    return out.select("user_id", "dim", "origin", F.round(F.col("vector")[0], 6).alias("first"))


@query("""SELECT user_id, CASE WHEN user_id < (SELECT max(vec_id) // 8 FROM embeddings) THEN user_id ELSE -1 END AS state_id, CASE WHEN user_id < (SELECT max(vec_id) // 8 FROM embeddings) THEN 'stored' ELSE 'seeded' END AS origin FROM (SELECT DISTINCT user_id FROM events)""")
def initial_state(spark, d):
    """Each user's first state: the stored one of its number if all its dimensions stand, else a seeded one."""
    users = read(spark, d, "events").select("user_id").distinct()
    stored = tensor(spark, d).select(F.col("state_id").alias("user_id"), "dim", F.col("v").alias("vector"))
    last = vectors(spark, d).agg((F.floor(F.max("id") / 8)).alias("last"))
    stored = stored.crossJoin(F.broadcast(last)).where("user_id < last").drop("last")
    out = T.beginnings(users, stored, None, width=64, names=("stored", "stored", "history"))
    return out.groupBy("user_id").agg(F.first("origin").alias("origin")).select("user_id", F.when(F.col("origin") == "stored", F.col("user_id")).otherwise(F.lit(-1)).alias("state_id"), "origin")
