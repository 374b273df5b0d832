"""Queries that run streams, providers, models and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tessel.operators import segment as G
from tessel.plans import providers as P
from tessel.sources import files
from tessel.sources.tables import read, vectors
from tessel.streaming import events as E

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def scratch(spark) -> str:
    """A new folder that all executors share; a temporary one only on a local master whose session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessel-")
    return f"{base}/q-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def stream_daily_windows(spark, d):
    out = scratch(spark)
    E.run_to_table(E.windowed_counts(E.triggers(spark, d), "1 day"), f"{out}/t", f"{out}/c", "complete")
    rows = spark.read.parquet(f"{out}/t")
    last = rows.agg(F.max("epoch").alias("epoch"))
    return rows.join(F.broadcast(last), "epoch").select("start", "event_type", "n", F.round("v", 4).alias("v"))


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY ALL""")
def sliding_windows(spark, d):
    return E.windowed_counts(read(spark, d, "events"), "12 hours", "6 hours").select("start", "event_type", "n")


@query("SELECT user_id, count(*) AS cycles, round(sum(abs(value)), 4) AS cumulative FROM events GROUP BY user_id")
def stream_user_states(spark, d):
    out = scratch(spark)
    E.run_to_table(E.user_states(E.triggers(spark, d), 500.0), f"{out}/t", f"{out}/c", "update")
    rows = spark.read.parquet(f"{out}/t")
    return rows.groupBy("user_id").agg(F.max("cycles").alias("cycles"), F.round(F.max("cumulative"), 4).alias("cumulative"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS priority FROM events ORDER BY priority DESC, ts, event_id LIMIT 100")
def trigger_priorities(spark, d):
    priority = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return read(spark, d, "events").withColumn("priority", priority).orderBy(F.desc("priority"), "ts", "event_id").limit(100).select("event_id", "priority")


@query("SELECT conv_id, turn, role, text FROM conversations")
def backup_and_restore(spark, d):
    out = scratch(spark)
    files.export_json({"conversations": read(spark, d, "conversations")}, out)
    return files.restore_json(spark, out)["conversations"]


@query("SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def conversation_export(spark, d):
    return files.conversation_markdown(read(spark, d, "conversations"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events")
def date_repair(spark, d):
    rows = read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return files.repaired_dates(rows)


@query("SELECT lang, count(*) AS n FROM documents WHERE length(trim(text)) > 0 GROUP BY lang")
def ingestion(spark, d):
    """Chunk, embed, append by source, and read back: the documents that gave chunks, by language."""
    out = scratch(spark)
    docs = read(spark, d, "documents")
    chunks = G.chunked(docs.select("doc_id", "text"), "doc_id", "text", G.paragraph_chunks, most=200, least=1)
    rows = P.embedded(chunks.withColumnRenamed("chunk", "text")).join(docs.select("doc_id", "lang", "source"), "doc_id")
    files.append(rows, out, "source")
    return spark.read.parquet(out).select("doc_id", "lang").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query()
def hashed_embeddings(spark, d):
    return P.embedded(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.round(F.col("vector")[0], 6).alias("first"), F.size("vector").alias("width"))


@query()
def model_concepts(spark, d):
    return P.concepts(read(spark, d, "benchmark"), "text").select("item_id", F.array_join("concepts", ",").alias("concepts"))


@query()
def label_classifier(spark, d):
    return P.classified(vectors(spark, d)).groupBy().agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query()
def vector_clusters(spark, d):
    return P.clustered(vectors(spark, d), 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def principal_components(spark, d):
    return P.projected(vectors(spark, d)).select("id", F.round(F.col("pc")[0], 6).alias("x"), F.round(F.col("pc")[1], 6).alias("y"))
