"""Queries over renderings, small rules and the engine's surface, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.api import Engine
from tessel.operators import rendering as R
from tessel.operators import segment as G
from tessel.sources.tables import CHUNKS_SQL, TENSOR_SQL, chunks, read, tensor, vectors

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, CASE WHEN t >= 5 THEN 'strong' WHEN t >= 2 THEN 'marked' WHEN t > -2 THEN 'neutral' WHEN t > -5 THEN 'weak' ELSE 'opposed' END AS band FROM (SELECT p_partkey, p_partkey % 21 - 10 AS t FROM part)")
def trait_bands(spark, d):
    return read(spark, d, "part").select("p_partkey", R.trait_band(F.col("p_partkey") % 21 - 10).alias("band"))


@query()
def toward_declared_traits(spark, d):
    v = vectors(spark, d)
    traits = v.where("id BETWEEN 1 AND 6").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("ord"), ((F.col("id") % 7 - 3) / 60).alias("target"), F.col("vector").alias("direction")))).alias("traits"))
    return v.where("id = 0").crossJoin(F.broadcast(traits)).select(F.posexplode(R.toward_traits(F.col("vector"), F.col("traits"))).alias("pos", "x")).withColumn("x", F.round("x", 9))


@query("SELECT string_agg(format('[{}] {}: {:+.2f}', event_type, 'u' || user_id, v), chr(10) ORDER BY event_type, 'u' || user_id) AS text FROM (SELECT event_type, user_id, round(count(*) / 8.0, 2) AS v FROM events GROUP BY ALL)")
def state_prompt(spark, d):
    p = read(spark, d, "events").groupBy(F.col("event_type").alias("category"), F.concat(F.lit("u"), "user_id").alias("name")).agg(F.round(F.count(F.lit(1)) / 8.0, 2).alias("value"))
    return R.state_lines(p)


@query("SELECT day, day::VARCHAR || ': ' || cycles || ' cycles, ' || alerts || ' alerts' AS text FROM (SELECT ts::DATE AS day, count(*) AS cycles, count(*) FILTER (event_type = 'error') AS alerts FROM events GROUP BY 1)")
def report_texts(spark, d):
    days = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("cycles"), F.count_if(F.col("event_type") == "error").alias("alerts"))
    return R.report_text(days)


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '—' ELSE strftime(make_timestamp(event_id * 100000 * 1000000), '%d %m %Y à %H:%M') END AS stamp FROM events")
def unix_stamps(spark, d):
    return read(spark, d, "events").select("event_id", R.stamp(F.when(F.col("event_id") % 9 != 0, F.col("event_id") * 100000)).alias("stamp"))


@query()
def seeded_sources(spark, d):
    return read(spark, d, "events").groupBy(R.seeded_source(F.col("event_id")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query()
def seeded_impact(spark, d):
    return R.seeded_choice(read(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id"), "event_id", 5)


@query(f"""WITH t AS {TENSOR_SQL} SELECT a.dim, round(1 - list_inner_product(a.v, b.v), 6) AS change, round(sqrt(list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v)), 6) AS moved
 FROM t a JOIN t b ON a.dim = b.dim AND a.state_id = 7 AND b.state_id = 0""")
def dimension_changes(spark, d):
    return R.change_ranking(tensor(spark, d), 7, 0).select("dim", F.round("change", 6).alias("change"), F.round("moved", 6).alias("moved"))


@query("SELECT event_id AS occasion_id, value FROM events ORDER BY event_id DESC LIMIT 25")
def component_evolution(spark, d):
    return R.evolution(read(spark, d, "events").select(F.col("event_id").alias("occasion_id"), "value"), 25)


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'toc_display' ELSE 'main' END AS kind, doc_id % 6 <> 0 AND doc_id % 5 <> 1 AS should_index, CASE WHEN doc_id % 6 = 0 THEN 'contents page' END AS reason FROM documents""")
def section_corrections(spark, d):
    title = F.when(F.col("doc_id") % 6 == 0, "Table des matières").otherwise("Chapter")
    rows = read(spark, d, "documents").select("doc_id", title.alias("title"), F.lit("main").alias("kind"), F.when(F.col("doc_id") % 5 == 1, False).alias("should_index"))
    return R.corrected_sections(rows).select("doc_id", "kind", "should_index", "reason")


@query("SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN 't' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chapter FROM conversations")
def chapter_inheritance(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3 + 1).alias("level"), F.concat(F.lit("t"), "turn").alias("title"))
    return R.chapters(rows, "conv_id", "turn").select("conv_id", "turn", "chapter")


@query("SELECT conv_id, string_agg(CASE WHEN turn % 4 = 0 THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations WHERE turn >= 1 AND trim(text) <> '' GROUP BY conv_id")
def paragraphs_to_markdown(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, 2).alias("level"), "text")
    return R.paragraphs_markdown(rows, "conv_id", "turn", 1)


@query("SELECT conv_id, string_agg('<!-- Page ' || turn || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def pages_to_markdown(spark, d):
    return R.pages_markdown(read(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query("SELECT (CASE WHEN m > 50000 THEN 10 WHEN m > 10000 THEN 25 WHEN m > 3000 THEN 50 WHEN m IS NULL THEN 50 ELSE 100 END)::INT AS batch FROM (SELECT floor(avg(length(text)) FILTER (length(text) > 0)) AS m FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 10))")
def insert_batch_size(spark, d):
    return R.batch_size(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed_work(spark, d):
    return R.remaining(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("SELECT conv_id, turn FROM (SELECT * FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 100) WHERE length(text) > 60")
def limited_then_filtered(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").orderBy("conv_id", "turn").limit(100).where(F.length("text") > 60).select("conv_id", "turn")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:00:00' AND event_type IN ('click', 'error') AND NOT (user_id % 2 = 0)")
def filtered_events(spark, d):
    e = read(spark, d, "events")
    return e.where((F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-09 12:00:00") & F.col("event_type").isin("click", "error") & (F.col("user_id") % 2 != 0)).select("event_id", "ts")


@query("SELECT count(*) AS cycles, round(avg(value), 6) AS mean, max(value) AS top, count(*) FILTER (event_type = 'error') AS alerts FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100)")
def recent_cycle_stats(spark, d):
    last = read(spark, d, "events").orderBy(F.desc("event_id")).limit(100)
    return last.agg(F.count(F.lit(1)).alias("cycles"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"), F.count_if(F.col("event_type") == "error").alias("alerts"))


def _engine(spark, d):
    c = chunks(spark, d).withColumn("source_id", F.col("work_title"))
    works = read(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.min("lang").alias("language")).withColumns({"title": F.col("source_id"), "author": F.concat(F.lit("by "), F.col("source_id"))})
    return Engine({"chunks": c, "works": works})


@query(f"SELECT id, order_index, (SELECT count(*) FROM {CHUNKS_SQL} WHERE work_title = 'src3') AS total_count, 10 AS limit, 5 AS offset FROM {CHUNKS_SQL} WHERE work_title = 'src3' ORDER BY order_index, id LIMIT 10 OFFSET 5")
def chunks_of_document(spark, d):
    return _engine(spark, d).get_chunks_by_document("src3", 10, 5).select("id", "order_index", "total_count", "limit", "offset")


@query("SELECT source AS source_id, min(lang) AS language, (SELECT count(DISTINCT source) FROM documents) AS total_count FROM documents GROUP BY source ORDER BY source LIMIT 7 OFFSET 3")
def listed_documents(spark, d):
    return _engine(spark, d).list_documents(limit=7, offset=3).select("source_id", "language", "total_count")


@query(f"SELECT 'chunks' AS \"table\", count(*) AS deleted FROM {CHUNKS_SQL} WHERE work_title = 'src5' UNION ALL SELECT 'works', 1")
def document_deletion(spark, d):
    return _engine(spark, d).delete_document("src5", confirm=True)[1]


@query()
def routed_search(spark, d):
    v = vectors(spark, d).where("id = 0").head()["vector"]
    engine = _engine(spark, d)
    engine.embed = lambda texts: [v for _ in texts]
    return engine.search("ok", limit=5).select("id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_no, format('chunk_{:05d}', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS chunk_id FROM conversations WHERE role <> 'system' AND turn >= 1""")
def paragraph_numbering(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = read(spark, d, "conversations").where("role <> 'system' AND turn >= 1").withColumn("chunk_no", n.cast("long"))
    return rows.select("conv_id", "turn", "chunk_no", F.format_string("chunk_%05d", "chunk_no").alias("chunk_id"))


@query()
def document_chunks(spark, d):
    return G.chunked(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", G.paragraph_chunks, most=300, least=30).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
