"""Queries over collections and events and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators import catalog as C
from tessel.operators import metrics as M
from tessel.sources.tables import CHUNKS_SQL, chunks, read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT count(*) AS rows, count(DISTINCT lang) AS n_lang, string_agg(DISTINCT lang, '|' ORDER BY lang) AS list_lang, count(DISTINCT source) AS n_source, string_agg(DISTINCT source, '|' ORDER BY source) AS list_source FROM documents")
def collection_stats(spark, d):
    return C.statistics(read(spark, d, "documents"), ["lang", "source"])


@query(f"SELECT work_title, count(*) AS n_chunks, coalesce(arg_min(author, id), 'Unknown') AS author FROM {CHUNKS_SQL} WHERE trim(coalesce(work_title, '')) <> '' GROUP BY work_title")
def works_counts(spark, d):
    return C.work_counts(chunks(spark, d))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'unresolved', count(*) FROM events WHERE event_type = 'error'")
def table_counts(spark, d):
    rows = [read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "conversations", "events")]
    rows.append(read(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("n")).select(F.lit("unresolved").alias("name"), "n"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT source, count(*) AS n_chunks, arg_min(lang, doc_id) AS first_lang, min(doc_id) AS first_id FROM documents GROUP BY source")
def document_stats(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("lang", "doc_id").alias("first_lang"), F.min("doc_id").alias("first_id"))


@query(f"""WITH c AS {CHUNKS_SQL}, w AS (SELECT DISTINCT work_title, author FROM c), n AS (SELECT work_title, author, count(*) AS n FROM c WHERE language = 'en' GROUP BY ALL)
 SELECT author, work_title, sum(coalesce(n, 0))::BIGINT AS n_chunks, count(*) AS n_works FROM w LEFT JOIN n USING (work_title, author) GROUP BY ROLLUP (author, work_title) HAVING author IS NOT NULL""")
def author_rollup(spark, d):
    c = chunks(spark, d)
    return C.author_rollup(c.select("work_title", "author").distinct(), c.where("language = 'en'"))


@query("SELECT p_partkey, p_brand, count(l_orderkey) AS n_lines FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY ALL")
def work_chunk_left_counts(spark, d):
    n = read(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return read(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_brand", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, ' / ' ORDER BY turn) AS digest FROM conversations GROUP BY conv_id")
def conversation_messages(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.array_join(F.transform(ordered, lambda x: x["t"]), " / ").alias("digest"))


_JOINED = """SELECT m.conv_id, m.turn, left(m.text, 60) AS head FROM conversations m JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.conv_id = m.conv_id
 WHERE m.role = 'user' AND length(m.text) > 20 AND lower(m.text) NOT LIKE '%test%' AND c.n > 2 ORDER BY m.conv_id DESC, m.turn LIMIT 100"""


@query(_JOINED)
def sql_message_join(spark, d):
    read(spark, d, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(_JOINED)


@query("SELECT doc_id, lang, (SELECT count(*) FROM documents WHERE lang = 'en') AS total_count, 20 AS limit, 40 AS offset FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 40")
def paginate_documents(spark, d):
    return C.page(read(spark, d, "documents").where("lang = 'en'").select("doc_id", "lang"), ["doc_id"], 20, 40)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, d):
    return C.after(read(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", 1000, 50)


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def point_lookup(spark, d):
    return read(spark, d, "documents").where("doc_id = 17").select("doc_id", "lang", "source", "n_chars")


@query("SELECT conv_id, turn, left(text, 100) AS head FROM conversations WHERE role = 'assistant' ORDER BY conv_id DESC, turn DESC LIMIT 20")
def latest_messages(spark, d):
    return C.latest(read(spark, d, "conversations").where("role = 'assistant'"), "conv_id", 20, "turn").select("conv_id", "turn", F.substring("text", 1, 100).alias("head"))


@query("SELECT s_name, n_name, row_number() OVER (ORDER BY lower(n_name), lower(s_name)) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY place LIMIT 50")
def case_insensitive_order(spark, d):
    rows = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    top = rows.orderBy(F.lower("n_name"), F.lower("s_name")).limit(50)
    return top.select("s_name", "n_name", F.row_number().over(Window.orderBy(F.lower("n_name"), F.lower("s_name"))).alias("place"))


@query("""WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'es'), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND n_chars > 3000)
 SELECT (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS missing, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS unexpected,
 (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common""")
def collection_sets(spark, d):
    docs = read(spark, d, "documents")
    both = docs.agg(F.collect_set(F.when(F.col("lang") == "es", F.col("source"))).alias("a"), F.collect_set(F.when((F.col("lang") == "de") & (F.col("n_chars") > 3000), F.col("source"))).alias("b"))
    return both.select(*[F.when(F.size(v) > 0, F.array_join(v, ",")).alias(k) for k, v in C.name_sets(F.col("a"), F.col("b")).items()])


@query("""WITH doomed AS (SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderkey % 10 = 3)
 SELECT 'orders' AS "table", count(*) AS deleted FROM orders WHERE o_orderkey IN (SELECT * FROM doomed) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM doomed)""")
def delete_cascade_counts(spark, d):
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return C.delete_cascade({"orders": orders, "lineitem": lines}, "o_orderkey", orders.where("o_custkey = 7 OR o_orderkey % 10 = 3"), confirm=True)[1]


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3 OR o_orderstatus = 'F')")
def delete_cascade_rest(spark, d):
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    kept, _ = C.delete_cascade({"lineitem": lines}, "o_orderkey", orders.where("o_orderkey % 10 = 3 OR o_orderstatus = 'F'"), confirm=True)
    return kept["lineitem"].select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer")
def update_by_key(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return C.updated(c, c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment")), "c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey <= 500 UNION ALL SELECT p_partkey, 'new ' || p_name FROM part WHERE p_partkey > 500 AND p_partkey % 2 = 0")
def get_or_create(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name")
    incoming = p.where("p_partkey % 2 = 0").withColumn("p_name", F.concat(F.lit("new "), "p_name"))
    return C.insert_absent(p.where("p_partkey <= 500"), incoming, "p_partkey")


@query(f"WITH c AS {CHUNKS_SQL} SELECT path, id FROM c JOIN (SELECT DISTINCT 'Part ' || label AS path FROM c UNION SELECT DISTINCT section_path FROM c) s ON section_path = path OR starts_with(section_path, path || ' > ')")
def section_prefix_join(spark, d):
    c = chunks(spark, d)
    sections = c.select(F.concat(F.lit("Part "), F.col("label")).alias("path")).union(c.select("section_path")).distinct()
    return C.prefix_join(sections, c.select("id", "section_path")).select("path", "id")


@query("""WITH t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, turn AS page, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations WHERE role = 'user')
 SELECT doc, idx, 'e' || idx AS title, string_agg(text, chr(10) ORDER BY c.turn) AS content FROM t JOIN conversations c ON c.conv_id = t.doc AND c.turn >= t.page AND c.turn < coalesce(upto, 1 << 30) GROUP BY doc, idx""")
def toc_page_ranges(spark, d):
    c = read(spark, d, "conversations")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    toc = c.where("role = 'user'").select(F.col("conv_id").alias("doc"), idx.alias("idx"), F.col("turn").alias("page")).withColumn("title", F.concat(F.lit("e"), "idx"))
    return C.page_ranges(toc, c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"))


@query("""WITH x AS (SELECT DISTINCT round(s_acctbal / 100, 1) AS x FROM supplier), g AS (SELECT x, coalesce((x - lag(x) OVER (ORDER BY x) >= 3.0)::INT, 0) AS new FROM x),
 k AS (SELECT x, sum(new) OVER (ORDER BY x)::BIGINT AS cluster FROM g) SELECT cluster, round(avg(x), 6) AS centre, count(*) AS n FROM k GROUP BY cluster""")
def position_clusters(spark, d):
    out = C.gap_clusters(read(spark, d, "supplier").select(F.round(F.col("s_acctbal") / 100, 1).alias("x")), 3.0)
    return out.withColumn("centre", F.round("centre", 6))


@query("""SELECT ts::DATE AS day, count(*) AS cycles, count(*) FILTER (event_type = 'click') AS user, count(*) FILTER (event_type = 'view') AS veille, count(*) FILTER (event_type NOT IN ('click', 'view')) AS autonomous,
 count(*) FILTER (event_type = 'purchase') AS verbalizations, round(avg(value) FILTER (event_type = 'purchase'), 6) AS verbalization_mean, count(*) FILTER (event_type = 'error') AS alerts,
 max(ts) FILTER (event_type = 'error') AS last_alert, round(avg(value), 6) AS delta_mean, max(value) AS delta_max FROM events GROUP BY 1""")
def daily_report(spark, d):
    out = M.daily_report(read(spark, d, "events"))
    return out.withColumns({c: F.round(c, 6) for c in ("verbalization_mean", "delta_mean")})


@query("""WITH l AS (SELECT max(ts)::DATE + 2 AS last FROM events), s AS (SELECT (last - i::INT) AS day FROM l, range(7) t(i)), c AS (SELECT ts::DATE AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)
 SELECT day, sum(coalesce(n, 0))::BIGINT AS cycles, round(sum(coalesce(n, 0)) / 7, 6) AS per_day, round(sum(coalesce(v, 0)), 4) AS value FROM s LEFT JOIN c USING (day) GROUP BY ROLLUP (day)""")
def weekly_summary(spark, d):
    e = read(spark, d, "events")
    last = e.agg(F.max("ts").alias("t")).head()["t"].date()
    out = M.weekly_summary(e, F.date_add(F.lit(last), 2))
    return out.select("day", "cycles", F.round("per_day", 6).alias("per_day"), F.round("value", 4).alias("value"))


_LEVELED = "(SELECT ts, CASE WHEN event_type = 'error' AND value > 100 THEN 'critical' WHEN event_type = 'error' THEN 'warning' ELSE 'ok' END AS level FROM events)"


def _leveled(spark, d):
    level = F.when((F.col("event_type") == "error") & (F.col("value") > 100), "critical").when(F.col("event_type") == "error", "warning").otherwise("ok")
    return read(spark, d, "events").select("ts", level.alias("level"))


@query(f"""WITH e AS {_LEVELED}, a AS (SELECT count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'warning') AS warning FROM e WHERE ts > (SELECT max(ts) FROM e) - INTERVAL 1 HOUR)
 SELECT critical, warning, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 2 THEN 'warning' ELSE 'healthy' END AS status FROM a""")
def health_status(spark, d):
    e = _leveled(spark, d)
    return M.health(e, F.lit(e.agg(F.max("ts").alias("t")).head()["t"]))


@query(f"SELECT level, count(*) AS n, max(ts) AS last FROM {_LEVELED} GROUP BY level")
def alert_counters(spark, d):
    return _leveled(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query("""WITH l AS (SELECT event_id AS occasion_id, event_type AS trigger, value AS ms, user_id % 100 AS tokens FROM events ORDER BY event_id DESC LIMIT 100)
 SELECT count(*) AS n, round(avg(ms), 6) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms, sum(tokens)::BIGINT AS tokens, (SELECT string_agg(trigger || '=' || c, ',' ORDER BY trigger) FROM (SELECT trigger, count(*) AS c FROM l GROUP BY 1)) AS by_trigger FROM l""")
def occasion_stats(spark, d):
    log = read(spark, d, "events").select(F.col("event_id").alias("occasion_id"), F.col("event_type").alias("trigger"), F.col("value").alias("ms"), (F.col("user_id") % 100).alias("tokens"))
    return M.occasion_statistics(log, 100).withColumn("mean_ms", F.round("mean_ms", 6))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_type <> 'click') AS autonomous, min(ts) AS first, datesub('second', min(ts), max(ts)) AS span_seconds FROM events GROUP BY event_type")
def trigger_distribution(spark, d):
    span = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") != "click").alias("autonomous"), F.min("ts").alias("first"), span.alias("span_seconds"))


@query("""WITH m AS (SELECT max(ts) AS t FROM events), i AS (SELECT event_id AS impact_id, ts FROM events WHERE event_type = 'error' AND user_id % 4 = 1 ORDER BY ts, event_id LIMIT 1)
 SELECT impact_id, ts, datediff('day', ts, t) AS age_days, datediff('day', ts, t) > 7 AS priority FROM i, m""")
def oldest_unresolved(spark, d):
    e = read(spark, d, "events")
    impacts = e.where("event_type = 'error'").select(F.col("event_id").alias("impact_id"), "ts", (F.col("user_id") % 4 != 1).alias("resolved"))
    return M.oldest_open(impacts, F.lit(e.agg(F.max("ts").alias("t")).head()["t"]))


@query("""SELECT model, round(sum(tokens * coalesce(per_million, 1.5)) / 1e6, 9) AS cost FROM (SELECT event_type AS model, user_id AS tokens FROM events) LEFT JOIN
 (VALUES ('click', 2.0), ('view', 0.25), ('error', 8.0)) p(model, per_million) USING (model) GROUP BY model""")
def model_costs(spark, d):
    usage = read(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens"))
    prices = spark.createDataFrame([("click", 2.0), ("view", 0.25), ("error", 8.0)], "model string, per_million double")
    return M.cost(usage, prices, 1.5).withColumn("cost", F.round("cost", 9))


@query("SELECT user_id AS job, count(*) AS files, count(*) FILTER (event_type <> 'error') AS completed, CASE WHEN count(*) FILTER (event_type <> 'error') = count(*) THEN 'complete' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'error' ELSE 'partial' END AS status FROM events GROUP BY user_id")
def job_status(spark, d):
    return M.job_status(read(spark, d, "events").select(F.col("user_id").alias("job"), (F.col("event_type") != "error").alias("ok")))


@query("""WITH r AS (SELECT conv_id, text, row_number() OVER w AS place, sum(length(text)) OVER w + 2 * (row_number() OVER w - 1) AS upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
 SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY place) AS joined, count(*) AS n FROM r WHERE upto <= 400 GROUP BY conv_id""")
def budgeted_context(spark, d):
    return M.within_budget(read(spark, d, "conversations"), "conv_id", [F.desc("turn")], "text", 400)


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def role_histogram(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_id, value, avg(value) OVER (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) IS NOT NULL AS in_ring FROM events ORDER BY event_id DESC LIMIT 100")
def ring_buffer(spark, d):
    return C.latest(read(spark, d, "events"), "event_id", 100, "event_id").select("event_id", "value", F.lit(True).alias("in_ring"))


@query("""SELECT doc_id, source, coalesce(max(doc_id) OVER (), -1) + 1 AS next_id FROM documents""")
def next_identifier(spark, d):
    docs = read(spark, d, "documents")
    top = docs.agg((F.coalesce(F.max("doc_id"), F.lit(-1)) + 1).alias("next_id"))
    return docs.select("doc_id", "source").crossJoin(F.broadcast(top))


@query("""SELECT conv_id, turn, lag(text) OVER w IS NOT NULL AS has_before, coalesce(array_to_string(string_split(lag(text) OVER w, ' ')[-5:], ' '), '') AS before, coalesce(array_to_string(string_split(lead(text) OVER w, ' ')[1:5], ' '), '') AS after
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda c: F.split(c, " ", -1)
    tail = lambda c: F.when(F.size(words(c)) > 5, F.slice(words(c), -5, 5)).otherwise(words(c))
    rows = read(spark, d, "conversations").withColumns({"p": F.lag("text").over(w), "n": F.lead("text").over(w)})
    return rows.select("conv_id", "turn", F.col("p").isNotNull().alias("has_before"), F.coalesce(F.array_join(tail(F.col("p")), " "), F.lit("")).alias("before"), F.coalesce(F.array_join(F.slice(words(F.col("n")), 1, 5), " "), F.lit("")).alias("after"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, list_last(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')) AS filename FROM pages")
def url_parts(spark, d):
    path = F.parse_url("url", F.lit("PATH"))
    return read(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"), F.element_at(F.split(path, "/", -1), -1).alias("filename"))
