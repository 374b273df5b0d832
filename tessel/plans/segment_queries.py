"""Queries over segmented texts and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import segment as G
from tessel.sources.tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _paragraphs(spark, d):
    return read(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query()
def paragraph_chunker(spark, d):
    return G.chunked(_paragraphs(spark, d), "doc_id", "text", G.paragraph_chunks, most=120, least=20)


@query()
def overlap_chunker(spark, d):
    return G.chunked(_paragraphs(spark, d), "doc_id", "text", G.overlap_chunks, most=150, least=20, overlap=30)


@query()
def speech_chunker(spark, d):
    return G.chunked(_paragraphs(spark, d), "doc_id", "text", G.spoken_chunks, most=80, least=10)


def _marked(spark, d):
    """Each line of a document becomes a heading or a body line by its number."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.repeat(F.lit("#"), (i / 3).cast("int") % 3 + 1), F.lit(" h"), i.cast("string"))).otherwise(F.trim(x)))
    return read(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
 m AS (SELECT doc_id, i, i % 3 = 1 AS head, CASE WHEN i % 3 = 1 THEN (i // 3) % 3 + 1 ELSE 0 END AS level, CASE WHEN i % 3 = 1 THEN 'h' || i END AS title, trim(x, ' ') AS x FROM l),
 s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM m)"""


@query(f"""WITH {_LINES} SELECT doc_id, section::BIGINT AS section, max(level)::INT AS level, max(title) AS title, coalesce(trim(string_agg(CASE WHEN NOT head THEN x END, chr(10) ORDER BY i), ' '), '') AS content FROM s GROUP BY doc_id, section
 HAVING section > 0 OR coalesce(trim(string_agg(CASE WHEN NOT head THEN x END, chr(10) ORDER BY i), ' '), '') <> ''""")
def heading_sections(spark, d):
    return G.heading_sections(_marked(spark, d), "doc_id", "text")


@query(f"""WITH RECURSIVE {_LINES}, h AS (SELECT doc_id, section, level, title FROM s WHERE head),
 p AS (SELECT a.doc_id, a.section, a.level, a.title, (SELECT max(b.section) FROM h b WHERE b.doc_id = a.doc_id AND b.section < a.section AND b.level < a.level) AS up FROM h a),
 t AS (SELECT doc_id, section, title AS path, NULL::VARCHAR AS parent FROM p WHERE up IS NULL UNION ALL SELECT p.doc_id, p.section, t.path || ' > ' || p.title, list_last(string_split(t.path, ' > ')) FROM p JOIN t ON p.doc_id = t.doc_id AND p.up = t.section)
 SELECT doc_id, section::BIGINT AS section, path, parent FROM t""")
def heading_paths(spark, d):
    rows = G.heading_sections(_marked(spark, d), "doc_id", "text").where("level > 0")
    return G.with_paths(rows, "doc_id", "section").select("doc_id", "section", "path", "parent")


@query()
def section_numbers(spark, d):
    rows = G.heading_sections(_marked(spark, d), "doc_id", "text").where("level > 0")
    return G.with_paths(rows, "doc_id", "section").select("doc_id", "section", "number")


@query("""WITH e AS (SELECT c_custkey AS k, unnest([1, 2, 3]) AS i FROM customer) SELECT k, i::INT AS line_no, 'Entry ' || k || ' ' || i AS title, (k + i)::INT AS page, i::INT AS level FROM e""")
def toc_lines(spark, d):
    k = F.col("c_custkey").cast("string")
    entry = lambda pad, i: F.concat(F.lit(pad + "Entry "), k, F.lit(f" {i} ..... "), (F.col("c_custkey") + i).cast("string"))
    text = F.concat_ws("\n", F.lit("Contents"), entry("", 1), entry("  ", 2), entry("    ", 3), F.lit("12 ..... 4"), F.lit("plain line"))
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), text.alias("text"))
    return G.toc_lines(rows, "k", "text").select("k", "line_no", "title", "page", "level")


_TOC = "(SELECT n_nationkey AS idx, lower(n_name) AS t_title, n_nationkey * 2 AS t_number, n_nationkey % 3 + 1 AS level, n_nationkey * 10 AS t_place FROM nation)"


@query(f"""SELECT chunk_id, idx, rule FROM (SELECT s_suppkey AS chunk_id, idx, CASE WHEN title = t_title THEN 1 WHEN number = t_number AND level = 2 THEN 2 ELSE 3 END AS rule,
 row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE WHEN title = t_title THEN 1 WHEN number = t_number AND level = 2 THEN 2 ELSE 3 END, CASE WHEN NOT coalesce(title = t_title, false) AND NOT (number = t_number AND level = 2) THEN abs(place - t_place) ELSE 0 END, idx) AS rn
 FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN lower(n_name) ELSE 'x' END AS title, s_suppkey % 60 AS number, s_suppkey % 250 AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey), {_TOC}) WHERE rn = 1""")
def toc_matching(spark, d):
    nation = read(spark, d, "nation")
    toc = nation.select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("title"), (F.col("n_nationkey") * 2).alias("number"), (F.col("n_nationkey") % 3 + 1).alias("level"), (F.col("n_nationkey") * 10).alias("place"))
    s = read(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    chunks = s.select(F.col("s_suppkey").alias("chunk_id"), F.when(F.col("s_suppkey") % 4 == 0, F.col("n_name")).otherwise("x").alias("title"), (F.col("s_suppkey") % 60).alias("number"), (F.col("s_suppkey") % 250).alias("place"))
    return G.match_toc(chunks, toc)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN 'r' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS reference FROM conversations")
def carried_reference(spark, d):
    ref = F.when(F.col("role") == "user", F.concat(F.lit("r"), "turn"))
    return read(spark, d, "conversations").select("conv_id", "turn", G.carried(ref, "conv_id", "turn").alias("reference"))
