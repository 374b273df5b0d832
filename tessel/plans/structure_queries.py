"""Queries of trees and contents, of model chunking, and of collections that are written and verified."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import vector as V
from tessel.operators import chunking as K
from tessel.operators import contents as C
from tessel.operators import segment as G
from tessel.plans import providers as P
from tessel.plans.pipeline_queries import scratch
from tessel.plans.state_queries import _PROFILE, _profile
from tessel.sources import store as W
from tessel.sources.tables import TENSOR_SQL, read, tensor

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: How deep each line of seven stands in the boxes of layout_contents.
_DEPTHS = [0, 1, 2, 2, 1, 0, 2]


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
 e AS (SELECT doc_id, i, trim('h' || i || ' ' || regexp_replace(string_split(x, ' ')[1], '[^A-Za-z]', '', 'g')) AS title, {_DEPTHS}[i % 7 + 1] AS k FROM l WHERE i < 160),
 p AS (SELECT *, max(CASE WHEN k < 1 THEN i END) OVER w AS p1, max(CASE WHEN k < 2 THEN i END) OVER w AS p2 FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 q AS (SELECT *, CASE k WHEN 1 THEN p1 WHEN 2 THEN p2 END AS up FROM p)
 SELECT q.doc_id, q.i AS nth, q.title, (q.i + 1)::INT AS page_number, (q.k + 1)::INT AS level, a.title AS parent_title, coalesce(b.title || ' > ', '') || coalesce(a.title || ' > ', '') || q.title AS path
 FROM q LEFT JOIN q a ON a.doc_id = q.doc_id AND a.i = q.up LEFT JOIN q b ON b.doc_id = q.doc_id AND b.i = a.up""")
def layout_contents(spark, d):
    """Contents from boxes: each document's lines laid out as entries, four boxes a line, indented by depth, with noise."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i = F.col("i")
    depth = F.get(F.array(*map(F.lit, _DEPTHS)), i % 7)
    left = 0.08 + 0.07 * depth + (i * 7 % 9) / 1000.0
    word = F.regexp_replace(F.get(F.split("line", " ", -1), F.lit(0)), "[^A-Za-z]", "")
    parts = F.array(F.concat(F.lit("h"), i.cast("string")), word, F.lit("....."), (i + 1).cast("string"))
    boxes = lines.select("doc_id", (F.floor(i / 20) + 1).alias("page"), F.explode(F.transform(parts, lambda t, j: F.struct((left + 0.1 * j).alias("x"), ((i % 20) * 0.04 + (j % 2) * 0.003).alias("y"), t.alias("text")))).alias("b"))
    return C.contents_from_layout(boxes.select("doc_id", "page", "b.*"), "doc_id")


_TREE_SQL = """WITH n AS (SELECT c_custkey, NULL::BIGINT AS o, NULL::BIGINT AS l, 'C' || c_custkey AS title, 1 AS level, 'C' || c_custkey AS path FROM customer
 UNION ALL SELECT o_custkey, o_orderkey, NULL, 'O' || o_orderkey, 2, 'C' || o_custkey || ' > O' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
 UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, 'L' || l_linenumber, 3, 'C' || o_custkey || ' > O' || o_orderkey || ' > L' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)
 SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o NULLS FIRST, l NULLS FIRST) - 1 AS nth, path AS section_path, title, level::INT AS level,
 CASE WHEN title = 'L1' AND c_custkey % 2 = 0 THEN 'first lines of ' || c_custkey WHEN level = 2 AND o % 3 = 0 THEN 'order ' || o ELSE title END AS text FROM n"""


@query(_TREE_SQL)
def summary_ingestion(spark, d):
    """Summaries of contents trees: customers over their orders over their lines, as JSON; equal titles stand under different parents."""
    node = lambda title, level, children=None: F.struct(title.alias("title"), F.lit(level).alias("level"), *([children.alias("children")] if children is not None else []))
    mark = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"])
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(ordered("l_linenumber", node(mark("L", "l_linenumber"), 3)).alias("lines"))
    orders = read(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    held = orders.groupBy("o_custkey").agg(ordered("o_orderkey", node(mark("O", "o_orderkey"), 2, F.col("lines"))).alias("orders"))
    trees = read(spark, d, "customer").join(held, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.to_json(F.array(node(mark("C", "c_custkey"), 1, F.col("orders")))).alias("tree"))
    said = read(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.lit("L1").alias("title"), F.concat(F.lit("first lines of "), F.col("c_custkey").cast("string")).alias("summary"))
    more = read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), mark("O", "o_orderkey").alias("title"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("summary"))
    return C.summary_rows(trees, "c_custkey", "tree", said.unionByName(more)).select("c_custkey", "nth", "section_path", "title", "level", "text")


@query("""WITH t AS (SELECT doc_id * 2 AS idx, 'Papers: CP ' || (doc_id % 8 + 1) || '.' || (doc_id // 8) AS title, 1 AS level, lang FROM documents
 UNION ALL SELECT doc_id * 2 + 1, (doc_id // 8) || '. ' || left(text, 60), CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END, lang FROM documents),
 n AS (SELECT *, lower(lead(title) OVER (ORDER BY idx)) AS said, lead(level) OVER (ORDER BY idx) AS below FROM t),
 v AS (SELECT idx, regexp_extract(title, 'CP\\s+(\\d+)\\.', 1)::INT AS volume, regexp_extract(title, 'CP\\s+\\d+\\.(\\d+)', 1)::INT AS paragraph, said FROM n WHERE regexp_matches(title, 'Papers: CP\\s+\\d+\\.\\d+\\b') AND below = 2),
 q AS (SELECT doc_id AS lookup_id, (doc_id // 8)::INT AS paragraph, list_filter(regexp_split_to_array(lower(trim(left(text, 40))), '\\s+'), lambda w: length(w) > 3)[1] AS word FROM documents)
 SELECT lookup_id, arg_min(volume, idx) AS volume FROM q LEFT JOIN v ON v.paragraph = q.paragraph AND contains(said, word) GROUP BY lookup_id""".replace("\\\\", "\\"))
def volume_lookup(spark, d):
    """The volume of each document's first words, by contents lines that name a paragraph and the lines after them."""
    docs = read(spark, d, "documents")
    whole = lambda c: F.floor(c).cast("string")
    heads = docs.select((F.col("doc_id") * 2).alias("idx"), F.concat(F.lit("Papers: CP "), whole(F.col("doc_id") % 8 + 1), F.lit("."), whole(F.col("doc_id") / 8)).alias("title"), F.lit(1).alias("level"))
    bodies = docs.select((F.col("doc_id") * 2 + 1).alias("idx"), F.concat(whole(F.col("doc_id") / 8), F.lit(". "), F.substring("text", 1, 60)).alias("title"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(2).alias("level"))
    # documents of a thousand numbers are a work of their own, which keeps windows apart; no entry's next line lies in another
    work = lambda df: df.withColumn("work", F.floor(F.col("idx") / 2000))
    lookups = docs.select(F.col("doc_id").alias("lookup_id"), F.floor(F.col("doc_id") / 8).cast("int").alias("paragraph"), F.substring("text", 1, 40).alias("snippet"), F.floor(F.col("doc_id") / 1000).alias("work"))
    return C.volume_of(lookups, work(heads.unionByName(bodies)), r"Papers: CP", "work")


@query("SELECT doc_id, (length(text) // 4)::INT AS tokens, length(text) // 4 <= 2500 AS fits FROM documents")
def token_size_check(spark, d):
    return read(spark, d, "documents").select("doc_id", K.estimated_tokens(F.col("text")).alias("tokens"), K.fits(F.col("text")).alias("fits"))


@query()
def model_chunking(spark, d):
    """Chunks of every document by the offline model, or by the fallback where its answer does not fit."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"))
    out = K.model_chunks(docs, ["doc_id"], "text", "title", K.paragraph_answer, target=120)
    return out.select("doc_id", "chunk_no", "start", F.length("text").alias("n_chars"), "origin", K.fits(F.col("text")).alias("fits"), "paragraph")


@query()
def chunk_artefacts(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    chunks = G.chunked(read(spark, d, "documents"), "doc_id", "text", G.paragraph_chunks, most=200, least=1)
    return W.chunk_artefacts(docs, chunks, "doc_id").select("doc_id", "file", F.json_array_length(F.get_json_object("value", "$.chunks")).alias("n_chunks"))


@query("SELECT lang, count(*) AS n, 64::INT AS width, 3::BIGINT AS versions FROM documents GROUP BY lang")
def reembedding_migration(spark, d):
    """Documents stored without vectors, given vectors by a migration that is verified before it counts."""
    store = W.Store(spark, scratch(spark))
    docs = read(spark, d, "documents").select("doc_id", "lang", "text")
    store.create("chunks", docs.schema, "doc_id")
    store.insert("chunks", docs)

    def search_holds(_, new):
        probe = new.where("length(trim(text)) > 0").orderBy("doc_id").limit(1).select(F.col("vector").alias("q"), F.col("text").alias("asked"))
        best = new.crossJoin(F.broadcast(probe)).select(V.cosine(F.col("vector"), F.col("q")).alias("s"), (F.col("text") == F.col("asked")).alias("same"))
        row = best.agg(F.max_by("same", F.struct("s", "same")).alias("same")).head()
        return row["same"] is not False

    widths = lambda _, new: new.where("vector IS NULL OR size(vector) <> 64").isEmpty()
    store.migrate("chunks", lambda old: P.embedded(old), {"vectors of one width": widths, "a search finds the text it asks for": search_holds})
    n = len(store.versions("chunks"))
    return store.read("chunks").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).withColumn("versions", F.lit(n).cast("long"))


@query(f"SELECT state_id, count(*) AS dims, round(sum(v[1]), 6) AS first FROM {TENSOR_SQL} GROUP BY state_id")
def state_inserts(spark, d):
    """State tensors inserted by key, half of them twice: the second insertion adds only what is not there."""
    store = W.Store(spark, scratch(spark))
    states = tensor(spark, d).groupBy("state_id").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("dims"))
    store.create("state_tensor", states.schema, "state_id")
    store.insert("state_tensor", states.where("state_id % 2 = 0"))
    store.insert("state_tensor", states, existing="skip")
    rows = store.read("state_tensor").select("state_id", F.explode("dims").alias("x"))
    return rows.groupBy("state_id").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sum(F.col("x.v")[0]), 6).alias("first"))


@query(f"""WITH p AS {_PROFILE}, m AS (SELECT state_id, avg(value) AS mean, count(*) AS n FROM p GROUP BY state_id),
 x AS (SELECT a.state_id, max(abs(a.value - b.value)) AS moved FROM p a JOIN p b ON a.name = b.name AND b.state_id = a.state_id - 1 GROUP BY a.state_id)
 SELECT a.state_id AS occasion_id, 'occasion_' || lpad(a.state_id::VARCHAR, 6, '0') || '.json' AS file, a.state_id - 1 AS previous_state_id, round(b.mean, 6) AS mean_before, round(a.mean, 6) AS mean_after, round(moved, 6) AS moved, a.n AS directions
 FROM m a JOIN m b ON b.state_id = a.state_id - 1 JOIN x ON x.state_id = a.state_id""")
def occasion_cycle(spark, d):
    """Occasions from state to state, each with its profile before and after, logged once though the batch is played twice."""
    p = _profile(spark, d).select("state_id", "name", "value")
    before = p.select((F.col("state_id") + 1).alias("state_id"), "name", F.col("value").alias("was"))
    both = p.join(before, ["state_id", "name"])
    occasions = both.groupBy(F.col("state_id").alias("occasion_id")).agg(
        (F.first("state_id") - 1).alias("previous_state_id"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "was")))).alias("profile_before"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("profile_after")
    )
    store = W.Store(spark, scratch(spark))
    W.log_occasions(store, occasions)
    W.log_occasions(store, occasions)
    log = store.read("occasions").withColumn("o", F.from_json("value", "previous_state_id bigint, profile_before map<string,double>, profile_after map<string,double>"))
    mean = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x) / F.size(m)
    a, b = F.col("o.profile_before"), F.col("o.profile_after")
    moved = F.array_max(F.transform(F.map_keys(b), lambda k: F.abs(b[k] - a[k])))
    return log.select("occasion_id", "file", "o.previous_state_id", F.round(mean(a), 6).alias("mean_before"), F.round(mean(b), 6).alias("mean_after"), F.round(moved, 6).alias("moved"), F.size(b).cast("long").alias("directions"))
