"""Queries over text columns and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.sources.tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return read(spark, d, "documents")


@query(r"""WITH t AS (SELECT doc_id, '  <!-- Page ' || doc_id || ' -->' || replace(text, '. ', chr(10) || '12' || chr(10) || chr(10) || chr(10) || chr(10)) AS t FROM documents)
 SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '<!--\s*Page\s+\d+\s*-->', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM t""")
def page_marks(spark, d):
    t = F.concat(F.lit("  <!-- Page "), "doc_id", F.lit(" -->"), F.replace(F.col("text"), F.lit(". "), F.lit("\n12\n\n\n\n")))
    return docs(spark, d).select("doc_id", T.without_page_marks(t).alias("cleaned"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || '12' || chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(text, '. ', chr(10) || '12' || chr(10)), chr(10)), 1) AS i FROM documents),
 k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM l WHERE NOT regexp_matches(x, '^\d{1,4}\s*$') AND (length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 3 OR starts_with(x, '#') OR regexp_replace(x, '^\s+|\s+$', '', 'g') = '') GROUP BY 1)
 SELECT doc_id, coalesce(length(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')), 0) AS n FROM documents LEFT JOIN k USING (doc_id)""")
def ocr_noise(spark, d):
    t = F.replace(F.col("text"), F.lit(". "), F.lit("\n12\n"))
    return docs(spark, d).select("doc_id", F.length(T.without_ocr_noise(t)).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words FROM documents")
def shorten_and_count(spark, d):
    return docs(spark, d).select("doc_id", T.shortened(F.col("text"), 100).alias("short"), T.word_count(F.col("text")).cast("long").alias("n_words"))


@query(r"""WITH m AS (SELECT doc_id, '# ' || left(text, 30) || chr(10) || '**bold ' || doc_id || '** and *it* `code` [link](http://x) ' || chr(10) || '> quote' || chr(10) || '- item' || chr(10) || '---' AS t FROM documents)
 SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '`([^`]*)`', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^>\s?', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^-{3,}$', '', 'g'), '\s+', ' ', 'g') AS raw FROM m""")
def markdown_to_text(spark, d):
    t = F.concat(F.lit("# "), F.substring("text", 1, 30), F.lit("\n**bold "), "doc_id", F.lit("** and *it* `code` [link](http://x) \n> quote\n- item\n---"))
    return docs(spark, d).select("doc_id", F.concat(T.without_markdown(t), F.lit(" ")).alias("raw"))


@query("""SELECT doc_id, array_to_string(list_filter(['je pense que', 'il me semble', 'logiquement'], lambda m: contains(lower(t), m)), ',') AS found FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Logiquement, il me semble. ' || text WHEN 1 THEN text || ' Je pense que oui' ELSE text END AS t FROM documents)""")
def text_markers(spark, d):
    m = F.col("doc_id") % 3
    t = F.when(m == 0, F.concat(F.lit("Logiquement, il me semble. "), "text")).when(m == 1, F.concat("text", F.lit(" Je pense que oui"))).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", F.array_join(T.markers(t, T.REASONING_MARKERS), ",").alias("found"))


@query(r"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '§ CP 5.' || doc_id || '. ' || source WHEN 1 THEN doc_id || 'a. ' || source WHEN 2 THEN source || ' > ' || lang ELSE '§' || doc_id || '. text' END AS path FROM documents)
 SELECT doc_id, nullif(regexp_extract(path, '^(?:§\s*)?(CP\s+[\d.]+|\d+[a-z]?)\.\s', 1), '') AS reference FROM p""")
def canonical_references(spark, d):
    m = F.col("doc_id") % 4
    path = F.when(m == 0, F.concat(F.lit("§ CP 5."), "doc_id", F.lit(". "), "source")).when(m == 1, F.concat("doc_id", F.lit("a. "), "source")).when(m == 2, F.concat("source", F.lit(" > "), "lang")).otherwise(F.concat(F.lit("§"), "doc_id", F.lit(". text")))
    return docs(spark, d).select("doc_id", T.canonical_reference(path).alias("reference"))


@query(r"""WITH h AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '§ ' || doc_id || ' On' WHEN 1 THEN doc_id || ' On' WHEN 2 THEN doc_id || 'Dans' WHEN 3 THEN '[' || doc_id || '] x' WHEN 4 THEN doc_id || ') x' WHEN 5 THEN doc_id || 'a. x' WHEN 6 THEN 'CP 5.' || doc_id || '. x' ELSE 'none ' || doc_id END AS h FROM documents)
 SELECT doc_id, coalesce(nullif(regexp_extract(h, '^(\d+)\s+[A-ZÀ-Ü]', 1), ''), nullif(regexp_extract(h, '^(\d+)[A-ZÀ-Ü]', 1), ''), nullif(regexp_extract(h, '^§\s*(\d+)', 1), ''), nullif(regexp_extract(h, '^\[(\d+)\]', 1), ''), nullif(regexp_extract(h, '^(\d+)\.', 1), ''), nullif(regexp_extract(h, '^(\d+)\)', 1), ''))::INT AS number,
 coalesce(nullif(regexp_extract(h, '^(\d+[a-z]?)\.\s', 1), ''), nullif(regexp_extract(h, '^§\s*(\d+[a-z]?)\s', 1), ''), nullif(regexp_extract(h, '^CP\s+\d+\.(\d+)\.\s', 1), '')) AS heading FROM h""")
def paragraph_numbers(spark, d):
    m, i = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    h = F.when(m == 0, F.concat(F.lit("§ "), i, F.lit(" On"))).when(m == 1, F.concat(i, F.lit(" On"))).when(m == 2, F.concat(i, F.lit("Dans"))).when(m == 3, F.concat(F.lit("["), i, F.lit("] x"))).when(m == 4, F.concat(i, F.lit(") x"))).when(m == 5, F.concat(i, F.lit("a. x"))).when(m == 6, F.concat(F.lit("CP 5."), i, F.lit(". x"))).otherwise(F.concat(F.lit("none "), i))
    return docs(spark, d).select("doc_id", T.paragraph_number(h).alias("number"), T.heading_number(h).alias("heading"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)\s*\([^)]*(?:correct|à confirmer|possiblement|probablement)[^)]*\)\s*$', ''), '(?i)\s*\((?:correct|à confirmer)\)\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') AS name FROM (
 SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ' (à confirmer)' WHEN 1 THEN source || ' (Correct) ' || lang WHEN 2 THEN source || ' (très probablement) ' ELSE source || ' (1807)' END AS t FROM documents)""")
def annotations(spark, d):
    m = F.col("doc_id") % 4
    t = F.when(m == 0, F.concat("source", F.lit(" (à confirmer)"))).when(m == 1, F.concat("source", F.lit(" (Correct) "), "lang")).when(m == 2, F.concat("source", F.lit(" (très probablement) "))).otherwise(F.concat("source", F.lit(" (1807)")))
    return docs(spark, d).select("doc_id", T.without_annotations(t).alias("name"))


@query("SELECT p_partkey, (p_partkey % 3999 + 1)::INT AS value FROM part")
def roman_numerals(spark, d):
    def numeral(n):
        text = F.lit("")
        for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            text, n = F.concat(text, F.repeat(F.lit(s), F.floor(n / v).cast("int"))), n % v
        return text

    return read(spark, d, "part").select("p_partkey", T.roman(numeral(F.col("p_partkey") % 3999 + 1)).alias("value"))


@query(r"""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def json_from_answers(spark, d):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure: <JSON>\n"), "props", F.lit("\n</JSON> done"))).otherwise(F.concat(F.lit("Answer "), "props"))
    return read(spark, d, "events").select("event_id", F.get_json_object(T.json_block(wrapped), "$.k").try_cast("int").alias("k"))


@query("SELECT event_id, array_to_string([event_type, 'b' || event_id % 3, 'c', 'd', 'e'], '|') AS items FROM events")
def json_lists(spark, d):
    t = F.concat(F.lit('text ["'), "event_type", F.lit('", "b'), F.col("event_id") % 3, F.lit('", "c", "d", "e", "f", "g"] more'))
    return read(spark, d, "events").select("event_id", F.array_join(T.json_list(t), "|").alias("items"))


@query("""SELECT doc_id, CASE WHEN lower(trim(v)) NOT IN ('', 'null', 'none') THEN v END AS value, coalesce(TRY_CAST(v AS INT), -1) AS number FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN ' null ' ELSE 'abc' END AS v FROM documents)""")
def safe_coercion(spark, d):
    m = F.col("doc_id") % 5
    v = F.when(m == 0, "").when(m == 1, "None").when(m == 2, F.col("doc_id").cast("string")).when(m == 3, " null ").otherwise("abc")
    return docs(spark, d).select("doc_id", T.blank_to_null(v).alias("value"), T.safe_int(v, -1).alias("number"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN TIMESTAMP '2024-02-01' - to_days((event_id % 30)::INT) WHEN 1 THEN TIMESTAMP '2024-02-01' - to_hours((event_id % 30)::INT) WHEN 2 THEN TIMESTAMP '2024-02-01' - to_days((event_id % 30)::INT * 7)
 WHEN 3 THEN TIMESTAMP '2024-02-01' - to_minutes((event_id % 30)::INT) ELSE NULL END AS since FROM events""")
def relative_times(spark, d):
    n = (F.col("event_id") % 30).cast("string")
    m = F.col("event_id") % 5
    t = F.when(m == 0, F.concat(n, F.lit("d"))).when(m == 1, F.concat(n, F.lit("h"))).when(m == 2, F.concat(n, F.lit("w"))).when(m == 3, F.concat(n, F.lit("m"))).otherwise("soon")
    return read(spark, d, "events").select("event_id", T.relative_time(t, F.lit("2024-02-01").cast("timestamp")).alias("since"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(bearer\s+)[\w-]{20,}', '\1***REDACTED***', 'g'), '(?i)(password\s*[=:]\s*)["'']?[^\s"'']+["'']?', '\1***REDACTED***', 'g'), '(?i)(secret\s*[=:]\s*)["'']?[\w-]+["'']?', '\1***REDACTED***', 'g'), '(?i)(token\s*[=:]\s*)["'']?[\w-]{20,}["'']?', '\1***REDACTED***', 'g') AS t
 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' password: "p' || doc_id || '"' WHEN 1 THEN text || ' Bearer abcdefghij' || (doc_id + 1000000000) WHEN 2 THEN text || ' secret=s' || doc_id ELSE text END AS t FROM documents)""")
def redaction(spark, d):
    m = F.col("doc_id") % 4
    t = F.when(m == 0, F.concat("text", F.lit(' password: "p'), "doc_id", F.lit('"'))).when(m == 1, F.concat("text", F.lit(" Bearer abcdefghij"), F.col("doc_id") + 1000000000)).when(m == 2, F.concat("text", F.lit(" secret=s"), "doc_id")).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", T.redacted(t).alias("t"))


@query(r"""SELECT doc_id, length(t) >= 60 AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) >= 12 AND NOT regexp_matches(t, '(?i)^(?:https?://|\d{4}-\d{2}-\d{2}$|ISBN|DOI|©)') AS valid FROM (
 SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN doc_id % 9 = 0 THEN 'isbn ' || text ELSE text END, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def chunk_validity(spark, d):
    t = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("isbn "), "text")).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", T.valid_chunk(t, 60, 12).alias("valid"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
 SELECT doc_id, doc_id % 11 = 0 OR doc_id % 13 = 0 OR (len(l) >= 5 AND list_sum(list_transform(l, lambda x: length(x))) / greatest(len(l), 1) < 50 AND list_bool_and(list_transform(l[1:10], lambda x: length(x) < 100))
 AND (len(list_filter(l[1:10], lambda x: regexp_matches(x, '(?i)^(?:comment\s+.+\?|où\s+.+|les?\s+[\p{L}\p{N}_]+\s+à\s+|que\s+.+\?|l[ae]\s+[\p{L}\p{N}_]+\s+(?:de|du)\s+|entre\s+.+\s+et\s+)'))) >= len(l) * 0.4
 OR NOT list_bool_or(list_transform(l[1:5], lambda x: regexp_matches(x, '(?i)(?:^|[^\p{L}\p{N}_])(?:est|sont|était|sera|a|ont|avait|avaient|fait|dit|pense|explique)(?:[^\p{L}\p{N}_]|$)'))))) AS excluded FROM l""")
def excluded_sections(spark, d):
    title = F.when(F.col("doc_id") % 11 == 0, " Table of Contents ").otherwise("Chapter one")
    chapter = F.when(F.col("doc_id") % 13 == 0, "Mentions légales")
    return docs(spark, d).select("doc_id", T.excluded_section(title, F.col("text"), chapter).alias("excluded"))


@query("""SELECT conv_id, turn, role IN ('test', 'debug', 'example') OR length(text) < 20 OR list_bool_or(list_transform(['test', 'debug', 'todo', 'fixme', 'xxx', 'lorem ipsum', 'example', 'placeholder'], lambda x: contains(lower(text), x))) AS is_test,
 role = 'assistant' AND length(text) >= 50 AND NOT starts_with(text, '[Error') AND NOT starts_with(text, '[System') AS usable FROM conversations""")
def message_filters(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", T.test_content(F.col("role"), F.col("text")).alias("is_test"), T.usable_answer(F.col("role"), F.col("text")).alias("usable"))


@query(r"""WITH q AS (SELECT conv_id, turn, lower(regexp_replace(left(text, (conv_id % 15)::INT), '^\s+|\s+$', '', 'g')) AS q FROM conversations)
 SELECT conv_id, turn, length(q) >= 15 OR list_bool_or(list_transform(['et', 'ou', 'mais', 'donc', 'car', 'parce que', 'puisque', 'si'], lambda c: contains(' ' || q || ' ', ' ' || c || ' ')))
 OR len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: length(w) > 2 AND w NOT IN ('le', 'la', 'les', 'un', 'une', 'des', 'du', 'de', 'd', 'ce', 'cette', 'ces', 'mon', 'ma', 'mes', 'ton', 'ta', 'tes', 'à', 'au', 'aux', 'dans', 'sur', 'pour', 'par', 'avec', 'que', 'qui', 'quoi', 'dont', 'où', 'est', 'sont', 'a', 'qu', 'c', 'l', 's', 'n', 'm', 't', 'j', 'y'))) >= 2 AS hierarchical FROM q""")
def query_router(spark, d):
    q = F.substring(F.col("text"), F.lit(1), (F.col("conv_id") % 15).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.needs_hierarchy(q).alias("hierarchical"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(source) = '' THEN 'title' END, CASE WHEN lang IN ('es') THEN 'language' END, CASE WHEN doc_id % 7 = 0 OR false THEN 'author' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents""")
def metadata_validation(spark, d):
    author = F.when(F.col("doc_id") % 7 != 0, F.lit("someone"))
    found = T.errors(title=F.trim("source") != "", language=F.col("lang") != "es", author=F.trim(author) != "")
    return docs(spark, d).select("doc_id", F.array_join(found, ",").alias("errors"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name || '.txt' ELSE p_name END AS name FROM part")
def document_names(spark, d):
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".pdf").when(F.col("p_partkey") % 3 == 1, ".MD").otherwise(".txt")
    return read(spark, d, "part").select("p_partkey", T.document_name(F.concat("p_name", suffix)).alias("name"))


@query("""SELECT conv_id, string_agg('[' || place || '] ' || CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END, chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || 'Question: why' AS prompt
 FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) GROUP BY conv_id""")
def prompt_assembly(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["text"]).alias("passages"))
    return g.select("conv_id", T.numbered_prompt(F.col("passages"), F.lit("why"), 50).alias("prompt"))


@query("SELECT event_id, CASE WHEN value < 0 THEN '-' ELSE '+' END || rpad(repeat('#', least(10, round(abs(value / 100) * 10)::INT)), 10, '.') AS bar FROM events")
def value_bars(spark, d):
    from tessel.operators.state import bar

    return read(spark, d, "events").select("event_id", bar(F.col("value") / 100).alias("bar"))
