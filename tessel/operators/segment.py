"""Segmentation: chunkers, heading trees, tables of contents.

Order-dependent packing runs in Arrow batches, a document at a time; everything that is a
running or nearest-row computation stays in windows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _n(text: str) -> int:
    return len(text.split())


def paragraph_chunks(text: str | None, most: int = 500, least: int = 100) -> list[str]:
    """Paragraphs packed greedily up to `most` words.

    A paragraph that is longer alone is packed by sentences, which a blank line then joins
    like paragraphs; its tail stays open for what follows. Chunks under `least` words go
    unless there is only one.
    """
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            out.append("\n\n".join(held))
            held.clear()
            size = 0

    for paragraph in re.split(r"\n\s*\n", text or ""):
        if not (paragraph := paragraph.strip()):
            continue
        units = [paragraph] if _n(paragraph) <= most else _SENTENCE.split(paragraph)
        if len(units) > 1:
            close()
        for unit in units:
            if held and size + _n(unit) > most:
                close()
            held.append(unit)
            size += _n(unit)
    close()
    return out if len(out) == 1 else [c for c in out if _n(c) >= least]


def overlap_chunks(text: str | None, most: int = 1000, least: int = 100, overlap: int = 100) -> list[str]:
    """Sentences packed up to `most` words; each chunk starts with the last whole sentences of the one before, up to `overlap` words.

    With more than one chunk, those under `least` words go, even all.
    """
    out: list[str] = []
    held: list[str] = []
    fresh = 0
    for sentence in (s for s in _SENTENCE.split((text or "").strip()) if s):
        if fresh and sum(map(_n, held)) + _n(sentence) > most:
            out.append(" ".join(held))
            tail: list[str] = []
            for s in reversed(held):
                if sum(map(_n, tail)) + _n(s) > overlap:
                    break
                tail.insert(0, s)
            held, fresh = tail, 0
        held.append(sentence)
        fresh += 1
    if fresh:
        out.append(" ".join(held))
    return out if len(out) <= 1 else [c for c in out if _n(c) >= least]


def spoken_chunks(text: str | None, most: int = 400, least: int = 30) -> list[str]:
    """Sentences packed up to `most` words for speech; one over 1.3 times that is split at commas; a short last chunk joins the one before."""
    out: list[str] = []
    held = ""
    for sentence in (s for s in _SENTENCE.split((text or "").strip()) if s):
        for part in [sentence] if _n(sentence) <= 1.3 * most else re.split(r"(?<=,)\s+", sentence):
            if held and _n(held) + _n(part) > most:
                out.append(held)
                held = part
            else:
                held = f"{held} {part}".strip()
    if held:
        if out and _n(held) < least:
            out[-1] = f"{out[-1]} {held}"
        else:
            out.append(held)
    return out


def chunked(df: DataFrame, key: str, text: str, chunker=paragraph_chunks, **options) -> DataFrame:
    """(key, chunk_no, chunk_id, chunk) of every row's text; a text without chunks gives no rows."""

    def run(batches):
        for batch in batches:
            ids, numbers, chunks = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, c in enumerate(chunker(t, **options)):
                    ids.append(k)
                    numbers.append(i)
                    chunks.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], names=[key, "chunk_no", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_no int, chunk string")
    return out.withColumn("chunk_id", F.format_string("chunk_%05d", F.col("chunk_no")))


def heading_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of markdown: (key, section, level, title, content); section 0 is the preamble (level 0)."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    head = F.col("line").rlike(r"^#{1,6}\s+\S")
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", head).withColumn("section", F.sum(head.cast("int")).over(run))
    ordered = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line"))))
    out = rows.groupBy(key, "section").agg(
        F.max(F.when(F.col("head"), F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)))).alias("level"),
        F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))).alias("title"),
        F.trim(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("content"),
    )
    return out.withColumn("level", F.coalesce("level", F.lit(0))).where((F.col("section") > 0) | (F.col("content") != ""))


def with_paths(rows: DataFrame, key: str, order: str, separator: str = " > ") -> DataFrame:
    """Adds each heading's ancestors (path), parent title and section number.

    rows: key, order, level, title in reading order. An ancestor at level k is the last
    heading of that level after the last one of a lower level; windows carry both, so
    headings of a document need not meet in one array.
    """
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for k in range(1, 7):
        here = F.col("level") == k
        out = out.withColumn(f"_t{k}", F.last(F.when(here, F.col("title")), True).over(run))
        out = out.withColumn(f"_p{k}", F.last(F.when(here, F.col(order)), True).over(run))
        out = out.withColumn(f"_b{k}", F.last(F.when(F.col("level").between(1, k - 1), F.col(order)), True).over(run))
    valid = lambda k: F.col(f"_p{k}").isNotNull() & (F.col(f"_b{k}").isNull() | (F.col(f"_p{k}") > F.col(f"_b{k}"))) & (F.col("level") >= k)
    titles = F.filter(F.array(*[F.when(valid(k), F.col(f"_t{k}")) for k in range(1, 7)]), lambda x: x.isNotNull())
    out = out.withColumn("path", F.array_join(titles, separator)).withColumn("parent", F.when(F.size(titles) > 1, F.element_at(titles, -2)))
    # a counter at level k runs within what lies above it and restarts there
    counters = []
    for k in range(1, 7):
        above = Window.partitionBy(key, f"_b{k}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        counters.append(F.when((F.col("level") >= k) & valid(k), F.sum((F.col("level") == k).cast("int")).over(above)))
    for k, c in enumerate(counters, 1):
        out = out.withColumn(f"_n{k}", c)
    number = F.array_join(F.filter(F.array(*[F.col(f"_n{k}") for k in range(1, 7)]), lambda x: x > 0), ".")
    out = out.withColumn("number", number)
    return out.drop(*[f"_{c}{k}" for c in "tpbn" for k in range(1, 7)])


def toc_lines(df: DataFrame, key: str, text: str, most: int = 100) -> DataFrame:
    """Entries "title ..... page" within `most` lines after a contents heading: (key, line_no, title, page, level by indentation)."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    start = F.min(F.when(F.lower(F.trim("line")).rlike(r"^#*\s*(?:table of contents|contents|table des matières|sommaire)$"), F.col("line_no"))).over(Window.partitionBy(key))
    entry = r"^(\s*)(\S.*?)\s*\.{3,}\s*(\d+)\s*$"
    rows = lines.withColumn("start", start).where((F.col("line_no") > F.col("start")) & (F.col("line_no") <= F.col("start") + most) & F.col("line").rlike(entry))
    indent = F.length(F.regexp_extract("line", entry, 1))
    title = F.trim(F.regexp_extract("line", entry, 2))
    rows = rows.select(key, "line_no", title.alias("title"), F.regexp_extract("line", entry, 3).cast("int").alias("page"), F.when(indent == 0, 1).when(indent < 4, 2).otherwise(3).alias("level"))
    return rows.where((F.length("title") > 2) & ~F.col("title").rlike(r"^\d+$"))


def match_toc(chunks: DataFrame, toc: DataFrame, key: str | None = None) -> DataFrame:
    """Each chunk's TOC entry: by equal title (rule 1), else by paragraph number at level 2 (2), else the nearest by place (3).

    chunks: chunk_id, title, number, place; toc: idx, title, number, level, place; key names
    the document column of both. Ties go to the first entry. Titles and numbers are
    equi-joins; the nearest entry is the last before or the first after in one ordering of a
    document's distinct places, whole numbers. A chunk without a place gets the first entry.
    """
    keys = [key] if key else []
    bare = lambda c: F.lower(F.trim(c))
    by_title = toc.groupBy(*keys, bare("title").alias("_title")).agg(F.min("idx").alias("_i1"))
    by_number = toc.where("level = 2").groupBy(*keys, F.col("number").alias("_number")).agg(F.min("idx").alias("_i2"))
    spots = toc.where("place IS NOT NULL").groupBy(*keys, "place").agg(F.min("idx").cast("bigint").alias("i"))
    line = chunks.where("place IS NOT NULL").select(*keys, F.col("place").cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("i"))
    line = line.unionByName(spots.withColumn("place", F.col("place").cast("bigint"))).groupBy(*keys, "place").agg(F.min("i").alias("i"))
    spot = F.when(F.col("i").isNotNull(), F.struct(F.col("place").alias("p"), "i"))
    # both frames end at the row, so each window takes one pass
    nearest = lambda order: F.last(spot, True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("place") - F.col(f"{c}.p")).alias("gap"), F.col(f"{c}.i").alias("i")))
    near = line.withColumn("before", nearest(F.asc("place"))).withColumn("after", nearest(F.desc("place")))
    near = near.select(*keys, F.col("place").alias("_place"), F.array_min(F.filter(F.array(gap("before"), gap("after")), lambda x: x.isNotNull()))["i"].alias("_i3"))
    first = toc.groupBy(*keys).agg(F.min("idx").alias("_i0"))
    out = chunks.withColumn("_title", bare("title")).withColumn("_number", F.col("number")).withColumn("_place", F.col("place").cast("bigint"))
    out = out.join(by_title, [*keys, "_title"], "left").join(by_number, [*keys, "_number"], "left").join(near, [*keys, "_place"], "left")
    out = out.join(first, keys, "left") if keys else out.crossJoin(F.broadcast(first))  # one row
    rule = F.when(F.col("_i1").isNotNull(), 1).when(F.col("_i2").isNotNull(), 2).otherwise(3)
    return out.select(*keys, "chunk_id", F.coalesce("_i1", "_i2", "_i3", "_i0").alias("idx"), rule.alias("rule"))


def carried(reference: Column, key: str, order: str) -> Column:
    """The last non-null reference at or before a row."""
    return F.last(reference, True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
