"""Catalogue operators: statistics, lookups, paging, joins of works and chunks, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, with the count of all rows beside it."""
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumns({"limit": F.lit(limit), "offset": F.lit(offset)})


def after(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """Keyset paging: the next rows by key after cursor (None starts)."""
    rows = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    return rows.orderBy(key).limit(limit)


def latest(df: DataFrame, key: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(key), F.desc(tie)).limit(n)


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: count of rows, and distinct non-blank values of each column with their sorted list."""
    named = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c, v in zip(columns, named, strict=True):
        aggs += [F.count_distinct(v).alias(f"n_{c}"), F.array_join(F.array_sort(F.collect_set(v)), "|").alias(f"list_{c}")]
    return df.agg(*aggs)


def work_counts(chunks: DataFrame) -> DataFrame:
    """Works with their chunk counts; blank titles are skipped, the author is the first seen by id, else 'Unknown'."""
    named = chunks.where(F.trim(F.coalesce("work_title", F.lit(""))) != "")
    counts = named.groupBy("work_title").agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.min_by("author", "id"), F.lit("Unknown")).alias("author"))
    return counts.orderBy(F.lower("author"), F.lower("work_title"))


def author_rollup(works: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per author and work the chunk count, with a total row (null work) an author; works without chunks count 0."""
    n = chunks.groupBy("work_title", "author").agg(F.count(F.lit(1)).alias("n"))
    joined = works.join(n, ["work_title", "author"], "left")
    return joined.rollup("author", "work_title").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_chunks"), F.count(F.lit(1)).alias("n_works")).where(F.col("author").isNotNull())


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by order."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing with the incoming rows whose key it lacks (one a key)."""
    new = first_per(incoming, [key], incoming.columns).join(existing.select(key), key, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)


def updated(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing with non-null values of changes (one row a key) over its own."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = existing.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in existing.columns])


def delete_cascade(tables: dict[str, DataFrame], key: str, doomed: DataFrame, confirm: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the doomed keys, and the counts of what goes; needs confirm."""
    if not confirm:
        raise ValueError("deletion must be confirmed")
    keys = doomed.select(key).distinct()
    kept = {name: df.join(keys, key, "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        one = df.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return kept, counts


def name_sets(expected: Column, actual: Column) -> dict[str, Column]:
    """Missing, unexpected and common names of two arrays, sorted."""
    return {"missing": F.array_sort(F.array_except(expected, actual)), "unexpected": F.array_sort(F.array_except(actual, expected)), "common": F.array_sort(F.array_intersect(expected, actual))}


def prefix_join(sections: DataFrame, chunks: DataFrame, separator: str = " > ") -> DataFrame:
    """sections (path) with the chunks (section_path) at or below them: an equi-join on each chunk's exploded path prefixes."""
    parts = F.split("section_path", separator)
    depth = F.explode(F.sequence(F.lit(1), F.size(parts)))
    below = chunks.withColumn("_depth", depth).withColumn("path", F.array_join(F.slice(parts, F.lit(1), F.col("_depth")), separator)).drop("_depth")
    return below.join(sections, "path")


def page_ranges(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of each TOC entry: the pages from its own up to the next entry's, in order. toc: doc, idx, title, page; pages: doc, page, text."""
    nxt = F.lead("page").over(Window.partitionBy("doc").orderBy("page", "idx"))
    spans = toc.withColumn("upto", F.coalesce(nxt, F.lit(1 << 30)))
    p = pages.select("doc", F.col("page").alias("p"), "text")
    joined = spans.join(p, "doc").where((F.col("p") >= F.col("page")) & (F.col("p") < F.col("upto")))
    ordered = F.array_sort(F.collect_list(F.struct("p", "text")))
    return joined.groupBy("doc", "idx", "title").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("content"))


def gap_clusters(points: DataFrame, gap: float) -> DataFrame:
    """1-D clusters of x: sorted distinct values, a new group where the step is at least gap; returns group, centre, n."""
    xs = points.select("x").distinct()
    step = F.col("x") - F.lag("x").over(Window.orderBy("x"))
    grouped = xs.withColumn("new", F.coalesce((step >= gap).cast("int"), F.lit(0))).withColumn("cluster", F.sum("new").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("cluster").agg(F.avg("x").alias("centre"), F.count(F.lit(1)).alias("n"))
