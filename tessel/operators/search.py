"""Vector retrieval: filtered, two-stage, diverse and unified nearest neighbours.

A corpus is scanned once a query batch. Query vectors are few and passed as literals or a
checked broadcast; the k best come from TakeOrderedAndProject or a rank window that Spark
limits before its shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions.vector import cosine, dot, l2, norm
from tessel.operators.blocks import BLOCK, all_distances, block_pairs, near_distances, nearest


def equal_filters(**wanted) -> Column:
    """Conjunction of equalities; a parameter that is None is no predicate, a list is membership and an empty one no filter."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None and not (isinstance(v, (list, tuple, set)) and not v)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def stored_vector(df: DataFrame, key: str, value) -> list[float]:
    """The vector of one stored row (the query side of a search)."""
    row = df.where(F.col(key) == value).select("vector").head()
    if row is None:
        raise KeyError(f"{key}={value}")
    return list(row["vector"])


def knn(df: DataFrame, query, k: int, where: Column | None = None, key: str = "id") -> DataFrame:
    """The k rows most similar to query, filtered first; ties by key. Adds `similarity`."""
    rows = df if where is None else df.where(where)
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    own = norm(F.col("vector"))
    similarity = F.when((own == 0) | F.lit(size == 0), F.lit(0.0)).otherwise(dot(F.col("vector"), vector_literal(query)) / (own * F.lit(size or 1.0)))
    return rows.withColumn("similarity", similarity).orderBy(F.desc("similarity"), key).limit(k)


def at_least(hits: DataFrame, similarity: float) -> DataFrame:
    """Cut after the k best were taken, as a threshold never widens them."""
    return hits.where(F.col("similarity") >= similarity)


#: Bytes of a side, summed over its rows, up to which it is broadcast.
MOST_BYTES = 16 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and arrays by their lengths, other values 8 each."""
    parts = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) + 16 if t == "string" else F.greatest(F.size(F.col(f"`{n}`")), F.lit(0)) * 8 + 16 if t.startswith("array") else F.lit(8) for n, t in df.dtypes]
    return sum(parts, F.lit(8))


def small_side(df: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """df broadcast if its rows sum up to at most `most` bytes, else left to a shuffled plan."""
    size = df.agg(F.sum(_row_bytes(df).cast("long")).alias("b")).head()["b"]
    return F.broadcast(df) if (size or 0) <= most else df


def batch_knn(df: DataFrame, queries: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k nearest rows (key, vector) of every query (query_id, query_vector), with rank and similarity; ties by key."""
    return batch_knn_blocked(df, queries, k, key)


def batch_knn_blocked(df: DataFrame, queries: DataFrame, k: int, key: str = "id", block: int = BLOCK) -> DataFrame:
    """batch_knn by matrix products of blocks of rows and of queries, both of any number; the k best of each block meet in a rank window."""
    rank = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return nearest(df, queries, k, key, block).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def of_works(sections: DataFrame, works: DataFrame, author: str | None = None, work: str | None = None) -> DataFrame:
    """The few sections (path, work_title) whose title is that of a work (title, author) that passes; untitled ones never do."""
    passing = works.where(equal_filters(author=author, title=work)).where(F.col("title") != "").select(F.col("title").alias("_title"))
    # the sections are the small side; a title that several works bear keeps its section once
    return passing.join(F.broadcast(sections), F.col("_title") == F.col("work_title")).drop("_title").dropDuplicates(["path", "work_title"])


def section_probes(sections: DataFrame, query, embed) -> DataFrame:
    """sections with `probe`: the vector of a section's text, without one of its title, without both the query itself.

    embed(df, text column, vector column) adds the vectors; null and empty texts count as missing.
    """
    words = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("text", "title") if c in sections.columns], F.lit(None).cast("string"))
    probed = embed(sections.withColumn("_words", words), "_words", "_embedded")
    return probed.withColumn("probe", F.when(F.col("_words").isNull(), vector_literal(query)).otherwise(F.col("_embedded"))).drop("_words", "_embedded")


def hierarchical(sections: DataFrame, chunks: DataFrame, query, n_sections: int, limit: int, works: DataFrame | None = None, author: str | None = None, work: str | None = None, embed=None) -> DataFrame:
    """Two stages: the nearest sections, then in each the chunks nearest to the section; best chunks first.

    sections: path, vector (with works: work_title; with embed: text, title); chunks: id,
    section_path, vector (with filters: author, work_title). Filters cut the sections after the
    nearest were taken, through the works of their titles, and chunks before. A section is
    probed with its stored vector, or with embed by its text (`section_probes`), all in one
    pass over the chunks. Each gives max(3, limit // sections left) chunks of its path
    prefix; chunks of nested sections repeat. Ties go by path and id.
    """
    top = knn(sections, query, n_sections, key="path").withColumnRenamed("similarity", "section_similarity")
    if author is not None or work is not None:
        if works is None:
            raise ValueError("filters by author or work need the table of works")
        top = of_works(top, works, author, work)
    top = section_probes(top, query, embed) if embed else top.withColumn("probe", F.col("vector"))
    # at most n_sections rows: counted in one task, and broadcast by the prefix join
    top = top.select("path", F.col("probe").alias("section_vector"), "section_similarity").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    pairs = chunks.where(equal_filters(author=author, work_title=work)).join(F.broadcast(top), chunks.section_path.startswith(top.path))
    pairs = pairs.select("path", "section_similarity", "n", "id", cosine(F.col("vector"), F.col("section_vector")).alias("similarity"))
    rank = Window.partitionBy("path").orderBy(F.desc("similarity"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= F.greatest(F.lit(3), F.floor(F.lit(limit) / F.col("n"))))
    return ranked.select("path", "section_similarity", "id", "similarity").orderBy(F.desc("similarity"), "path", "id")


def diverse(chunks: DataFrame, query, pool: int, authors: int, per_author: int, limit: int, where: Column | None = None) -> DataFrame:
    """Author-diverse retrieval: a pool of neighbours, the best authors by the mean of their top three, a quota each.

    One author may fill the limit; up to three get max(per_author, limit // n); more get
    per_author. Scores are percentages rounded to one place, ties by author and id.
    """
    near = knn(chunks, query, pool, where).withColumn("pct", F.round(F.col("similarity") * 100, 1))
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("pct"), "id")))
    best = near.groupBy("author").agg(F.avg(F.when(F.col("rn") <= 3, F.col("pct"))).alias("score")).orderBy(F.desc("score"), "author").limit(authors)
    ranked = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "author"))).crossJoin(best.agg(F.count(F.lit(1)).alias("n")))
    quota = F.when(F.col("n") == 1, F.lit(limit)).when(F.col("n") <= 3, F.greatest(F.lit(per_author), F.floor(F.lit(limit) / F.col("n")).cast("int"))).otherwise(F.lit(per_author))
    return near.join(ranked.withColumn("quota", quota), "author").where(F.col("rn") <= F.col("quota")).orderBy("place", "rn").limit(limit).select("author", "id", "pct", "score", "place", "rn")


def unified(sources: dict[str, DataFrame], query, k: int, since=None, before=None, sort_by: str = "relevance", prefilter: bool = True) -> DataFrame:
    """Nearest rows of several collections in one ranking.

    sources: name -> (id, ts, content, vector). Time bounds apply before the top k of each
    source (prefilter) or after it; rows whose time is unknown stay. Without a query vector
    rows come by id and have no similarity. sort_by: relevance, date_desc or date_asc.
    """
    span = F.lit(True)
    if since is not None:
        span &= F.col("ts").isNull() | (F.col("ts") >= F.lit(since))
    if before is not None:
        span &= F.col("ts").isNull() | (F.col("ts") <= F.lit(before))
    parts = []
    for name, df in sources.items():
        rows = df.where(span) if prefilter else df
        rows = knn(rows, query, k) if query is not None else rows.orderBy("id").limit(k).withColumn("similarity", F.lit(None).cast("double"))
        rows = rows if prefilter else rows.where(span)
        parts.append(rows.select(F.lit(name).alias("type"), "id", "ts", "content", "similarity"))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = {"relevance": [F.desc_nulls_last("similarity")], "date_desc": [F.desc_nulls_last("ts")], "date_asc": [F.asc_nulls_first("ts")]}[sort_by]
    return every.orderBy(*order, "type", "id").limit(k)


def timeline(sources: dict[str, DataFrame], query, k: int, most_distance: float = 0.8) -> DataFrame:
    """Rows near a concept in time order: of the k nearest of each source, those within a distance; the k oldest."""
    parts = [knn(df, query, k).select(F.lit(name).alias("type"), "id", "ts", "content", F.col("similarity").alias("relevance")) for name, df in sources.items()]
    near = reduce(lambda a, b: a.unionByName(b), parts).where(1 - F.col("relevance") < most_distance)
    return near.orderBy(F.asc_nulls_first("ts"), "type", "id").limit(k)


def _evidence(sources: dict[str, DataFrame], query, k: int, most_distance: float) -> DataFrame:
    """(type, id, similarity): the k nearest of each source that are near enough."""
    parts = [knn(df, query, k).select(F.lit(name).alias("type"), "id", "similarity") for name, df in sources.items()]
    return reduce(lambda a, b: a.union(b), parts).where(1 - F.col("similarity") < most_distance)


def consistency(sources: dict[str, DataFrame], query, k: int = 10, most_distance: float = 0.7) -> DataFrame:
    """One row: the mean similarity of near rows (1.0 without any), its label, and the count of evidence."""
    mean = F.coalesce(F.avg("similarity"), F.lit(1.0))
    label = F.when(mean > 0.8, "consistent").when(mean > 0.6, "partial").otherwise("to verify")
    return _evidence(sources, query, k, most_distance).agg(F.count(F.lit(1)).alias("evidence"), F.round(mean, 2).alias("score"), label.alias("label"))


def consistency_evidence(sources: dict[str, DataFrame], query, k: int = 10, most_distance: float = 0.7, shown: int = 5) -> DataFrame:
    """The rows behind a consistency score that are shown with it: the nearest of all sources, ties by type and id."""
    return _evidence(sources, query, k, most_distance).orderBy(F.desc("similarity"), "type", "id").limit(shown)


def pairwise_l2(df: DataFrame, most: int = 5000) -> DataFrame:
    """Distances of all pairs of a small table (id, vector); larger ones need an approximate join."""
    if len(df.limit(most + 1).select("id").take(most + 1)) > most:
        raise ValueError(f"pairwise distances are for at most {most} rows; use similar_pairs")
    a, b = df.alias("a"), F.broadcast(df).alias("b")
    return a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), l2(F.col("a.vector"), F.col("b.vector")).alias("distance"))


def pairwise_l2_blocked(df: DataFrame, within: str | None = None, places: int | None = None, block: int = BLOCK) -> DataFrame:
    """Distances of all pairs of a table (id, vector) of any size, or of those equal in the column `within`, rounded to `places` if given, by products of blocks of rows."""
    return block_pairs(df, _pair_schema(df), all_distances(places), None if within is None else F.col(within), block)


def similar_pairs(df: DataFrame, distance: float, block: int = 4 * BLOCK) -> DataFrame:
    """All pairs (a_id, b_id, distance) closer than distance. Exact: products of blocks of rows find candidates, exact distances confirm them."""
    return block_pairs(df, _pair_schema(df), near_distances(distance), block=block)


def _pair_schema(df: DataFrame) -> str:
    kind = dict(df.dtypes)["id"]
    return f"a_id {kind}, b_id {kind}, distance double"


class HyperplaneIndex:
    """An optional approximate index: rows fall into cells by the signs of random hyperplanes, in several tables.

    search() probes the query's own cells and those one sign away; the exact similarity
    ranks what it finds.
    """

    def __init__(self, width: int, bits: int = 6, tables: int = 6, seed: int = 11) -> None:
        import numpy as np

        self.planes = np.random.default_rng(seed).normal(size=(tables, bits, width))

    def cells(self, vector: Column) -> list[Column]:
        def cell(planes) -> Column:
            return sum((F.when(dot(vector, vector_literal(p)) >= 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(planes)), F.lit(0))

        return [cell(p) for p in self.planes]

    def build(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cells", F.array(*self.cells(F.col("vector"))))

    def search(self, built: DataFrame, query, k: int) -> DataFrame:
        signs = [sum(int(p @ query >= 0) << i for i, p in enumerate(planes)) for planes in self.planes]
        near = [[s, *[s ^ (1 << b) for b in range(self.planes.shape[1])]] for s in signs]
        probe = reduce(lambda a, b: a | b, [F.col("cells")[t].isin(v) for t, v in enumerate(near)])
        return knn(built, query, k, probe)


def rerank(hits: DataFrame, answer: str, position: str = "position", least_share: float = 0.5) -> DataFrame:
    """The hits a reranking answer keeps: listed positions (from 1); ALL or an unusable answer keeps all, NONE none.

    Lists that keep under least_share of the hits are distrusted and keep all; three hits or
    fewer are never reranked.
    """
    n = hits.count()
    said = (answer or "").strip().upper()
    if n <= 3 or said == "ALL":
        return hits
    if said == "NONE":
        return hits.limit(0)
    listed = sorted({int(x) for x in (answer or "").replace("[", "").replace("]", "").split(",") if x.strip().isdigit() and 1 <= int(x) <= n})
    return hits if len(listed) < least_share * n else hits.where(F.col(position).isin(listed))


__all__ = ["HyperplaneIndex", "at_least", "batch_knn", "batch_knn_blocked", "consistency", "consistency_evidence", "diverse", "equal_filters", "hierarchical", "knn", "norm", "of_works", "pairwise_l2", "rerank", "section_probes", "similar_pairs", "small_side", "stored_vector", "timeline", "unified", "vector_literal"]
