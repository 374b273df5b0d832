"""Text renderings and small rules over states, reports and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions import vector as V


def trait_band(value: Column) -> Column:
    """The band of a declared trait of -10 to 10."""
    return F.when(value >= 5, "strong").when(value >= 2, "marked").when(value > -2, "neutral").when(value > -5, "weak").otherwise("opposed")


def toward_traits(start: Column, traits: Column) -> Column:
    """A vector moved half-way to each declared trait's target along its direction, in order, then normalised.

    traits: array of struct(ord, target, direction) sorted by ord; targets are declared / 60.
    """
    moved = F.aggregate(traits, start, lambda v, t: F.zip_with(v, t["direction"], lambda x, d: x + (t["target"] - V.dot(v, t["direction"])) * d * 0.5))
    return V.normalised(moved)


def state_lines(profile: DataFrame) -> DataFrame:
    """A profile (category, name, value) as one prompt text, by category and name, with signed values."""
    line = F.format_string("[%s] %s: %+.2f", "category", "name", "value")
    return profile.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "name", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def report_text(days: DataFrame) -> DataFrame:
    """Daily reports (day, cycles, alerts) as one line each."""
    return days.select("day", F.format_string("%s: %d cycles, %d alerts", F.col("day").cast("string"), "cycles", "alerts").alias("text"))


def stamp(seconds: Column) -> Column:
    """A Unix time as a readable UTC date; null and 0 as a dash."""
    at = F.timestamp_seconds(seconds)
    # from 10000 on, four digits of a pattern are written with a sign
    said = F.when(F.year(at) > 9999, F.date_format(at, "dd MM y à HH:mm")).otherwise(F.date_format(at, "dd MM yyyy à HH:mm"))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit("—")).otherwise(said)


def seeded_source(cycle: Column, seed: int = 0) -> Column:
    """One of three sources by 50, 30 and 20 in a hundred, the same for the same cycle."""
    band = F.pmod(F.xxhash64(F.lit(seed), cycle), F.lit(100))
    return F.when(band < 50, "thoughts").when(band < 80, "chunks").otherwise("themes")


def seeded_choice(rows: DataFrame, order: str, cycle: int, first: int = 10, seed: int = 0) -> DataFrame:
    """One of the first rows by order, chosen by a hash of the cycle."""
    top = rows.orderBy(order).limit(first).withColumn("_rn", F.row_number().over(Window.orderBy(order)))
    n = F.broadcast(top.agg(F.count(F.lit(1)).alias("_n")))
    return top.crossJoin(n).where(F.col("_rn") == F.pmod(F.xxhash64(F.lit(seed), F.lit(cycle)), F.col("_n")) + 1).drop("_rn", "_n")


def change_ranking(tensor: DataFrame, state: int, reference: int) -> DataFrame:
    """Dimensions of a state by 1 - dot to a reference state, largest first, with the difference's length."""
    ref = F.broadcast(tensor.where(F.col("state_id") == reference).select("dim", F.col("v").alias("ref")))
    rows = tensor.where(F.col("state_id") == state).join(ref, "dim")
    return rows.select("dim", (1 - V.dot(F.col("v"), F.col("ref"))).alias("change"), V.l2(F.col("v"), F.col("ref")).alias("moved")).orderBy(F.desc("change"), "dim")


def evolution(log: DataFrame, n: int) -> DataFrame:
    """A component's values (occasion_id, value) over the last n occasions, oldest first."""
    return log.orderBy(F.desc("occasion_id")).limit(n).orderBy("occasion_id")


def corrected_sections(sections: DataFrame) -> DataFrame:
    """Sections (title, kind, should_index) with contents pages taken out of the index, and why."""
    toc = F.lower("title").rlike(r"table of contents|table des matières|sommaire|^contents$")
    return sections.withColumns({"reason": F.when(toc, "contents page"), "should_index": ~toc & F.coalesce("should_index", F.lit(True)), "kind": F.when(toc, "toc_display").otherwise(F.col("kind"))})


def chapters(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Pre-order headings (level, title) with their chapter: a top heading is its own, others have the last one."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("title")), True).over(run))


def paragraphs_markdown(rows: DataFrame, key: str, order: str, skip: int = 0) -> DataFrame:
    """Word paragraphs (level or null, text) as one markdown text a document."""
    line = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("t"))))
    return rows.where((F.col(order) >= skip) & (F.trim("text") != "")).groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("markdown"))


def pages_markdown(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Pages as one markdown text a document, each behind a page comment."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page), F.concat(F.lit("<!-- Page "), F.col(page).cast("string"), F.lit(" -->\n"), F.col(text)).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("markdown"))


def batch_size(df: DataFrame, text: str, first: int = 10) -> DataFrame:
    """The insert batch size for a table by the mean length of its first texts by order of id; 50 where those are empty."""
    mean = F.floor(F.avg(F.when(F.length(text) > 0, F.length(text))))
    return df.orderBy("id").limit(first).agg(F.when(mean > 50_000, 10).when(mean > 10_000, 25).when(mean > 3_000, 50).when(mean.isNull(), 50).otherwise(100).alias("batch"))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows a restarted job still has to process."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
