"""Activity metrics over event tables; every time-relative one takes its own `as_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.search import small_side


def daily_report(events: DataFrame) -> DataFrame:
    """Per day: events, counts by class, purchases' mean value, errors, the last error's time, and value extremes."""
    kind = F.col("event_type")
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("cycles"),
        F.count_if(kind == "click").alias("user"),
        F.count_if(kind == "view").alias("veille"),
        F.count_if(~kind.isin("click", "view")).alias("autonomous"),
        F.count_if(kind == "purchase").alias("verbalizations"),
        F.avg(F.when(kind == "purchase", F.col("value"))).alias("verbalization_mean"),
        F.count_if(kind == "error").alias("alerts"),
        F.max(F.when(kind == "error", F.col("ts"))).alias("last_alert"),
        F.avg("value").alias("delta_mean"),
        F.max("value").alias("delta_max"),
    )


def weekly_summary(events: DataFrame, last_day: Column) -> DataFrame:
    """The seven days up to last_day, days without events included, and a total row (null day) with averages a day."""
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, 6), last_day)).alias("day"))
    counts = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    week = spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return week.rollup("day").agg(F.sum("n").alias("cycles"), (F.sum("n") / 7).alias("per_day"), F.sum("v").alias("value"))


def health(events: DataFrame, as_of: Column) -> DataFrame:
    """One row: alerts of the last hour by level and what they amount to."""
    recent = F.col("ts") > as_of - F.expr("interval 1 hour")
    row = events.agg(F.count_if(recent & (F.col("level") == "critical")).alias("critical"), F.count_if(recent & (F.col("level") == "warning")).alias("warning"))
    return row.withColumn("status", F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 2, "warning").otherwise("healthy"))


def occasion_statistics(log: DataFrame, n: int) -> DataFrame:
    """Time and token statistics of the last n occasions (occasion_id, trigger, ms, tokens), with counts by trigger."""
    last = log.orderBy(F.desc("occasion_id")).limit(n)
    by = last.groupBy("trigger").agg(F.count(F.lit(1)).alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trigger", "c"))), lambda x: F.concat(x["trigger"], F.lit("="), x["c"])), ",").alias("by_trigger"))
    return last.agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.sum("tokens").alias("tokens")).crossJoin(by)


def oldest_open(impacts: DataFrame, as_of: Column) -> DataFrame:
    """The oldest unresolved impact (impact_id, ts, resolved) with its age in days; over seven is a priority."""
    first = impacts.where(~F.coalesce("resolved", F.lit(False))).agg(F.min(F.struct("ts", "impact_id")).alias("m")).where(F.col("m").isNotNull())
    age = F.datediff(as_of, F.col("m.ts"))
    return first.select(F.col("m.impact_id").alias("impact_id"), F.col("m.ts").alias("ts"), age.alias("age_days"), (age > 7).alias("priority"))


def cost(usage: DataFrame, prices: DataFrame, default: float) -> DataFrame:
    """Cost of usage (model, tokens) by prices (model, per_million); unknown models cost default a million."""
    joined = usage.join(small_side(prices), "model", "left")
    return joined.groupBy("model").agg((F.sum(F.col("tokens") * F.coalesce("per_million", F.lit(default))) / 1e6).alias("cost"))


def job_status(files: DataFrame) -> DataFrame:
    """Per job (job, ok): complete, error, or partial."""
    good, n = F.count_if("ok"), F.count(F.lit(1))
    return files.groupBy("job").agg(n.alias("files"), good.alias("completed"), F.when(good == n, "complete").when(good == 0, "error").otherwise("partial").alias("status"))


def within_budget(rows: DataFrame, group: str, order: list, text: str, budget: int, separator: str = "\n\n") -> DataFrame:
    """Texts of a group joined in order until the first that would exceed budget characters."""
    from pyspark.sql.window import Window

    run = Window.partitionBy(group).orderBy(*order)
    upto = F.sum(F.length(text)).over(run) + len(separator) * (F.row_number().over(run) - 1)
    kept = rows.withColumn("_place", F.row_number().over(run)).withColumn("_upto", upto).where(F.col("_upto") <= budget)
    ordered = F.array_sort(F.collect_list(F.struct("_place", F.col(text).alias("t"))))
    return kept.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias("joined"), F.count(F.lit(1)).alias("n"))
