"""State-tensor analytics: dissonance, drift, profiles and sequential evolution.

Tensors are long rows (state_id, dim, v). Everything but the normalising recursions is
joins and windows; the recursions are folds over an entity's sorted steps, which stream by.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions import vector as V
from tessel.operators.fold import ordered_fold
from tessel.operators.search import small_side


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; zero rows stay."""
    size = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, size, out=x.copy(), where=size > 0)


def contrast(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """The direction from the mean of negative to the mean of positive rows (vector), of unit length."""
    p, n = (V.mean_by(df.withColumn("g", F.lit(1)), ["g"], "vector", name=name) for df, name in ((positive, "p"), (negative, "n")))
    return p.join(n, "g").select(V.normalised(F.zip_with("p", "n", lambda x, y: x - y)).alias("vector"))


def dissonance(tensor: DataFrame, event: Column, weights: Column, shock: float = 0.3) -> DataFrame:
    """Per state: the weighted sum of 1 - cosine(event, dimension), and whether it is a shock. weights: array by dim."""
    part = F.get(weights, F.col("dim")) * (1 - V.cosine(F.col("v"), event))
    return tensor.groupBy("state_id").agg(F.sum(part).alias("total"), F.max_by("dim", part).alias("worst_dim")).withColumn("shock", F.col("total") > shock)


def enhanced_dissonance(base: Column, context: DataFrame, event: Column, hard: float = 0.1, novel: float = 0.3) -> DataFrame:
    """One row from a retrieval context (vector): base + 0.2 hard negatives' share + 0.1 novelty. Novelty is 1 without context."""
    sim = V.dot(F.col("vector"), event)
    row = context.agg(F.count_if(sim < hard).alias("hard_negatives"), F.max(sim).alias("top"), F.count(F.lit(1)).alias("n"))
    novelty = F.when(F.col("n") == 0, F.lit(1.0)).when(F.col("top") < novel, 1 - F.col("top")).otherwise(F.lit(0.0))
    row = row.withColumn("novelty", novelty).withColumn("base", base)
    return row.withColumn("total", F.col("base") + 0.2 * F.col("hard_negatives") / F.greatest(F.col("n"), F.lit(1)) + 0.1 * F.col("novelty"))


def tension(tensor: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Per state, the mean of 1 - cosine over fixed pairs of dimensions."""
    wide = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    left = tensor.withColumn("p", wide).where(F.col("p.a") == F.col("dim")).select("state_id", F.col("p.b").alias("b"), F.col("v").alias("va"))
    right = tensor.select("state_id", F.col("dim").alias("b"), F.col("v").alias("vb"))
    return left.join(right, ["state_id", "b"]).groupBy("state_id").agg(F.avg(1 - V.cosine(F.col("va"), F.col("vb"))).alias("tension"))


def drift(tensor: DataFrame) -> DataFrame:
    """Per state: the relative change from the state before (0 for the first) and its running sum."""
    before = F.lag("v").over(Window.partitionBy("dim").orderBy("state_id"))
    steps = tensor.withColumn("before", before)
    change = F.aggregate(F.zip_with("v", "before", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    total = steps.groupBy("state_id").agg(F.sqrt(F.sum(change)).alias("moved"), F.sqrt(F.sum(V.dot(F.col("before"), F.col("before")))).alias("size"))
    total = total.select("state_id", F.coalesce(F.when(F.col("size") > 0, F.col("moved") / F.col("size")), F.lit(0.0)).alias("drift"))
    # one row a state: the running sum is over states, not over corpus rows
    return total.withColumn("cumulative", F.sum("drift").over(Window.orderBy("state_id").rowsBetween(Window.unboundedPreceding, 0)))


def distances(tensor: DataFrame, reference: DataFrame) -> DataFrame:
    """Per state and dimension, 1 - cosine to the reference's dimension (1.0 where a vector is zero)."""
    ref = small_side(reference.select("dim", F.col("v").alias("ref")))
    return tensor.join(ref, "dim").select("state_id", "dim", (1 - V.cosine(F.col("v"), F.col("ref"))).alias("distance"))


def alerts(drifts: DataFrame, by_dim: DataFrame, threshold: float, step: float = 0.002, dim_threshold: float = 0.05) -> DataFrame:
    """Alert level per state from its drift and its dimensions' distances, with the three that drift most."""
    dims = by_dim.groupBy("state_id").agg(F.count_if(F.col("distance") > dim_threshold).alias("drifting"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "dim"))), 1, 3).alias("top"))
    level = F.when(F.col("cumulative") > 2 * threshold, "critical").when((F.col("cumulative") > threshold) | (F.col("drifting") > 2), "warning").when(F.col("drift") > step, "warning").otherwise("ok")
    return drifts.join(dims, "state_id").select("state_id", level.alias("level"), "drifting", F.transform("top", lambda t: t["dim"]).alias("top_dims"))


def projection(tensor: DataFrame, directions: DataFrame, dim_of: Column) -> DataFrame:
    """Profiles: each direction (name, category, vector) against the dimension its category maps to, as a dot product."""
    d = directions.withColumn("dim", dim_of)
    return tensor.join(small_side(d), "dim").select("state_id", "category", "name", V.dot(F.col("v"), F.col("vector")).alias("value"))


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of two profiles (category, name, value) and their distance; what b lacks counts as 0."""
    right = b.select("category", "name", F.col("value").alias("other"))
    return a.join(right, ["category", "name"], "left").withColumn("other", F.coalesce("other", F.lit(0.0))).withColumn("delta", F.abs(F.col("value") - F.col("other")))


def intensity(value: Column) -> Column:
    """The band of a projection value."""
    return F.when(value > 0.5, "tres").when(value > 0.2, "moderement").when(value > -0.2, "neutre").when(value > -0.5, "peu").otherwise("pas du tout")


def bar(value: Column, width: int = 10) -> Column:
    """A value of -1 to 1 as a bar of marks."""
    n = F.least(F.lit(width), F.round(F.abs(value) * width).cast("int"))
    return F.concat(F.when(value < 0, "-").otherwise("+"), F.rpad(F.repeat(F.lit("#"), n), width, "."))


def evolve(steps: DataFrame, entity: str = "entity") -> DataFrame:
    """Fold s = normalise(alpha s + beta e) over each entity's steps (ord, e, alpha, beta), whose first e is the first state; returns the last state and the number of steps."""

    def step(state: tuple | None, row: dict) -> tuple[tuple, list]:
        e = np.asarray(row["e"])
        if state is None:
            return (e, 1), []
        s = row["alpha"] * state[0] + row["beta"] * e
        return (_unit(s), state[1] + 1), []

    kind = steps.schema[entity].dataType.simpleString()
    rows = steps.select(entity, "ord", "alpha", "beta", "e")
    return ordered_fold(rows, [entity], ["ord"], f"{entity} {kind}, state array<double>, steps bigint", step, lambda key, s: [(*key, s[0].tolist(), s[1])])


def adaptive_rates(thoughts: Column, trigger: Column, length: Column, alpha: float = 0.85, beta: float = 0.15) -> tuple[Column, Column]:
    """Memory and input weights of a step, of sum 1: each thought weighs the input 0.03 more, up to 0.1; half of that for timers, 0.02 more for user texts over 200 characters."""
    more = F.least(thoughts * 0.03, F.lit(0.10))
    more = F.when(trigger == "timer", more * 0.5).when((trigger == "user") & (length > 200), more + 0.02).otherwise(more)
    a, b = F.lit(alpha) - more, F.lit(beta) + more
    return a / (a + b), b / (a + b)


def evolve_dims(steps: DataFrame, tensor0: list[list[float]], rates: list[float], entity: str = "entity") -> DataFrame:
    """Fold all dimensions by x += rate * |delta| * (e - x), each normalised, from tensor0; steps: ord, e, size. Returns the last tensor of each entity."""
    start, rate = np.array(tensor0), np.array(rates)[:, None]

    def step(state: np.ndarray | None, row: dict) -> tuple[np.ndarray, list]:
        x = start if state is None else state
        return _unit(x + rate * row["size"] * (np.asarray(row["e"]) - x)), []

    kind = steps.schema[entity].dataType.simpleString()
    rows = steps.select(entity, "ord", "size", "e")
    return ordered_fold(rows, [entity], ["ord"], f"{entity} {kind}, state array<array<double>>", step, lambda key, s: [(*key, s.tolist())])


def combined_delta(deltas: list[Column], weights: list[float], most: float = 0.001) -> Column:
    """The weighted sum of delta vectors, no longer than `most`."""
    total = V.scaled(deltas[0], weights[0])
    for v, w in zip(deltas[1:], weights[1:], strict=True):
        total = V.added(total, V.scaled(v, w))
    return V.clamped(total, most)


def verbalise(trigger: Column, total: Column, alert: Column, hard_negatives: Column) -> Column:
    """Why a cycle speaks, if it does: user, then dissonance, then drift alert, then hard negatives."""
    return F.when(trigger == "user", "user").when(total > 0.6, "dissonance").when(alert.isin("warning", "critical"), "drift").when(hard_negatives >= 3, "hard_negatives").otherwise("silent")


def contradiction(similarity: Column, nli: Column) -> Column:
    """Hard negative by similarity and an entailment model's score: under 0.1 always, over 0.7 if the score exceeds 0.8, between if it exceeds 0.5; without a score under 0.3."""
    return F.when(similarity < 0.1, True).when(nli.isNull(), similarity < 0.3).when(similarity > 0.7, nli > 0.8).otherwise(nli > 0.5)


def coherence(tensor: DataFrame, event: Column, least: float = 0.5) -> DataFrame:
    """Per state: the mean product of an event with the dimensions that judge coherence (0, 2, 4, 7), and whether it is integrated."""
    mean = F.avg(V.dot(F.col("v"), event))
    return tensor.where(F.col("dim").isin(0, 2, 4, 7)).groupBy("state_id").agg(mean.alias("coherence")).withColumn("action", F.when(F.col("coherence") > least, "integrate").otherwise("weak_integrate"))


def tenacity(tensor: DataFrame, event: Column, least: float = 0.8) -> DataFrame:
    """Per state: how far an event confirms its habits (dimension 2), and whether it reinforces them."""
    return tensor.where("dim = 2").select("state_id", V.dot(F.col("v"), event).alias("confirmation")).withColumn("action", F.when(F.col("confirmation") > least, "reinforce").otherwise("resist"))


def recent_mean(states: DataFrame, entity: str, order: str, most: int, decay: float = 0.01) -> DataFrame:
    """Per entity the mean of its latest `most` vectors, each weighing exp(-decay) of the one after it."""
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(order))) - 1
    recent = states.withColumn("age", rank).where(F.col("age") < most)
    return V.mean_by(recent, [entity], "vector", F.exp(-decay * F.col("age")))


def seeded_vector(key: Column, width: int, seed: int = 42) -> Column:
    """A vector of numbers in [-0.5, 0.5) that follows from the seed and key alone."""
    digits = lambda i: F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), i.cast("string")).cast("binary")), 1, 8)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.conv(digits(i), 16, 10).cast("double") / 4294967296.0 - 0.5)


def beginnings(entities: DataFrame, declared: DataFrame | None, observed: DataFrame | None, width: int, dims: int = 8, alpha: float = 0.7, names: tuple[str, str, str] = ("hybrid", "declared", "history")) -> DataFrame:
    """Per entity (one column) and dimension the vector it begins with, of unit length, and where it comes from.

    declared and observed hold (entity, dim, vector). Where an entity has both whole, they are
    blended alpha to 1 - alpha (names[0]); else it takes the declared ones (names[1]), else the
    observed (names[2]), else vectors seeded by entity and dimension ("seeded"). A source that
    lacks a dimension of an entity counts as none for it.
    """
    (entity,) = entities.columns
    rows = entities.select(entity, F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))
    for name, source in (("_d", declared), ("_o", observed)):
        if source is None:
            rows = rows.withColumn(name, F.lit(None).cast("array<double>"))
            continue
        whole = source.groupBy(entity).agg(F.count_distinct("dim").alias("n")).where(F.col("n") == dims).select(entity)
        rows = rows.join(source.join(whole, entity, "left_semi").select(entity, "dim", F.col("vector").alias(name)), [entity, "dim"], "left")
    d, o = F.col("_d"), F.col("_o")
    blend = F.zip_with(d, o, lambda a, b: alpha * a + (1 - alpha) * b)
    origin = F.when(d.isNotNull() & o.isNotNull(), names[0]).when(d.isNotNull(), names[1]).when(o.isNotNull(), names[2]).otherwise("seeded")
    seeded = seeded_vector(F.concat(F.col(entity).cast("string"), F.lit(":"), F.col("dim").cast("string")), width)
    vector = F.when(d.isNotNull() & o.isNotNull(), blend).when(d.isNotNull(), d).when(o.isNotNull(), o).otherwise(seeded)
    return rows.select(entity, "dim", origin.alias("origin"), V.normalised(vector).alias("vector"))
