"""Robust multivariate outliers over text statistics, in DataFrame operations only.

Per (lang, source) a regularised minimum-covariance-determinant estimate: from three starts
(medians, medians scaled by quartiles, all rows) concentrate: fit mean and covariance to the
rows nearest so far, measure Mahalanobis distances, keep the nearest again. Each group keeps
the start of least determinant and concentrates it until no determinant falls any more. A
pass sends one row of sums, or one count per distance bin, a group and task.

Every group has its own estimate, whatever its size: PRIOR rows' worth of its language's
estimate are added to its sums, so small groups lean on their language and large ones do not.

Statistics are transformed, clipped and kept as integers, so sums are exact and results do
not depend on the order in which tasks finish.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import WS, broadcast_if_small, let, materialize

SYMBOLS = "#*$%&|<>"
#: Statistic vectors' coordinates, each about 0 to 8 after the transform.
DIMS = ("z_len", "z_word", "z_symbols", "z_lines", "z_repeats")
#: Steps of one unit in stored coordinates.
GRID = 1024
#: Share of a group's rows the estimate concentrates on.
CORE = 0.75
#: Concentration steps of each start, and of the best one at most.
STEPS, MOST_STEPS = 2, 8
#: Rows' worth of the language's estimate in each group's.
PRIOR = 50
#: What the core's covariance is multiplied by: CORE over the chi-squared distribution (7 degrees) at the CORE quantile of 5 degrees.
CONSISTENCY = 1.41
#: Deviation added to each coordinate in units: keeps degenerate groups (mostly copies) invertible. Ordinary
#: texts have no symbols and no repeats, so there the floor is what an outlier is measured by.
FLOORS = {"z_len": 0.35, "z_word": 0.35, "z_symbols": 0.2, "z_lines": 0.3, "z_repeats": 0.3}
#: Squared distance that rejects: the 0.9999 quantile of chi-squared with 5 degrees.
REJECT = 25.745
#: Bins of log2(1 + squared distance) that give the quantiles.
BINS = 64


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _repeats(words: Column, hashes: Column) -> Column:
    """Words covered by 5-word windows whose hash occurs twice or more among `hashes`.

    Windows are sorted as (hash, place); repeated ones keep their places, and the union of
    [p, p + 5) over sorted places p is the sum of the steps between them, at most 5 each.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    places = let(pairs, lambda ps: F.filter(F.transform(ps, lambda p, j: F.when((F.get(ps, j - 1)["h"] == p["h"]) | (F.get(ps, j + 1)["h"] == p["h"]), p["i"])), lambda i: i.isNotNull()))
    covered = F.aggregate(F.sort_array(places), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every whole text.

    Null and empty texts have no words and zeros. lang and source may be null or missing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    group = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *group, text.alias("text"), F.split(text, "\n").alias("lines"), _words(text).alias("words"))
    get = lambda i, k: F.get(F.col("words"), i + k)
    windows = F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[get(i, k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", windows).withColumn("lines", F.filter("lines", lambda x: F.length(F.translate(x, WS, "")) > 0))
    return rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _repeats(F.col("words"), F.col("windows")).cast("long").alias("n_repeat_words"),
    )


def _transformed() -> list[Column]:
    """The statistics as near-symmetric coordinates on the integer grid."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    units = (
        F.log2(F.col("n_words") + 1) / 2,
        4 * F.log2((F.col("word_chars") + 1) / words) / 2,
        4 * F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        4 * F.sqrt(F.col("n_dup_lines") / lines),
        4 * F.sqrt(F.col("n_repeat_words") / words),
    )
    return [F.round(F.least(u, F.lit(16.0)) * GRID).cast("long").alias(d) for u, d in zip(units, DIMS, strict=True)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums and product sums by group; integer, so their order does not matter."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(d).alias(f"s_{d}") for d in DIMS]]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    return rows.groupBy(*keys).agg(*aggs)


_SUMS = [*[f"s_{d}" for d in DIMS], *[f"p_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]]


def _with_prior(moments: DataFrame, prior: DataFrame | None, keys: list[str]) -> DataFrame:
    """Sums by group with PRIOR rows of the prior's means (n and sums by a part of the keys) added."""
    if prior is None:
        return moments
    on = [k for k in keys if k in prior.columns]
    means = broadcast_if_small(prior.select(*on, *[(F.col(c) / F.col("n")).alias(f"prior_{c}") for c in _SUMS]), 8 * len(_SUMS) + 64)
    return moments.join(means, on).select(*keys, (F.col("n") + PRIOR).alias("n"), *[(F.col(c) + PRIOR * F.col(f"prior_{c}")).alias(c) for c in _SUMS])


def _model(moments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means, the Cholesky factor (as forward-substitution coefficients) and the log determinant by group."""
    n = F.col("n").cast("double")
    out = moments.select(*keys, *[(F.col(f"s_{d}") / n / GRID).alias(f"m_{d}") for d in DIMS], *[(F.col(f"p_{a}_{b}") / n / GRID / GRID).alias(f"p_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]])
    for i, a in enumerate(DIMS):  # Cholesky, row by row
        for j, b in enumerate(DIMS[: i + 1]):
            cov = (F.col(f"p_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")) * scale + (FLOORS[a] ** 2 if i == j else 0)
            rest = reduce(lambda x, c: x - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}"), DIMS[:j], cov)
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{b}_{b}"))
    logdet = reduce(lambda x, y: x + y, [2 * F.log(f"l_{d}_{d}") for d in DIMS])
    return out.select(*keys, *[f"m_{d}" for d in DIMS], *[f"l_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[: i + 1]], F.round(logdet, 9).alias("logdet"))


def _distance(rows: DataFrame, model: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the squared Mahalanobis distance to their group's model."""
    keep = rows.columns
    model = broadcast_if_small(model, 8 * 24)
    out = rows.join(model, keys)
    for i, a in enumerate(DIMS):
        rest = reduce(lambda x, c: x - F.col(f"l_{a}_{c}") * F.col(f"y_{c}"), DIMS[:i], F.col(a) / GRID - F.col(f"m_{a}"))
        out = out.withColumn(f"y_{a}", rest / F.col(f"l_{a}_{a}"))
    return out.select(*keep, reduce(lambda x, y: x + y, [F.col(f"y_{d}") * F.col(f"y_{d}") for d in DIMS]).alias(name))


def _quantile_bins(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """(keys, names of shares): the first bin of value up to which at least each share of a group's rows lie."""
    bins = rows.groupBy(*keys, F.floor(value).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*keys).orderBy("bin")
    ranked = bins.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * share), F.col("bin"))).alias(name) for name, share in shares.items()])


def _bin(distance: str) -> Column:
    return F.log2(1 + F.col(distance)) * BINS


def _concentrated(near: DataFrame, keys: list[str], prior: DataFrame | None, tag: str) -> tuple[DataFrame, DataFrame]:
    """The sums over, and the model of, the CORE nearest rows of each group; near holds d2."""
    cut = broadcast_if_small(materialize(_quantile_bins(near, keys, _bin("d2"), {"cut": CORE}), f"{tag}-cut", light=True), 64)
    core = near.join(cut, keys).where(F.floor(_bin("d2")) <= F.col("cut"))
    sums = materialize(_moments(core, keys), f"{tag}-sums", light=True)
    return sums, materialize(_model(_with_prior(sums, prior, keys), keys, CONSISTENCY), f"{tag}-model", light=True)


def mcd(rows: DataFrame, keys: list[str], tag: str, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The groups' sums over their cores, and their models; rows hold keys and DIMS.

    Of the starts each group keeps the model of least determinant, ties to the first; then
    it concentrates until no group's determinant falls by over a millionth of its log.
    """
    mids = None
    for d in DIMS:
        mid = _quantile_bins(rows, keys, F.col(d) * 16 / GRID, {f"a_{d}": 0.25, f"c_{d}": 0.5, f"b_{d}": 0.75})
        mids = mid if mids is None else mids.join(mid, keys)
    mids = broadcast_if_small(materialize(mids, f"{tag}-medians", light=True), 160)
    whole = _model(_with_prior(_moments(rows, keys), prior, keys), keys, 1.0)
    off = {d: F.col(d) / GRID - F.col(f"c_{d}") / 16 for d in DIMS}
    spread = {d: (F.col(f"b_{d}") - F.col(f"a_{d}")) / 16 / 1.349 + FLOORS[d] for d in DIMS}
    square = lambda parts: reduce(lambda x, y: x + y, [p * p for p in parts])
    far = _distance(rows.join(mids, keys), materialize(whole, f"{tag}-whole", light=True), keys, "far")
    starts = [square([off[d] for d in DIMS]), square([off[d] / spread[d] for d in DIMS]), F.col("far")]
    # the starts stand side by side as groups of their own, so a step is one pass for all of them
    by = [*keys, "start"]
    near = far.select(*rows.columns, F.posexplode(F.array(*starts)).alias("start", "d2"))
    tries = rows.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(len(starts))])))
    for _ in range(STEPS):
        sums, model = _concentrated(near, by, prior, f"{tag}-starts")
        near = _distance(tries, model, by, "d2")
    chosen = model.groupBy(*keys).agg(F.min(F.struct("logdet", "start")).alias("best")).select(*keys, F.col("best.start").alias("start"))
    chosen = materialize(chosen, f"{tag}-chosen", light=True)
    model = materialize(model.join(chosen, by).drop("start"), f"{tag}-best", light=True)
    sums = sums.join(chosen, by).drop("start")
    for _ in range(MOST_STEPS):
        more, after = _concentrated(_distance(rows, model, keys, "d2"), keys, prior, f"{tag}-more")
        fell = after.join(model.select(*keys, F.col("logdet").alias("was")), keys).select(*keys, (F.col("logdet") < F.col("was") - 1e-6).alias("fell"))
        fell = materialize(fell, f"{tag}-fell", light=True)
        if fell.where("fell").isEmpty():
            break
        pick = lambda old, new: old.join(fell.where("not fell"), keys, "left_semi").unionByName(new.join(fell.where("fell"), keys, "left_semi"))  # noqa: E731, B023
        model, sums = materialize(pick(model, after), f"{tag}-best", light=True), pick(sums, more)
    return materialize(sums, f"{tag}-core", light=True), model


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, the base statistics, base_failed, distance2, kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. The
    other rows are kept unless their squared distance to their (lang, source) estimate
    exceeds REJECT (null is a language and a source like any other). Base failures take no
    part in the estimates. A group of one row is judged by its language, all but for a fiftieth.
    Copies count as often as they occur: a group of mere copies keeps an estimate
    as wide as FLOORS. Empty tables give no rows; columns beyond doc_id, text, lang and source are
    ignored.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = text_statistics(docs).withColumn("base_failed", base)
    null = F.lit("\x00null")
    rows = materialize(stats.select("*", *_transformed(), F.coalesce("lang", null).alias("g_lang"), F.coalesce("source", null).alias("g_source")), "stats")
    good = rows.where(~F.col("base_failed"))
    by_source, by_lang = ["g_lang", "g_source"], ["g_lang"]
    core = good.select(*by_source, *DIMS)
    prior, _ = mcd(core.drop("g_source"), by_lang, "lang")
    _, model = mcd(core, by_source, "source", prior)
    judged = _distance(good, model, by_source, "distance2")
    out = judged.unionByName(rows.where("base_failed").withColumn("distance2", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= REJECT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("distance2", 6).alias("distance2"))


def op1_mcd_outliers(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
