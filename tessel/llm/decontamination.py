"""Benchmark decontamination by SimHash windows and a multi-index Hamming search.

Windows as long as a benchmark item get two 128-bit SimHashes: of their words, each counted
alike, and of their distinct shingles, each by the square root of its weight. Sixteen 8-bit
blocks index both fingerprints of every item with all values up to two bits away, so that any
window within RADIUS bits of its item shares an indexed block with it. What the index finds is
confirmed by the exact weighted similarity of the shingle sets.

The second fingerprint follows from that similarity: sets of similarity J have, by square roots
of weights, a cosine of at least 2J / (1 + J). At 0.75 that is 6/7: 22 of 128 bits differ on
average, with a deviation of 4.3, and RADIUS lies almost six deviations above. The first one finds
passages whose parts changed places.

A window at the threshold holds three quarters of an item's shingle weight, in whatever
order. So windows are taken where a document holds enough of an item's shingles within the
item's length; every other window lies below the threshold for certain (`_reach`, `_starts`)
and gets no fingerprint. Neighbouring windows roll: what enters and leaves at a start is summed,
and running sums give each window, so an item's length counts once a stretch, not once a window.
DataFrame operations only.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import broadcast_if_small, let, materialize, table

SHINGLE = 5
PERCENT = 75
#: Blocks of 8 bits, and bits that may differ within one: distances up to BLOCKS * (FLIPS + 1) - 1 are guaranteed.
BLOCKS, FLIPS = 16, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Words by whose starts windows are gathered into one row.
STRIDE = 512
#: What a weight of 1 is as an integer, so that running sums of weights are exact.
UNIT = 1 << 40
#: Fingerprints: of words, of weighted shingles.
WORDS, SHINGLES = 0, 1


def lower_words(text: Column) -> Column:
    """Words between ASCII white space, lower-cased over A-Z; null gives none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, r"[ \t-\r]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of the words' runs of `size` in order; none if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _votes() -> list[Column]:
    """Sums of `q` by bits of `hi` and `lo`; one sum counts two bits 32 places apart, so sums of q stay below 2**31."""
    two = F.lit((1 << 32) + 1)
    return [F.sum(F.call_function("shiftright", side, F.lit(b)).bitwiseAND(two) * F.col("q")).alias(f"{side}{b}") for side in ("hi", "lo") for b in range(32)]


def _majority(side: str) -> Column:
    """The 64 bits of a side that over half of all `q` set, from the sums of `_votes`; one expression for all bits keeps the plan small."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def bits(both: Column, b: Column) -> Column:
        low, high = both.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(both, 32)
        of = lambda votes, at: F.when(2 * votes > F.col("q"), F.call_function("shiftleft", one, at)).otherwise(none)
        return of(low, b).bitwiseOR(of(high, b + 32))

    sums = F.array(*[F.col(f"{side}{b}") for b in range(32)])
    return F.aggregate(F.transform(sums, bits), none, lambda x, y: x.bitwiseOR(y)).alias(side)


def simhash(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hi, lo): the 128-bit SimHash of each key's rows (hi, lo, q), hashed elements with their weights."""
    sums = elements.groupBy(*keys).agg(*_votes(), F.sum("q").alias("q"))
    return sums.select(*keys, _majority("hi"), _majority("lo"))


def _word_votes(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hi, lo, q) of rows (keys, word): each word counts as often as it occurs."""
    return words.select(*keys, F.xxhash64("word").alias("hi"), F.xxhash64("word", F.lit(1)).alias("lo"), F.lit(1).cast("long").alias("q"))


def fingerprints(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hi, lo): the SimHash of each row's array `window` of words."""
    return simhash(_word_votes(windows.select(*keys, F.explode("window").alias("word")), keys), keys)


def _share(w: Column, m: Column, k: Column) -> Column:
    """A shingle's weight in a fingerprint of m words: the root of w, in parts of 2**30 over all the shingles there can be."""
    return F.floor(F.sqrt(w) * (1 << 30) / (m - k + 1)).cast("long")


def block(hi: Column, lo: Column, i: int) -> Column:
    """The i-th block's value, with the block's number above it."""
    side, at = (hi, i) if i < BLOCKS // 2 else (lo, i - BLOCKS // 2)
    return F.shiftrightunsigned(side, 8 * at).bitwiseAND(F.lit(255)).cast("int") + F.lit(i << 8)


def blocks(hi: Column, lo: Column) -> Column:
    return F.array(*[block(hi, lo, i) for i in range(BLOCKS)])


def near_by_block(hi: Column, lo: Column) -> Column:
    """(nth, near) a block: its number, and its value with those up to FLIPS bits away."""
    flips = F.array(*[F.lit(x) for x in range(256) if x.bit_count() <= FLIPS])
    return F.transform(blocks(hi, lo), lambda b: F.struct(F.shiftright(b, 8).alias("nth"), F.transform(flips, lambda f: b.bitwiseXOR(f)).alias("near")))


def near_blocks(hi: Column, lo: Column) -> Column:
    """Every block value and those up to FLIPS bits away."""
    return F.flatten(near_by_block(hi, lo)["near"])


def hamming(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def _sized(words: Column, size: Column) -> Column:
    """The shingles of `size` words, 1 to SHINGLE, in order."""
    runs = F.when(size == SHINGLE, shingles(words, SHINGLE))
    for k in range(1, SHINGLE):
        runs = runs.when(size == k, shingles(words, k))
    return runs


def _reach(weighted: Column, percent: int) -> Column:
    """(lead, least) of an item's (w, h) by falling weight, rarest shingles first.

    A set with `percent` of the item's weight holds one of the first `lead` shingles, for the
    others together weigh less than that; and it holds `least` shingles at least.
    """
    total = F.aggregate(weighted, F.lit(0.0), lambda a, p: a + p["w"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("lead"), F.lit(0).alias("least"))

    def step(need: Column, spare: Column):
        return lambda a, p: F.struct((a["sum"] + p["w"]).alias("sum"), (a["lead"] + F.when(a["sum"] <= spare, 1).otherwise(0)).alias("lead"), (a["least"] + F.when(a["sum"] < need, 1).otherwise(0)).alias("least"))

    return let(total, lambda t: F.aggregate(weighted, start, step(t * percent / 100 - 1e-6, t * (100 - percent) / 100 + 1e-6), lambda a: F.struct(a["lead"].alias("lead"), a["least"].alias("least"))))


def prepared_items(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Items with words, repeated rows once: item_id, item (its key), m words, k words a shingle, its weighted shingles, their weight in all (in UNITs), lead and least of them, fingerprints of words (hi, lo) and shingles (shi, slo). A shingle's weight is 1 over the items that hold it."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), lower_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"])
    # each table stands before the next reads it several times, else the plan repeats all that is below it
    rows = materialize(rows.withColumn("m", F.size("words")).withColumn("k", F.least(F.col("m"), F.lit(SHINGLE))), "item-words", light=True)
    by_shingle = rows.select("item", "m", "k", F.explode(F.array_distinct(_sized(F.col("words"), F.col("k")))).alias("h"))
    weights = by_shingle.groupBy("h").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    by_shingle = materialize(by_shingle.join(weights, "h").withColumn("units", F.round(F.col("w") * UNIT).cast("long")), "item-shingles", light=True)
    weighted = by_shingle.groupBy("item").agg(F.reverse(F.array_sort(F.collect_list(F.struct("w", "h", "units")))).alias("weighted"), F.sum("units").alias("weight"))
    elements = by_shingle.select("item", F.lit(SHINGLES).alias("kind"), F.col("h").alias("hi"), F.xxhash64("h").alias("lo"), _share(F.col("w"), F.col("m"), F.col("k")).alias("q"))
    words = rows.select("item", F.lit(WORDS).alias("kind"), F.explode("words").alias("word"))
    elements = elements.unionByName(_word_votes(words, ["item", "kind"]))
    prints = materialize(simhash(elements, ["item", "kind"]), "item-prints", light=True)
    of = lambda kind, hi, lo: prints.where(F.col("kind") == kind).select("item", F.col("hi").alias(hi), F.col("lo").alias(lo))
    rows = rows.drop("words").join(weighted, "item").join(of(WORDS, "hi", "lo"), "item").join(of(SHINGLES, "shi", "slo"), "item").withColumn("reach", _reach(F.col("weighted"), percent))
    return materialize(rows.select("item_id", "item", "m", "k", "weighted", "weight", "reach.lead", "reach.least", "hi", "lo", "shi", "slo"), "items")


def _runs(words: Column, sizes: list[int]) -> Column:
    """(pos, h) of a text's shingles of all the sizes."""
    each = [F.transform(shingles(words, k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for k in sizes]
    return F.concat(*each) if each else F.array().cast("array<struct<pos:int,h:bigint>>")


def _starts(at: Column, m: Column, k: Column, least: Column) -> Column:
    """Starts of all windows of m words that hold `least` of the sorted shingle positions `at`.

    The first position a window holds is some at[i], and the window reaches at[i + least - 1].
    """
    first = F.sequence(F.lit(0), F.size(at) - least)

    def of(i: Column) -> Column:
        low = F.greatest(F.get(at, i + least - 1) - (m - k), F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.lit(0))
        return F.when(low <= F.get(at, i), F.sequence(low, F.get(at, i))).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(at) >= least, F.flatten(F.transform(first, of))).otherwise(F.array().cast("array<int>"))


def rolled(stretches: DataFrame, weights: DataFrame) -> DataFrame:
    """Fingerprints and shingle counts of every window at `starts`, by running sums.

    stretches: th, tl, item, m, k, n (the text's words), base, starts (ascending), words from
    base on to the last window's end; weights: item, h, units. Returns th, tl, item, m, n,
    kind, start, hi, lo, and of kind SHINGLES: units that the window shares with the item, its
    distinct shingles `own` and those in `common`. A shingle counts from the start after its
    former place on, so that a window's repeats count once.
    """
    group = ["th", "tl", "item", "base"]
    at = ["m", "k", "n", "last"]
    element = lambda kind, pos, hi, lo, mark: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), hi.alias("hi"), lo.alias("lo"), F.lit(mark).alias("mark"))
    none = F.lit(0).cast("long")
    words = F.transform("words", lambda w, i: element(WORDS, i, F.xxhash64(w), F.xxhash64(w, F.lit(1)), 0))
    runs = F.transform(_sized(F.col("words"), F.col("k")), lambda h, i: element(SHINGLES, i, h, F.xxhash64(h), 0))
    marked_starts = lambda kind: F.transform("starts", lambda s: element(kind, s - F.col("base"), none, none, 1))
    rows = stretches.repartition(*group).withColumn("last", F.array_max("starts") - F.col("base"))
    rows = rows.select(*group, *at, F.explode(F.concat(words, runs, marked_starts(WORDS), marked_starts(SHINGLES))).alias("e")).select(*group, *at, "e.*")
    rows = rows.join(weights.withColumnRenamed("h", "hi").withColumn("kind", F.lit(SHINGLES)), ["item", "kind", "hi"], "left")

    # a marked place has no weight; others enter at `first` and leave after their place
    before = F.lag("pos").over(Window.partitionBy(*group, "kind", "mark", "hi").orderBy("pos"))
    shingle, marked = F.col("kind") == SHINGLES, F.col("mark") == 1
    width = F.when(shingle, F.col("m") - F.col("k")).otherwise(F.col("m") - 1)
    first = F.greatest(F.col("pos") - width, F.when(shingle, F.coalesce(before + 1, F.lit(0))).otherwise(0), F.lit(0))
    rows = rows.withColumn("first", F.when(marked, F.col("pos")).otherwise(first)).where(F.col("first") <= F.col("last"))
    share = F.when(marked, none).when(shingle, _share(F.coalesce(F.col("units") / UNIT, F.lit(1.0)), F.col("m"), F.col("k"))).otherwise(F.lit(1).cast("long"))
    count = F.when(shingle & ~marked, F.lit(1)).otherwise(0).cast("long")
    held = F.col("units").isNotNull() & ~marked
    values = {"q": share, "units": F.when(held, F.col("units")).otherwise(none), "own": count, "common": F.when(held, F.lit(1)).otherwise(0).cast("long")}
    rows = rows.select(*group, "m", "n", "kind", "last", "pos", "first", "hi", "lo", "mark", *[v.alias(name) for name, v in values.items()])
    moves = F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("sign")))
    rows = rows.withColumn("move", F.explode(moves)).where((F.col("move.at") <= F.col("last")) & ((F.col("mark") == 0) | (F.col("move.sign") == 1)))
    signed = [(F.col(v) * F.col("move.sign")).alias(v) for v in values]
    rows = rows.select(*group, "m", "n", "kind", F.col("move.at").alias("at"), "hi", "lo", "mark", *signed)

    sums = [f"{side}{b}" for side in ("hi", "lo") for b in range(32)]
    rows = rows.groupBy(*group, "m", "n", "kind", "at").agg(*_votes(), *[F.sum(v).alias(v) for v in values], F.max("mark").alias("mark"))
    running = Window.partitionBy(*group, "m", "n", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*group, "m", "n", "kind", "at", "mark", *[F.sum(v).over(running).alias(v) for v in [*sums, *values]])
    return rows.where("mark = 1").select("th", "tl", "item", "m", "n", "kind", (F.col("base") + F.col("at")).alias("start"), _majority("hi"), _majority("lo"), "units", "own", "common")


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, carry: Column | None = None) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): items that documents hold.

    One row for each doc_id and item, at its best window (start counts words from 0; windows
    at a text's end may be shorter than the item); where `carry` is given, for each doc_id,
    item and carried string.
    Similarity is the weight of common shingles over the weight of all: a shingle weighs 1
    over the number of items that hold it, outside the item 1. Texts and items compare by
    words, lower-cased over A-Z; null and empty ones match nothing, items of fewer than five
    words match as a whole. Repeated rows give one row; documents without doc_id are
    reported under null. Further columns are ignored.
    """
    items = prepared_items(items, percent)
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(None).cast("string") if carry is None else carry).alias("carried")).withColumn("th", F.xxhash64("text")).withColumn("tl", F.length("text"))
    text = ["th", "tl"]

    # texts that hold one of an item's leading shingles
    lead = items.select("item", F.explode(F.slice("weighted", F.lit(1), F.col("lead"))["h"]).alias("h")).groupBy("h").agg(F.collect_list("item").alias("items"))
    lead = broadcast_if_small(materialize(lead, "leading", light=True), F.lit(48) + 8 * F.size("items"))
    words = keyed.where("tl > 0").select(*text, lower_words(F.col("text")).alias("words"))
    runs = words.select(*text, F.explode(_runs(F.col("words"), sizes)).alias("r")).select(*text, "r.h")
    pairs = materialize(runs.join(lead, "h").select(*text, F.explode("items").alias("item")).distinct(), "pairs", light=True)
    holders = broadcast_if_small(pairs.select(*text).distinct(), 32)
    texts = keyed.where("tl > 0").join(holders, text, "left_semi").groupBy(*text).agg(F.first("text").alias("text"))
    texts = materialize(texts.select(*text, lower_words(F.col("text")).alias("words")), "texts")

    # where those texts hold the items' shingles, and the windows with enough of them
    parts = pairs.join(broadcast_if_small(items.select("item", F.explode("weighted.h").alias("h")), 32), "item")
    runs = texts.select(*text, F.explode(_runs(F.col("words"), sizes)).alias("r")).select(*text, "r.pos", "r.h")
    found = parts.join(runs, [*text, "h"]).groupBy(*text, "item").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    found = found.join(broadcast_if_small(items.select("item", "m", "k", "least"), 48), "item")
    starts = found.select(*text, "item", "m", "k", F.explode(_starts(F.col("at"), F.col("m"), F.col("k"), F.col("least"))).alias("start"))
    rows = starts.groupBy(*text, "item", "m", "k", F.floor(F.col("start") / STRIDE).cast("int").alias("stretch")).agg(F.array_sort(F.collect_set("start")).alias("starts"))
    rows = rows.withColumn("base", F.get("starts", F.lit(0))).drop("stretch")
    rows = rows.join(texts, text).withColumn("n", F.size("words")).withColumn("words", F.slice("words", F.col("base") + 1, F.array_max("starts") - F.col("base") + F.col("m")))
    weights = broadcast_if_small(items.select("item", F.explode("weighted").alias("p")).select("item", "p.h", "p.units"), 40)
    windows = materialize(rolled(rows, weights), "windows")

    place = [*text, "item", "start"]
    kinds = F.array(F.struct(F.lit(WORDS).alias("kind"), F.col("hi").alias("ihi"), F.col("lo").alias("ilo")), F.struct(F.lit(SHINGLES).alias("kind"), F.col("shi").alias("ihi"), F.col("slo").alias("ilo")))
    index = items.select("item", F.explode(kinds).alias("p")).select("item", "p.*").select("*", F.explode(near_by_block(F.col("ihi"), F.col("ilo"))).alias("b")).select("item", "kind", "ihi", "ilo", "b.*")
    probes = windows.select(*place, "kind", "hi", "lo", F.explode(blocks(F.col("hi"), F.col("lo"))).alias("block")).withColumn("nth", F.shiftright("block", 8))
    apart = hamming(F.col("hi"), F.col("lo"), F.col("ihi"), F.col("ilo"))
    side = broadcast_if_small(index, F.lit(64) + 8 * F.size("near"))
    close = probes.join(side, ["item", "kind", "nth"]).where(F.array_contains("near", F.col("block")) & (apart <= RADIUS)).groupBy(*place).agg(F.min(apart).alias("hamming"))

    both = windows.where(F.col("kind") == SHINGLES).join(close, place).join(broadcast_if_small(items.select("item", "item_id", "weight"), 48), "item")
    similarity = F.round(F.col("units") / (F.col("weight") + (F.col("own") - F.col("common")) * UNIT), 9)
    sure = both.select(*text, "item_id", "start", F.least("m", F.col("n") - F.col("start")).alias("n_words"), "hamming", similarity.alias("similarity")).where(F.col("similarity") >= percent / 100)
    best = sure.groupBy(*text, "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "hamming")).alias("b"))
    best = broadcast_if_small(materialize(best, "matches"), 64)
    once = ["doc_id", "item_id", *([] if carry is None else ["carried"])]
    rows = keyed.drop("text").join(best, text).groupBy(*once).agg(F.min("b").alias("b"))
    return rows.select(*once, F.col("b.start").cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.hamming").alias("hamming"), (-F.col("b.s")).alias("similarity"))


def op7_simhash_windows(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
