"""MinHash near-duplicates with odd sketches.

Documents with equal shingle sets form classes. Classes are banded by MinHash; the
samples are also folded into a parity bitmap (the odd sketch) whose XOR population count
estimates high similarities closely enough to drop most false candidates. A second odd
sketch folds the whole set: its odd bits never exceed the two sets' symmetric difference,
so a pair with more of them than the threshold allows is no link, for certain. Surviving
pairs are confirmed on the full shingle sets.

Links are needed only for connected components, so pairs whose ends are connected already
are never compared, and no group is expanded into all its pairs.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import broadcast_if_small, free_caches, jaccard_at_least, materialize, mix64, shingle_set
from tessel.llm.components import components, merged, with_component

#: Rows a band and bands: a pair of similarity 0.75 is missed with probability (1 - 0.75**5)**44 < 7e-6.
BAND_ROWS, BANDS = 5, 44
#: MinHash samples the odd sketch folds; the first BAND_ROWS * BANDS of them are banded.
SAMPLES = 960
#: Bits of the odd sketch.
SKETCH_BITS = 2048
#: What an estimate may fall short of the threshold: five of its standard deviations at 0.75 (0.017: samples and sketch together).
SLACK = 0.084

#: Shingles of left sides that a worker remembers while it confirms pairs.
HELD_SHINGLES = 250_000
#: Rows of a bucket's side that one task of the last join meets with its other side.
BUCKET_PART = 4096

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_FOLD = _rng.integers(0, 1 << 63, BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_BLOCK = 2048


def minhash(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a non-empty set of shingle hashes."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), _BLOCK):
        part = short[None, i : i + _BLOCK] ^ _XOR[:, None]
        part *= _MUL[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key for each band; bands never share keys but by chance."""
    rows = samples[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    return mix64(mix64(rows * _FOLD).sum(axis=1) + _SALT[:BANDS])


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the set {(i, sample i)} as SKETCH_BITS / 64 words."""
    at = mix64(samples.astype(np.uint64) + _SALT) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def whole_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity bitmap of a whole set; its XOR with another's has at most |a ^ b| odd bits."""
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def similarity_estimate(odd_bits: int) -> float:
    """Similarity estimated from the population count of two sketches' XOR."""
    rest = 1 - 2 * odd_bits / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(rest) if rest > 0 else 0.0


def most_odd_bits(threshold: float) -> int:
    """The largest XOR population count whose estimate reaches the threshold."""
    return max(n for n in range(SKETCH_BITS // 2) if similarity_estimate(n) >= threshold)


_SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.large_string()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64()))])


def _sign(batches):
    """Arrow batches (doc_id, text) or (doc_id, text, key) -> _SIGNED. A row's number is its key, or else its partition and place in it; only without keys the text is kept."""
    free_caches()
    row = TaskContext.get().partitionId() << 40
    names = ("k1", "k2", "bands", "sketch", "whole")
    for batch in batches:
        out = {name: [] for name in ("n", *names)}
        for text in batch.column(1).to_pylist():
            have = shingle_set(text)
            out["n"].append(len(have))
            if not len(have):
                for name in names:
                    out[name].append(None)
                continue
            samples = minhash(have)
            out["k1"].append(int(have.sum().astype(np.int64)))
            out["k2"].append(int(mix64(have).sum().astype(np.int64)))
            out["bands"].append(band_keys(samples).astype(np.int64))
            out["sketch"].append(odd_sketch(samples).astype(np.int64))
            out["whole"].append(whole_sketch(have).astype(np.int64))
        n = batch.num_rows
        if batch.num_columns > 2:
            rows, kept = batch.column(2), pa.nulls(n, pa.large_string())
        else:
            rows, kept = pa.array(np.arange(row, row + n, dtype=np.int64)), batch.column(1).cast(pa.large_string())
            row += n
        made = [pa.array(out[name], _SIGNED.field("n_shingles" if name == "n" else name).type) for name in ("n", *names)]
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), kept, *made], schema=_SIGNED)


_SIGNED_SQL = "row long, doc_id long, text string, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>, whole array<long>"


def _confirm(percent: int):
    def run(batches):
        free_caches()
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if a not in held:
                    if sum(map(len, held.values())) > HELD_SHINGLES:
                        held.clear()
                    held[a] = shingle_set(ta)
                if jaccard_at_least(held[a], shingle_set(tb), percent):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, as a table."""
    ends = materialize(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "ends", light=True)
    need = broadcast_if_small(ends, 16)
    texts = materialize(rows.select("row", "text").join(need, "row", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a")
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long"), "linked")


def _odd_bits(a: str, b: str, sketch: str):
    """The population count of the XOR of sides a's and b's sketches."""
    return reduce(add, [F.bit_count(F.get(f"{a}.{sketch}", F.lit(i)).bitwiseXOR(F.get(f"{b}.{sketch}", F.lit(i)))) for i in range(SKETCH_BITS // 64)])


def _close(a: str, b: str, percent: int):
    """Whether sizes and both odd sketches of sides a and b allow the similarity; the estimate's odd bits.

    Of sizes m and n, similarity t leaves a symmetric difference of at most (m + n) (1 - t) / (1 + t).
    """
    m, n = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = 100 * F.least(m, n) >= percent * F.greatest(m, n)
    whole = (100 + percent) * _odd_bits(a, b, "whole") <= (100 - percent) * (m + n)
    bits = _odd_bits(a, b, "sketch")
    return sizes & whole & (bits <= most_odd_bits(percent / 100 - SLACK)), bits


def near_duplicates(docs: DataFrame, percent: int = 75, key: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id connected by links of `percent` similarity or more.
    Null, empty and word-less texts have an empty set and are linked with nothing; texts of
    fewer than five words have one shingle of all their words. Repeated rows fall into one
    class. A component of rows without doc_ids has a null component_id and is kept.
    Columns other than doc_id and text are ignored, but for key: it may name a column of
    numbers, each once, of a table that is read alike every time, and saves a copy of the texts.

    First each class is compared with the most collided class of every band bucket it
    shares; then the closest pair of each two components that share a bucket; then all
    pairs of such buckets whose ends are still apart. No bucket is capped: beyond
    BUCKET_PART classes its one side is dealt over tasks, each of which meets the other
    side whole. Shingles are compared by 64-bit hashes; two different ones of n in a corpus
    collide with probability below n**2 / 2**64 and only then count as one.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(key).cast("long").alias("row")] if key else []))
    signed = materialize(read.mapInArrow(_sign, _SIGNED_SQL), "signed")
    rows = read if key else signed
    ids = signed.select("row", "doc_id", "n_shingles", "k1", "k2")
    classes = materialize(ids.where("k1 is not null").groupBy("k1", "k2").agg(F.min("row").alias("cls"), F.min("doc_id").alias("low")), "classes", light=True)
    reps = materialize(signed.select("row", "n_shingles", "bands", "sketch", "whole").join(broadcast_if_small(classes.select(F.col("cls").alias("row")), 16), "row", "left_semi"), "reps")
    one = reps.select("row", F.posexplode("bands").alias("band", "key"))
    shared = materialize(one.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets", light=True)
    met = materialize(one.join(broadcast_if_small(shared, 24), "key"), "met")
    degree = met.groupBy("row").agg(F.sum("size").alias("degree"))
    met = materialize(met.join(degree, "row"), "members")
    # each bucket's most collided class, ties to the smallest row
    heads = met.groupBy("key").agg(F.max(F.struct("degree", (-F.col("row")).alias("neg"))).alias("top")).select("key", (-F.col("top.neg")).alias("head"))
    spokes = met.join(heads, "key").where("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b")).distinct()
    sides = reps.select("row", "n_shingles", "sketch", "whole")
    ok, _ = _close("x", "y", percent)
    pairs = materialize(spokes.join(sides.alias("y"), F.col("b") == F.col("y.row")).join(sides.alias("x"), F.col("a") == F.col("x.row")).where(ok).select("a", "b"), "spokes")
    labels = components(_linked(pairs, rows, percent))

    # buckets whose classes are still apart: a pair of two components has a side outside the bucket's main one
    left = with_component(met, labels, "row", "comp")
    apart = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("degree", "comp")).alias("top"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", F.col("top.comp").alias("main"), F.ceil(F.col("size") / BUCKET_PART).cast("int").alias("parts"))
    rest = left.select("key", "band", "row", "comp").join(broadcast_if_small(apart, 28), "key")
    rest = materialize(rest.join(reps, "row"), "apart")
    ok, bits = _close("x", "y", percent)
    outer = (F.col("x.comp") != F.col("x.main")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.row") < F.col("y.row")))
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda u, v: u == v), F.lit(True)) == F.col("x.band") + 1
    some = rest.where("comp <> main").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    every = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = some.alias("x").join(every.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.comp") != F.col("y.comp")) & outer & ok & first)
    found = found.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b"), F.least("x.comp", "y.comp").alias("ca"), F.greatest("x.comp", "y.comp").alias("cb"), bits.alias("bits"))
    found = materialize(found.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    best = materialize(found.groupBy("ca", "cb").agg(F.min(F.struct("bits", "a", "b")).alias("m")).select("m.a", "m.b"), "best", light=True)
    for step in ("best", "all"):
        if step == "best":
            pairs = best
        else:
            pairs = with_component(with_component(found.select("a", "b"), labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b")
            pairs = materialize(pairs.join(best, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        more = _linked(pairs, rows, percent)
        if not more.isEmpty():
            labels = merged(labels, more)

    grouped = classes.join(labels.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = grouped.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = materialize(grouped.join(lowest, "comp").select("k1", "k2", "component_id"), "named", light=True)
    out = ids.join(broadcast_if_small(named, 32), ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op6_minhash_odd_sketch(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
