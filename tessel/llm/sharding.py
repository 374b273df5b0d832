"""Fixed virtual slots: records hash into slots, slots map to shards, only the map is edited.

A record's slot never changes. What changes is a small versioned table
(version, vslot, shard) with one row per slot, so moving load or adding a shard
edits a few rows instead of rehashing the corpus. Every version of the map is stored, and
records are placed by the version that is read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import materialize, shared_dir

SLOTS = 4096
#: Copies of a row dealt out of one row at a time.
COPIES = 4096


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows of docs as (doc_id, size, text_crc32, vslot).

    size is the UTF-8 bytes of the text plus 1 (a null text counts as empty). The slot comes
    from doc_id, the text's checksum and the copy's number among equal rows, so neither a
    repeated doc_id nor a repeated row fills a slot. Equal rows are counted before they are
    shuffled, and dealt out again afterwards, COPIES at a time. Other columns of docs,
    whatever their names, are not carried.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    some = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    last = F.least(F.col("n"), (F.col("lot") + 1) * COPIES) - 1
    each = some.withColumn("copy", F.explode(F.sequence(F.col("lot") * COPIES, last)))
    slot = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), "text_crc32", "copy"), F.lit(slots)).cast("int")
    return each.select("doc_id", "size", "text_crc32", slot.alias("vslot"))


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of the slots that hold records; partial sums come before the shuffle."""
    return slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _all_slots(load: DataFrame, slots: int) -> DataFrame:
    spark = load.sparkSession
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot")).join(load, "vslot", "left").na.fill(0, ["bytes", "rows"])


def _place(ordered, loads, shards: int):
    """Fold slots (bytes, vslot) over shard loads: each goes to the lightest shard, ties to the lowest number."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("put"))

    def step(acc, slot):
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        loads = F.transform(acc["loads"], lambda x, i: F.when(i == to, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(acc["put"], F.array(F.struct(slot["vslot"].alias("vslot"), to.alias("shard")))).alias("put"))

    return F.aggregate(ordered, start, step, lambda acc: acc["put"])


def first_map(load: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: the largest slots first, each to the lightest shard.

    The fold runs over one row that holds `slots` pairs whatever the corpus size.
    """
    by_size = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", (-F.col("vslot")).alias("neg")))))
    pairs = _all_slots(load, slots).groupBy().agg(by_size.alias("s"))
    slots_by_size = F.transform("s", lambda x: F.struct(x["bytes"].alias("bytes"), (-x["neg"]).cast("int").alias("vslot")))
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    return pairs.select(F.explode(_place(slots_by_size, zero, shards)).alias("p")).select(F.lit(1).alias("version"), "p.vslot", "p.shard")


def rebalanced(slot_map: DataFrame, load: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The next version of the map for `shards` shards, moving as little as it can.

    Each old shard keeps a prefix of its slots (largest first) whose bytes fit the new
    mean; only what exceeds it moves, largest first, to the lightest shard. Where shards are
    added, slots move only into them. Rows are all slots, `moved` marks edits.
    """
    mean = F.greatest(F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards), F.lit(1))
    run = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    held = (
        _all_slots(load, slots)
        .join(slot_map.select("version", "vslot", F.col("shard").alias("shard")), "vslot")
        .withColumn("mean", mean)
        .withColumn("stays", ((F.sum("bytes").over(run) <= F.col("mean")) | (F.col("bytes") == 0)) & (F.col("shard") < shards))
    )
    rows = held.groupBy().agg(
        F.max("version").alias("version"),
        F.max("shard").alias("last"),
        F.reverse(F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", (-F.col("vslot")).alias("neg")))))).alias("out"),
        F.collect_list(F.when(F.col("stays"), F.struct("bytes", "shard"))).alias("kept"),
        F.collect_list(F.struct("vslot", "shard")).alias("old"),
    )
    closed = lambda s: (F.col("last") < shards - 1) & (s <= F.col("last"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.when(closed(s), F.lit(1 << 60).cast("long")).otherwise(F.aggregate("kept", F.lit(0).cast("long"), lambda a, k: F.when(k["shard"] == s, a + k["bytes"]).otherwise(a))))
    out = F.transform("out", lambda x: F.struct(x["bytes"].alias("bytes"), (-x["neg"]).cast("int").alias("vslot")))
    edits = rows.select("version", F.explode(_place(out, loads, shards)).alias("p")).select((F.col("version") + 1).alias("nv"), "p.vslot", F.col("p.shard").alias("to"))
    return (
        slot_map.join(edits.select("vslot", "to"), "vslot", "left")
        .select(
            (F.col("version") + 1).alias("version"),
            "vslot",
            F.coalesce("to", "shard").alias("shard"),
            (F.col("to").isNotNull() & (F.col("to") != F.col("shard"))).alias("moved"),
        )
    )


def assign(slotted: DataFrame, slot_map: DataFrame, load: DataFrame) -> DataFrame:
    """Every record with its shard and its place there, gapless from 0.

    Places come slot by slot: a slot's first place is the count of rows in the shard's
    earlier slots (a window over the small map), and a row's place in its slot a row
    number over (vslot), so no task sorts more than a slot.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.join(load, "vslot").select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = slotted.withColumn("n", F.row_number().over(inside) - 1)
    return placed.join(F.broadcast(offsets), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("n")).cast("long").alias("slot"))


def store_map(slot_map: DataFrame, path: str) -> int:
    """Append a version of the map to the table at path and return its number; versions that stand are never rewritten."""
    version = slot_map.agg(F.max("version")).head()[0]
    slot_map.select("vslot", "shard").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return version


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(version, vslot, shard) of a stored version, by default of the last one."""
    every = spark.read.parquet(path).select(F.col("version").cast("int").alias("version"), "vslot", "shard")
    last = every.agg(F.max("version")).head()[0] if version is None else version
    return every.where(F.col("version") == last)


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """docs dealt into `shards` shards of near-equal bytes through a slot map of version 1, stored at path.

    Records are read once; their sizes and slots are written, and the load and the places
    come from that table. Without a path the map goes to a new table in the shared folder.
    Empty tables give no rows; repeated rows are dealt like any others. The broadcast map
    has `slots` rows whatever the corpus size.
    """
    spark = docs.sparkSession
    slotted = materialize(with_slots(docs, slots), "slotted")
    load = materialize(slot_bytes(slotted), "load", light=True)
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    version = store_map(first_map(load, shards, slots), path)
    return assign(slotted, stored_map(spark, path, version), load)


def op5_virtual_slots(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
