"""The corpus pipeline: five operators in a row, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import broadcast_if_small, drop_tables, materialize, table, tables_written
from tessel.llm.decontamination import contaminated
from tessel.llm.neardup import near_duplicates
from tessel.llm.packing import pack, tokenizer_path
from tessel.llm.secrets import redact, scan
from tessel.llm.toxicity import toxicity

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _text_key(column: str = "text") -> Column:
    """What stands for a whole text in joins, 128 bits; a null text counts as empty."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def _unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _without_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs whose text is not among keys (one column of text keys), whatever their doc_ids."""
    key = _unused(docs, "text_key")
    gone = broadcast_if_small(keys.toDF(key).distinct(), 64)
    return docs.withColumn(key, _text_key()).join(gone, key, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model does not predict toxic. Scores depend on the text alone, so rows go by text, with or without a doc_id."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), carry=_text_key())
    return _without_texts(docs, scored.where("predicted = 1").select("carried"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id, then of the first place in the table.

    Rows are told apart by their place, so neither different texts under one doc_id nor
    texts without doc_id are lost; texts without words all stay.
    """
    row = _unused(docs, "row_key")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    grouped = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), key="doc_id")
    members = keyed.select(F.col("doc_id").cast("long").alias("id"), F.col(row).alias("place")).join(grouped.select(F.col("doc_id").alias("place"), "component_id"), "place")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first"))
    kept = materialize(first.select(F.col("first.place").alias(row)), "kept", light=True)
    return keyed.join(broadcast_if_small(kept, 16), row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; they too go by text."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), carry=_text_key())
    return _without_texts(docs, found.select("carried"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret found in them replaced by a mark and n_chars brought up to date.

    A text's secrets are gathered once, however many rows hold the text.
    """
    key, cores = _unused(docs, "text_key"), _unused(docs, "secret_cores")
    secrets = scan(docs, carry=_text_key()).where("is_secret").groupBy("carried").agg(F.collect_set("core").alias("found"))
    held = materialize(secrets.toDF(key, cores), "secrets")
    side = broadcast_if_small(held, F.lit(96) + F.aggregate(cores, F.lit(0), lambda a, c: a + F.octet_length(c) + 8))
    rows = docs.withColumn(key, _text_key()).join(side, key, "left")
    none = F.col(cores).isNull()
    changed = {"text": F.when(none, F.col("text")).otherwise(redact(F.col("text"), F.col(cores)))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(none, F.col("n_chars")).otherwise(F.length(changed["text"]).cast(docs.schema["n_chars"].dataType))
    return rows.withColumns(changed).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is a table that the next one reads.

    What a stage wrote on its way is deleted once its result stands, and so is the result
    before it.
    """
    docs, before = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(spark, before, -1)
    return docs
