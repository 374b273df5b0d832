"""The supplied tables in the roles of the engine's collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.vector import doubles


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors: id, text, language, work_title, author, section_path, order_index, vector."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.join(e, d.doc_id == e.vec_id).select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), F.col("source").alias("work_title"),
        F.concat(F.lit("author "), F.col("label")).alias("author"),
        F.concat(F.lit("Part "), F.col("label"), F.lit(" > "), F.col("source")).alias("section_path"),
        F.col("doc_id").alias("order_index"), F.col("label"), doubles(F.col("embedding")).alias("vector"),
    )


#: chunks() in DuckDB, for the oracles.
CHUNKS_SQL = """(SELECT doc_id AS id, text, lang AS language, source AS work_title, 'author ' || label AS author,
 'Part ' || label || ' > ' || source AS section_path, doc_id AS order_index, label, embedding::DOUBLE[] AS vector
 FROM documents JOIN embeddings ON doc_id = vec_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors only: id, label, vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles(F.col("embedding")).alias("vector"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors() of the type they are stored as, half the bytes to move; for operators that widen them in their tasks."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


def tensor(spark: SparkSession, sf_dir: str, dims: int = 8) -> DataFrame:
    """State tensors in long form: state_id, dim, v; the incomplete last state is dropped."""
    v = vectors(spark, sf_dir)
    rows = v.select(F.floor(F.col("id") / dims).cast("long").alias("state_id"), (F.col("id") % dims).cast("int").alias("dim"), F.col("vector").alias("v"))
    whole = rows.groupBy("state_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == dims).select("state_id")
    return rows.join(whole, "state_id", "left_semi")


TENSOR_SQL = """(SELECT state_id, dim, v FROM (SELECT vec_id // 8 AS state_id, (vec_id % 8)::INT AS dim, embedding::DOUBLE[] AS v,
 count(*) OVER (PARTITION BY vec_id // 8) AS n FROM embeddings) WHERE n = 8)"""
