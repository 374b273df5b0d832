"""Model calls as pluggable providers with deterministic offline stand-ins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessel.functions import text as T

Embed = Callable[[list[str]], np.ndarray]


def hashed_bag(texts: list[str], width: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: equal texts get equal vectors, texts with common words are near."""
    out = np.zeros((len(texts), width))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode("utf-8", "replace"))
            out[i, h % width] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embedded(df: DataFrame, text: str = "text", provider: Embed = hashed_bag, batch: int = 48, name: str = "vector") -> DataFrame:
    """df with vectors of its texts; equal texts are embedded once, in batches the provider can hold."""

    def run(batches):
        # a provider's batch at a time, so a task never holds an Arrow batch's texts as Python strings
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                b = whole.slice(i, batch)
                rows = provider([t or "" for t in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([v.tolist() for v in rows], pa.list_(pa.float64()))], names=["_key", "_n", name])

    # texts meet by digest and length, so that no join or sort compares whole texts
    keyed = df.withColumn("_key", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).withColumn("_n", F.coalesce(F.length(text), F.lit(-1)))
    once = keyed.groupBy("_key", "_n").agg(F.any_value(text).alias("_text"))
    vectors = once.select("_text", "_key", "_n").mapInArrow(run, f"_key string, _n int, {name} array<double>")
    return keyed.join(vectors, ["_key", "_n"], "left").drop("_key", "_n")


def answered(df: DataFrame, prompt: str, provider: Callable[[str], str], retries: int = 3, name: str = "answer") -> DataFrame:
    """df's prompts with a language model's answers; a call that keeps failing gives null."""

    def one(p: str | None) -> str | None:
        for _ in range(retries):
            try:
                return provider(p or "")
            except Exception:  # noqa: BLE001  a provider's failure is a null answer
                continue
        return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(p) for p in b.column(b.schema.get_field_index(prompt)).to_pylist()], pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, StringType())]))


def tagged_answer(prompt: str) -> str:
    """The offline stand-in: the prompt's first words as a JSON answer."""
    words = [w for w in prompt.split() if w.isalpha()][:5]
    return "<JSON>\n" + '{"concepts": [' + ", ".join(f'"{w.lower()}"' for w in words) + "]}\n</JSON>"


def concepts(df: DataFrame, text: str, provider: Callable[[str], str] = tagged_answer) -> DataFrame:
    """df with up to five concepts a text, read from a model's JSON answer; none where it can't be read."""
    rows = answered(df, text, provider)
    return rows.withColumn("concepts", T.json_list(T.json_block(F.col("answer")))).drop("answer")


def contradiction_scores(df: DataFrame, a: str, b: str) -> DataFrame:
    """The offline stand-in of an entailment model: a negation in one text only speaks for a contradiction."""
    negated = lambda c: F.lower(c).rlike(r"\b(?:not|no|never|ne|pas|nicht|kein|nunca|jamais)\b")
    return df.withColumn("nli", F.when(negated(F.col(a)) != negated(F.col(b)), 0.9).otherwise(0.1))


def standardised(df: DataFrame, vector: str = "vector"):
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("raw", array_to_vector(vector))
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)


def classified(df: DataFrame, label: str = "label") -> DataFrame:
    """df with the label a logistic regression on scaled vectors predicts."""
    from pyspark.ml.classification import LogisticRegression

    rows = standardised(df)
    return LogisticRegression(labelCol=label, featuresCol="features", maxIter=50, regParam=0.01).fit(rows).transform(rows)


def clustered(df: DataFrame, k: int = 24, seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    rows = standardised(df)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)


def projected(df: DataFrame, k: int = 2) -> DataFrame:
    """df with principal components, the linear stand-in for a two-dimensional map."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = standardised(df)
    return PCA(k=k, inputCol="features", outputCol="pc").fit(rows).transform(rows).withColumn("pc", vector_to_array("pc"))
