"""Collections that persist: versioned tables of Parquet parts under one folder.

A collection is a folder with parts (Parquet) and numbered versions (small JSON files that
name the parts a version holds, its key and its schema). The highest number is the current
version. A writer first writes its part, then creates the next number, which fails if another
writer was first. So a reader never sees half a write, a failed or killed write leaves the
version before, an append writes its own rows only, and the same write can be repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the next version first, or rows with these keys are stored already."""


class Store:
    """The collections under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # files, through the session's file systems
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self, name: str) -> list[int]:
        return [int(f[1:-5]) for f in self._names(f"{self.root}/{name}/_versions") if f.startswith("v") and f.endswith(".json")]

    def _commit(self, name: str, number: int, held: dict) -> int:
        path = self._path(f"{self.root}/{name}/_versions/v{number:06d}.json")
        fs = self._fs(path)
        # the file is written aside and renamed, so that a version is whole once it is there
        aside = self._path(f"{self.root}/{name}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(held), "utf-8"))
        out.close()
        if fs.exists(path) or not fs.rename(aside, path):
            fs.delete(aside, False)
            raise Conflict(f"version {number} of {name} was written by another")
        return number

    def _held(self, name: str, version: int | None = None) -> tuple[int, dict]:
        numbers = self._numbers(name)
        number = version if version is not None else max(numbers, default=0)
        if number not in numbers:
            raise KeyError(f"no collection {name}" if not numbers else f"no version {number} of {name}")
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/{name}/_versions/v{number:06d}.json").collect())
        return number, json.loads(text)

    def _part(self, name: str, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{part}")
        return part

    # collections
    def collections(self) -> list[str]:
        return [n for n in self._names(self.root) if self._numbers(n)]

    def create(self, name: str, schema: str | StructType, key: str | None = None) -> bool:
        """Make an empty collection; false, and nothing changes, where it is there already."""
        if self._numbers(name):
            return False
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        try:
            self._commit(name, 1, {"parts": [], "key": key, "schema": schema.jsonValue()})
        except Conflict:
            return False
        return True

    def drop(self, name: str) -> bool:
        """Delete a collection with all its versions; false where there is none."""
        path = self._path(f"{self.root}/{name}")
        return bool(self._fs(path).delete(path, True))

    def verify(self, expected: list[str]) -> dict[str, list[str]]:
        """Expected collections by what they are: found, missing, and those there are beyond them."""
        have = self.collections()
        return {"found": [n for n in expected if n in have], "missing": [n for n in expected if n not in have], "unexpected": [n for n in have if n not in expected]}

    def versions(self, name: str) -> list[int]:
        return self._numbers(name)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A collection as it stands, or as it stood at a version."""
        _, held = self._held(name, version)
        schema = StructType.fromJson(held["schema"])
        if not held["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in held["parts"]])

    def insert(self, name: str, df: DataFrame, existing: str = "refuse") -> int:
        """Append rows and return the new version. Columns that df lacks are null.

        In a collection with a key, rows whose key is stored or repeated are refused, all of
        them, with a Conflict; existing="skip" leaves out those stored (of repeated ones it
        takes the least row), so a write can be repeated. A null key is refused.
        """
        number, held = self._held(name)
        schema, key = StructType.fromJson(held["schema"]), held["key"]
        extra = set(df.columns) - set(schema.names)
        if extra:
            raise ValueError(f"{name} has no columns {sorted(extra)}")
        rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        if key:
            if not rows.where(F.col(key).isNull()).isEmpty():
                raise Conflict(f"rows without {key}")
            stored = self.read(name, number).select(key)
            if existing == "skip":
                rest = [c for c in rows.columns if c != key]
                rows = rows.join(stored, key, "left_anti").groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*") if rest else rows.join(stored, key, "left_anti").distinct()
                rows = rows.select(*schema.names)
            else:
                again = rows.groupBy(key).count().where("count > 1").select(key).unionByName(rows.select(key).join(stored, key, "left_semi"))
                if not again.isEmpty():
                    raise Conflict(f"{key} is stored already or repeated")
        part = self._part(name, rows)
        return self._commit(name, number + 1, held | {"parts": [*held["parts"], part]})

    def migrate(self, name: str, change: Callable[[DataFrame], DataFrame], checks: dict[str, Callable[[DataFrame, DataFrame], bool]] | None = None) -> int:
        """Rewrite a collection, verify the copy, and only then make it the current version.

        The copy must hold as many rows as the original, keys as before, and pass every check
        (of the old and the new table). Otherwise a ValueError names what failed and the
        version before stays; so it does if the run is killed, and it can be started again.
        """
        number, held = self._held(name)
        old = self.read(name, number)
        changed = change(old)
        part = self._part(name, changed)
        new = self.spark.read.schema(changed.schema).parquet(f"{self.root}/{name}/{part}")
        key = held["key"]
        rules = {"as many rows": lambda a, b: a.count() == b.count()}
        if key:
            rules["the same keys"] = lambda a, b: a.select(key).exceptAll(b.select(key)).isEmpty()
        for what, holds in (rules | (checks or {})).items():
            if not holds(old, new):
                raise ValueError(f"migration of {name}: {what} does not hold")
        return self._commit(name, number + 1, held | {"parts": [part], "schema": changed.schema.jsonValue()})


def echoed(df: DataFrame, text: str, most: int = 100) -> DataFrame:
    """What an insertion reports: each row's text, cut to `most` characters with a mark where more follows."""
    return df.withColumn("echo", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(F.col(text)))


def chunk_artefacts(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One JSON text a document, its columns and its chunks in order (chunks: key, chunk_no, ...): what a `_chunks.json` holds. A document without chunks has an empty list."""
    rest = [c for c in chunks.columns if c != key]
    held = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", *[c for c in rest if c != "chunk_no"]))).alias("chunks"))
    rows = documents.join(held, key, "left")
    empty = F.array().cast(held.schema["chunks"].dataType)
    body = F.to_json(F.struct(*documents.columns, F.coalesce("chunks", empty).alias("chunks"), F.lit("2.0").alias("pipeline_version")))
    return rows.select(key, F.concat(F.col(key).cast("string"), F.lit("_chunks.json")).alias("file"), body.alias("value"))


def occasion_logs(occasions: DataFrame) -> DataFrame:
    """Occasions (occasion_id, ...) as they are logged: file name by the number in six digits, and the row as JSON."""
    return occasions.select("occasion_id", F.concat(F.lit("occasion_"), F.lpad(F.col("occasion_id").cast("string"), 6, "0"), F.lit(".json")).alias("file"), F.to_json(F.struct(*occasions.columns)).alias("value"))


def log_occasions(store: Store, occasions: DataFrame, name: str = "occasions") -> int:
    """Append the logs of occasions that are not logged yet; a batch that is played again writes none of them twice."""
    store.create(name, "occasion_id bigint, file string, value string", "occasion_id")
    return store.insert(name, occasion_logs(occasions), existing="skip")
