"""File sources and sinks with fixed schemas."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files: path, text, pages (top headings, 1 at least)."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("pages", F.greatest(F.regexp_count("text", F.lit(r"(?m)^# ")), F.lit(1)))


def ocr_markdown(spark: SparkSession, path: str) -> DataFrame:
    """OCR results kept as markdown: path, text, pages by their page comments."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("pages", F.greatest(F.regexp_count("text", F.lit(r"<!--\s*Page")), F.lit(1)))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=multi_line, mode="FAILFAST")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word_paragraphs(content: bytes) -> list[tuple[int, str, str, int | None]]:
    """(index, style, text, heading level) of a .docx file's paragraphs; unreadable content gives none."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for i, p in enumerate(root.iter(f"{_W}p")):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else "Normal"
        level = re.fullmatch(r"Heading ?([1-9])", name)
        out.append((i, name, "".join(t.text or "" for t in p.iter(f"{_W}t")), int(level[1]) if level else None))
    return out


def word(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of .docx files: path, idx, style, text, level."""

    def run(batches):
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in word_paragraphs(c)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["path", "idx", "style", "text", "level"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, idx int, style string, text string, level int")


def database(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A JDBC table or query; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """A backup: rows of each table as JSON, and a manifest of schemas and counts."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = [(name, df.schema.json(), df.count()) for name, df in tables.items()]
    spark.createDataFrame(manifest, "name string, schema string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest_")


def restore_json(spark: SparkSession, path: str, only: list[str] | None = None, dry_run: bool = False) -> dict:
    """Tables of a backup by name (or their counts in a dry run)."""
    from pyspark.sql.types import StructType
    import json as j

    manifest = {r["name"]: r for r in spark.read.schema("name string, schema string, n long").json(f"{path}/_manifest_").collect()}
    wanted = [n for n in manifest if only is None or n in only]
    if dry_run:
        return {n: manifest[n]["n"] for n in wanted}
    return {n: spark.read.schema(StructType.fromJson(j.loads(manifest[n]["schema"]))).json(f"{path}/{n}") for n in wanted}


def repaired_dates(df: DataFrame) -> DataFrame:
    """String columns with "YYYY-MM-DD HH:MM:SS" values in the ISO form."""
    fix = lambda c: F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})", "$1T$2")
    return df.select(*[fix(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append rows as Parquet; tasks commit their files atomically."""
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def migrate(df: DataFrame, path: str, ints: list[str]) -> int:
    """Copy a table with columns cast to integers where they can be, and check the count."""
    out = df.withColumns({c: F.col(c).try_cast("int") for c in ints})
    out.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if n != df.count():
        raise RuntimeError("the copy lacks rows")
    return n


def conversation_markdown(messages: DataFrame) -> DataFrame:
    """One markdown text a conversation, turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("**"), "role", F.lit("**: "), "text").alias("t"))))
    return messages.groupBy("conv_id").agg(F.concat(F.lit("# Conversation "), F.first("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n")).alias("value"))
