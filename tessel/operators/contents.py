"""Tables of contents: from layout boxes, from trees of any depth, and lookups in their order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.operators.fold import ordered_fold


def layout_lines(boxes: DataFrame, key: str, tolerance: float = 0.01, pages: int | None = 8) -> DataFrame:
    """Boxes of recognised text (key, page, x, y, text) merged into lines in reading order: key, page, line, x, text.

    Down a page a line ends where the next box starts more than `tolerance` below the box
    before it. A line starts at its leftmost box, and its boxes are read from left to right.
    Pages count from 1; contents stand on the first `pages` (None: all). Boxes without text
    are ignored.
    """
    rows = boxes.where(F.length(F.trim("text")) > 0)
    rows = rows if pages is None else rows.where(F.col("page") <= pages)
    down = Window.partitionBy(key, "page").orderBy("y", "x", "text")
    new = (F.col("y") - F.lag("y").over(down) > tolerance).cast("int")
    lines = rows.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("line", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    # a line holds the boxes of one strip of one page
    across = F.array_sort(F.collect_list(F.struct("x", "y", F.trim("text").alias("text"))))
    return lines.groupBy(key, "page", "line").agg(F.min("x").alias("x"), F.array_join(F.transform(across, lambda b: b["text"]), " ").alias("text"))


def contents_entries(lines: DataFrame) -> DataFrame:
    """Lines that name a page: title without leader dots, and page_number; all else goes."""
    entry = r"^(.*\S)(?:\s*\.{2,}\s*|\s+)(\d+)\s*$"
    rows = lines.where(F.col("text").rlike(entry))
    title = F.trim(F.regexp_replace(F.regexp_extract("text", entry, 1), r"[\s.]*\.{2,}\s*$", ""))
    return rows.withColumn("title", title).withColumn("page_number", F.regexp_extract("text", entry, 2).cast("int")).where("title <> ''")


def indentation_levels(entries: DataFrame, key: str, gap: float = 0.03) -> DataFrame:
    """entries with level: positions (x) of a document closer than `gap` to the one before form a group; an entry is of the group whose mean is nearest, the leftmost being level 1.

    Groups start at least `gap` apart, so a page of width 1 has at most 1 / gap of them.
    """
    spots = entries.select(key, "x").distinct()
    order = Window.partitionBy(key).orderBy("x")
    groups = spots.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(order) >= gap).cast("int"), F.lit(0))).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    means = groups.groupBy(key, "group").agg(F.avg("x").alias("mean")).groupBy(key).agg(F.array_sort(F.collect_list("mean")).alias("means"))
    nearest = F.array_min(F.transform("means", lambda m, i: F.struct(F.abs(m - F.col("x")).alias("far"), (i + 1).alias("level"))))["level"]
    means = means.withColumnRenamed(key, "_key")
    return entries.join(means, F.col(key).eqNullSafe(F.col("_key"))).withColumn("level", nearest.cast("int")).drop("means", "_key")


def nested(entries: DataFrame, key: str, order: list[str], separator: str = " > ") -> DataFrame:
    """Per entry (key, order, level, title, page_number): nth, title, page_number, level, parent_title, path.

    An entry lies under the nearest earlier one of a lower level. Entries stream by a stack
    of open ones, at most one a level.
    """
    kind = entries.schema[key].dataType.simpleString()

    def step(state: tuple[int, list] | None, row: dict) -> tuple[tuple[int, list], list[tuple]]:
        nth, above = state or (0, [])
        above = [a for a in above if a[0] < row["level"]]
        path = separator.join([*(a[1] for a in above), row["title"]])
        out = (row[key], nth, row["title"], row["page_number"], row["level"], above[-1][1] if above else None, path)
        return (nth + 1, [*above, (row["level"], row["title"])]), [out]

    return ordered_fold(entries.select(key, *order, "level", "title", "page_number"), [key], order, f"{key} {kind}, nth bigint, title string, page_number int, level int, parent_title string, path string", step)


def contents_from_layout(boxes: DataFrame, key: str, tolerance: float = 0.01, gap: float = 0.03, pages: int | None = 8) -> DataFrame:
    """The contents of documents, with their nesting, from where the text of their lines stands on the page."""
    entries = contents_entries(layout_lines(boxes, key, tolerance, pages))
    return nested(indentation_levels(entries, key, gap), key, ["page", "line"])


# --- trees ---

_TREE = pa.schema([("nth", pa.int64()), ("title", pa.string()), ("level", pa.int32()), ("path", pa.string()), ("parent_title", pa.string()), ("concepts", pa.list_(pa.string()))])


def _walk(tree: str | None, separator: str) -> Iterator[tuple]:
    """Entries of a tree in pre-order, whatever its depth; what is no list of entries gives none."""
    try:
        items = json.loads(tree or "[]")
    except ValueError:
        return
    stack = [(x, "", None) for x in reversed(items)] if isinstance(items, list) else []
    nth = 0
    while stack:
        item, above, parent = stack.pop()
        if not isinstance(item, dict):
            continue
        title = str(item.get("title") or "")
        path = f"{above}{separator}{title}" if above else title
        level, concepts = item.get("level", 1), item.get("concepts")
        yield nth, title, level if isinstance(level, int) else 1, path, parent, [str(c) for c in concepts] if isinstance(concepts, list) else []
        nth += 1
        children = item.get("children")
        stack += [(x, path, title) for x in reversed(children)] if isinstance(children, list) else []


def flattened_tree(df: DataFrame, key: str, tree: str, separator: str = " > ") -> DataFrame:
    """Entries of each row's contents tree (JSON: title, level, concepts, children) in pre-order: key, nth, title, level, path, parent_title, concepts.

    A missing level is 1. Null, empty and unreadable trees give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for entry in _walk(t, separator):
                    keys.append(k)
                    rows.append(entry)
            columns = zip(*rows, strict=True) if rows else [[]] * len(_TREE)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(c, f.type) for c, f in zip(columns, _TREE, strict=True))], names=[key, *_TREE.names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tree).mapInArrow(run, f"{key} {kind}, nth bigint, title string, level int, path string, parent_title string, concepts array<string>")


def summary_rows(df: DataFrame, key: str, tree: str, summaries: DataFrame) -> DataFrame:
    """The summaries to store for contents trees: each entry with its document's summary of that title (key, title, summary), else the title itself, and chunks_count 0.

    Entries of one title share its summary. Of several summaries of a title the least counts.
    """
    one = summaries.groupBy(key, "title").agg(F.min("summary").alias("summary"))
    rows = flattened_tree(df, key, tree).join(one, [key, "title"], "left")
    return rows.select(key, "nth", F.col("path").alias("section_path"), "title", "level", F.coalesce("summary", "title").alias("text"), "concepts", F.lit(0).alias("chunks_count"))


# --- order ---


def first_long_word(text: Column, longer: int = 3) -> Column:
    """The first word of more than `longer` letters, in lower case; null if there is none."""
    return F.get(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.length(w) > longer), F.lit(0))


def volume_of(lookups: DataFrame, contents: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """Per lookup (lookup_id, paragraph, snippet) the volume whose contents name the paragraph and whose next line tells of it, or null.

    contents: idx, title, level in order (within `group` if given). A line `name v.p` counts
    if the line after it is of level 2 and its title holds the snippet's first word of more
    than three letters. The first such line decides. Lines meet lookups by the paragraph
    they name, an equi-join.
    """
    keys = [group] if group else []
    order = Window.partitionBy(*keys).orderBy("idx")
    pattern = name + r"\s+(\d+)\.(\d+)\b"
    named = contents.withColumn("said", F.lower(F.lead("title").over(order))).withColumn("below", F.lead("level").over(order)).where(F.col("title").rlike(pattern) & (F.col("below") == 2))
    named = named.select(*keys, "idx", "said", F.regexp_extract("title", pattern, 1).cast("int").alias("volume"), F.regexp_extract("title", pattern, 2).cast("int").alias("paragraph"))
    asked = lookups.withColumn("word", first_long_word(F.col("snippet")))
    met = asked.join(named, [*keys, "paragraph"]).where(F.contains("said", "word"))
    found = met.groupBy("lookup_id").agg(F.min_by("volume", "idx").alias("volume"))
    return lookups.select("lookup_id").join(found, "lookup_id", "left")
