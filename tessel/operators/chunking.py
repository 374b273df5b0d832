"""Chunks by a language model, held to the section they come from."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators.segment import overlap_chunks


def estimated_tokens(text: Column) -> Column:
    """A text's tokens, taken as a quarter of its characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def fits(text: Column, most: int = 2500) -> Column:
    return estimated_tokens(text) <= most


def _answer(raw: str | None) -> list[dict]:
    """The chunks of a model's answer: JSON between <JSON> marks, else between the outermost braces."""
    raw = raw or ""
    inside = raw.split("<JSON>", 1)[1].split("</JSON>", 1)[0] if "<JSON>" in raw else raw[raw.find("{") : raw.rfind("}") + 1]
    try:
        found = json.loads(inside)
    except ValueError:
        return []
    chunks = found.get("chunks") if isinstance(found, dict) else None
    return [c for c in chunks if isinstance(c, dict) and isinstance(c.get("text"), str)] if isinstance(chunks, list) else []


def aligned(text: str, chunks: list[dict]) -> list[tuple[int, int, dict]] | None:
    """Where a model's chunks stand in the text, as (start, end, chunk); None unless they follow one another in it and leave nothing but white space out."""
    at, out = 0, []
    for c in chunks:
        said = c["text"].strip()
        start = text.find(said, at) if said else -1
        if start < 0 or text[at:start].strip():
            return None
        at = start + len(said)
        out.append((start, at, c))
    return None if not out or text[at:].strip() else out


_CHUNKS = pa.schema([("chunk_no", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("summary", pa.string()), ("concepts", pa.list_(pa.string())), ("type", pa.string()), ("origin", pa.string())])


#: Sections whose chunks are sent on together.
_SECTIONS = 100


def _section_chunks(text: str, title: str, provider: Callable[[str], str], target: int, most: int, retries: int) -> Iterator[tuple]:
    if not text.strip():
        return
    if len(text.split()) < 0.8 * target:
        yield 0, text.find(text.strip()), text.strip(), title, [], "main_content", "short"
        return
    found = None
    for _ in range(retries):
        try:
            found = aligned(text, _answer(provider(text)))
        except Exception:  # noqa: BLE001  a provider's failure is an answer that does not fit
            found = None
        if found:
            break
    if found and all(end - start <= 4 * most + 3 for start, end, _ in found):
        for k, (start, end, c) in enumerate(found):
            concepts = c.get("concepts")
            yield k, start, text[start:end], str(c.get("summary") or ""), [str(x) for x in concepts] if isinstance(concepts, list) else [], str(c.get("type") or "main_content"), "model"
        return
    pieces = overlap_chunks(text, least=0)
    for k, piece in enumerate(pieces):
        yield k, None, piece, f"{title} (part {k + 1}/{len(pieces)})", [], "main_content", "overlap"


def model_chunks(sections: DataFrame, key: list[str], text: str, title: str, provider: Callable[[str], str], target: int = 300, most_tokens: int = 2500, retries: int = 3) -> DataFrame:
    """Chunks of sections: key, chunk_no, start, text, summary, concepts, type, origin, paragraph, subsection.

    A section under 0.8 of the target's words is one chunk. For others the model is asked;
    its chunks count only if they are the section's text in order with nothing left out but
    white space, each within most_tokens (a quarter of the characters). Otherwise, as after
    bad JSON or `retries` failures, the section goes to the overlap chunker, whole. start is
    where a chunk begins in the section, null for overlapping ones. Blank sections give none.
    """
    fields = [f for f in sections.schema.fields if f.name in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            types = pa.schema([*(whole.schema.field(k) for k in key), pa.field("_title", pa.string()), *_CHUNKS])
            # some sections at a time, so a task never holds the chunks of a whole Arrow batch
            for at in range(0, whole.num_rows, _SECTIONS):
                held: list[tuple] = []
                for row in whole.slice(at, _SECTIONS).to_pylist():
                    for chunk in _section_chunks(row["_text"] or "", row["_title"] or "", provider, target, most_tokens, retries):
                        held.append((*(row[k] for k in key), row["_title"], *chunk))
                columns = zip(*held, strict=True) if held else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "_title string, chunk_no int, start bigint, text string, summary string, concepts array<string>, type string, origin string"])
    rows = sections.select(*key, F.col(text).alias("_text"), F.col(title).alias("_title")).mapInArrow(run, shape)
    return rows.withColumn("paragraph", T.paragraph_number(F.col("text"))).withColumnRenamed("_title", "subsection")


def paragraph_answer(text: str) -> str:
    """The offline stand-in for a chunking model: a section's lines, two a chunk, as JSON. It goes wrong on purpose, and always the same way, on some texts."""
    lines = [x for x in text.split("\n") if x.strip()]
    kind = len(text) % 5
    chunks = [{"text": "\n".join(lines[i : i + 2]), "summary": lines[i].strip()[:40], "concepts": lines[i].lower().split()[:3], "type": "exposition"} for i in range(0, len(lines), 2)]
    if kind == 0:
        return "<JSON>{" + json.dumps(chunks)  # cut short
    if kind == 1:
        chunks = chunks[:-1] + [{"text": "not in the section"}]
    return "Here: <JSON>\n" + json.dumps({"chunks": chunks}) + "\n</JSON>"
