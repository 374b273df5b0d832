"""Fill-in-middle transformation over an index of distinct texts.

Rows of one text meet in one run: they are dealt by a hash of the text and sorted by hash and
text, and a run ends where the text itself changes, so grouping rests on the content, not on
its hash. For each run the code points' byte boundaries are listed once, as an Elias-Fano
code; the rows of the run are merged with that list, and each selects the two boundaries of
its own seeded cut. Texts are shuffled once. A text that holds more than its share of all
bytes is dealt over as many tasks as its size asks for, each of which lists it once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import arrow_batches, free_caches, materialize, table

#: Marks of the output's parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of one text from which its rows are dealt over several tasks, and the most texts so dealt.
HOT_BYTES, MOST_HOT = 64 << 20, 10_000


class EliasFano:
    """A sorted list of integers in about two bits and some low bits each, with constant-time select.

    The low bits of a value stand in a packed array, the rest as the place of the value's
    one in a bitmap; a directory of ones before each 64-bit word finds that place.
    """

    __slots__ = ("ahead", "low", "low_bits", "n", "words")

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        places = (values >> self.low_bits) + np.arange(self.n)
        bits = np.zeros(((int(places[-1]) if self.n else 0) // 64 + 1) * 64, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.ahead = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        low = (values[:, None] >> np.arange(self.low_bits)) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")

    def select(self, i: int) -> int:
        """Value number i."""
        at = int(np.searchsorted(self.ahead, i, "right")) - 1
        word = int(self.words[at])
        for _ in range(i - int(self.ahead[at])):
            word &= word - 1
        high = at * 64 + (word & -word).bit_length() - 1 - i
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return high << self.low_bits | low


def boundaries(text: bytes) -> EliasFano:
    """Where the code points of a UTF-8 text begin, and its end."""
    raw = np.frombuffer(text, np.uint8)
    return EliasFano(np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)))


def seeds(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """The four seeded numbers of a row; a missing doc_id counts as no digits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def arranged(text: bytes, cut: tuple[int, int], form: str) -> bytes:
    """The text in the order of its form, cut at two byte offsets."""
    a, b = cut
    if form == "plain":
        return text
    if form == "psm":
        return b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    return b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made from. No part holds a mark, so each is where it first occurs."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


_COLUMNS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def _runs(seed: int, plain: int, spm: int, digest: bool, most: int = 8 << 20) -> Callable:
    """Tasks over rows sorted by text: one boundary list a run, one cut a row."""
    ends = [("output_sha256", pa.string()), ("restored_sha256", pa.string())] if digest else [("output", pa.string())]
    schema = pa.schema([*_COLUMNS, *ends])

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        text, index, marked = None, None, True
        rows, held = [], 0
        for batch in batches:
            for doc, this in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                this = this.as_py()
                if this != text:
                    text, index = this, boundaries(this)
                    marked = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                n = index.n - 1
                h1, h2, h3, h4 = seeds(doc, seed)
                if marked or h3 % 100 >= 100 - plain:
                    form, cut, chars = "plain", (0, 0), (None, None)
                else:
                    form = "spm" if h4 % 100 < spm else "psm"
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    cut, chars = (index.select(a), index.select(b)), (a, b - a)
                made = arranged(text, cut, form)
                if digest:
                    shown = (hashlib.sha256(made).hexdigest(), hashlib.sha256(restored(made, form)).hexdigest())
                else:
                    shown, held = (made.decode(),), held + len(made)
                rows.append((doc, n, form, *chars, *shown))
                if len(rows) >= 10_000 or held >= most:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, digest: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n (code points), form, prefix_chars, middle_chars, and the output.

    The cut and the form follow from the seed and doc_id alone, so equal rows give equal
    results and a repeated doc_id cuts each of its texts by its own length. With digest,
    output_sha256 and restored_sha256 (of the text rebuilt from output and form) stand in
    for the output. A null text counts as empty, and an empty text or one that holds a mark
    is plain, with null counts. Every row gives one row; columns but doc_id and text are
    ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    sizes = materialize(rows.groupBy("key").agg(F.sum(F.octet_length("text") + 16).alias("bytes")), "sizes", light=True)
    share = max(HOT_BYTES, (sizes.agg(F.sum("bytes")).head()[0] or 0) // MOST_HOT)
    # at most MOST_HOT keys exceed their share
    hot = sizes.where(F.col("bytes") > share).select("key", F.ceil(F.col("bytes") / share).alias("parts"))
    if hot.isEmpty():
        dealt = rows.withColumn("salt", F.lit(0).cast("long"))
    else:
        turn = F.pmod(F.monotonically_increasing_id(), F.col("parts"))
        dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", F.coalesce(turn, F.lit(0).cast("long"))).drop("parts")
    runs = dealt.repartition("key", "salt").sortWithinPartitions("key", "text").select("doc_id", "text")
    ends = "output_sha256 string, restored_sha256 string" if digest else "output string"
    return runs.mapInArrow(_runs(seed, plain_percent, spm_percent, digest), f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {ends}")


def op13_distinct_text_index(spark, sf_dir: str) -> DataFrame:
    with arrow_batches(spark):
        return materialize(fill_in_middle(table(spark, sf_dir, "documents"), digest=True), "middle")


#: The same cuts in DuckDB, whose lengths and substrings count code points.
SQL = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
 g AS (SELECT doc_id, t, n, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
 f AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
 o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b] ELSE '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] END AS o FROM f),
 r AS (SELECT *, strpos(o, '<P>') AS p, strpos(o, '<S>') AS s, strpos(o, '<M>') AS m FROM o)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(o) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(o, 4, s - 4) || substr(o, m + 3) || substr(o, s + 3, m - s - 3) ELSE substr(o, p + 3, m - p - 3) || substr(o, m + 3) || substr(o, 4, p - 4) END) AS restored_sha256 FROM r"""
