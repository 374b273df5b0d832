"""Token ids as directly addressable codes: a file format with random access to any token.

An id is split into chunks, lowest bits first. Level 1 holds the first chunk of every id,
level 2 the second chunk of those ids that have one, and so on; a bitmap beside each level
says which ids go on, and a directory of ones before each 512 bits turns a place on one level
into the place on the next. So any id, or any range of ids, is read from its place alone.

A stored corpus is a folder with two tables. `segments`: runs of whole documents in ascending
doc_id order, with their lengths, each run with its own chunk widths (those that need the
fewest bits). `parts`: how many ids stand before each sorted part. Ids are written part by
part, so no task holds more than a segment and a document.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import arrow_batches, broadcast_if_small, free_caches, materialize, shared_dir, table, worker_cache
from tessel.llm.packing import tokenizer_path

#: Ids after which a segment ends (with its document), and ids coded at a time.
SEGMENT, PART = 1 << 18, 1 << 18
#: Bits between two entries of a directory of ones.
BLOCK = 512
#: Pieces of text whose ids a worker remembers (about 240 MB); past it new ones are not kept, or, where most are new, it starts anew. Longer pieces are never kept.
CACHE, LONG_PIECE = 1_200_000, 64


# --- the code ---


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, lowest chunk first, that need the fewest bits for these ids."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    longer = [np.count_nonzero(ids >> np.uint32(t)) if t else len(ids) for t in range(top)]  # ids of more than t bits
    best: list[tuple[int, list[int]]] = [(0, [])] * (top + 1)
    for t in range(top - 1, -1, -1):
        best[t] = min((int(longer[t]) * (w + (t + w < top)) + best[t + w][0], [w, *best[t + w][1]]) for w in range(1, top - t + 1))
    return best[0][1]


def _packed(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits each, one after the other; coded in parts of a multiple of eight values."""
    if width in (8, 16, 32):
        return values.astype(f">u{width // 8}").tobytes()
    out, size = [], 8 if width < 8 else 16 if width < 16 else 32
    for i in range(0, len(values), PART):
        bits = np.unpackbits(values[i : i + PART].astype(f">u{size // 8}").view(np.uint8)).reshape(-1, size)[:, size - width :]
        out.append(np.packbits(bits).tobytes())
    return b"".join(out)


def _bits(raw: bytes, first: int, last: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, (last + 7) // 8 - first // 8, first // 8))[first % 8 : first % 8 + last - first]


def _unpacked(raw: bytes, width: int, first: int, last: int) -> np.ndarray:
    """Values number first to last - 1."""
    bits = np.zeros((last - first, 32), np.uint8)
    bits[:, 32 - width :] = _bits(raw, first * width, last * width).reshape(-1, width)
    return np.packbits(bits).view(">u4").astype(np.uint32)


def encode(ids: np.ndarray) -> list[dict]:
    """The levels of a run of ids: width, chunks, and, but on the last, more (the bitmap) and ranks (the directory)."""
    rest, levels = ids.astype(np.uint32), []
    widths = best_widths(rest)
    for k, width in enumerate(widths):
        level = {"width": width, "chunks": _packed(rest & np.uint32((1 << width) - 1), width), "more": None, "ranks": None}
        if k < len(widths) - 1:
            rest = rest >> np.uint32(width)
            more = np.packbits(rest > 0)
            whole = np.concatenate((more, np.zeros(-len(more) % (BLOCK // 8), np.uint8))).reshape(-1, BLOCK // 8)
            ones = np.cumsum(np.bitwise_count(whole).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
            level |= {"more": more.tobytes(), "ranks": np.concatenate(([0], ones[:-1])).astype("<u4").tobytes() if len(ones) else b""}
            rest = rest[rest > 0]
        levels.append(level)
    return levels


def rank(level: dict, i: int) -> int:
    """Ones of the level's bitmap before place i: one entry of the directory and at most 512 bits."""
    block = i // BLOCK
    if 4 * block >= len(level["ranks"]):  # the end of a full last block
        block -= 1
        if block < 0:
            return 0
    start = block * BLOCK // 8
    ones = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
    ones += int.from_bytes(level["more"][start : i // 8], "big").bit_count()
    return ones + ((level["more"][i // 8] >> (8 - i % 8)).bit_count() if i % 8 else 0)


def token_at(levels: list[dict], i: int) -> int:
    """Id number i, from one chunk a level."""
    value = shift = 0
    for level in levels:
        width = level["width"]
        first, last = i * width, (i + 1) * width
        raw = int.from_bytes(level["chunks"][first // 8 : (last + 7) // 8], "big")
        value |= (raw >> (-last % 8) & ((1 << width) - 1)) << shift
        shift += width
        if level["more"] is None or not level["more"][i // 8] >> (7 - i % 8) & 1:
            return value
        i = rank(level, i)
    return value


def tokens_between(levels: list[dict], first: int, last: int) -> np.ndarray:
    """Ids number first to last - 1, reading no other chunks."""
    out = np.zeros(last - first, np.uint32)
    places, shift = np.arange(last - first), 0
    for level in levels:
        if first >= last:
            break
        out[places] |= _unpacked(level["chunks"], level["width"], first, last) << np.uint32(shift)
        if level["more"] is None:
            break
        places = places[_bits(level["more"], first, last).astype(bool)]
        first, last, shift = rank(level, first), rank(level, last), shift + level["width"]
    return out


# --- token ids ---


class PieceIds:
    """Ids of texts, as packed 32-bit numbers, through a bounded memory of pieces.

    The tokenizer's pattern never joins tokens over a place between a letter or mark and the
    white space after it, so a text's ids are those of its pieces, cut there, in turn.
    """

    _CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
    _LEADS = ("", "\0", "\n")
    _MARKS = ".,;:!?*#$%&"
    _LAST = frozenset(_MARKS)
    #: White space but the space and the line end, and a NUL.
    _OTHER = [c for c in map(chr, range(1 << 16)) if c == "\0" or c.isspace() and c not in " \n"]
    _OTHER_ASCII = [c for c in _OTHER if c.isascii()]
    _workers: dict[str, PieceIds] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # tokens that begin with a space
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.held: dict[str, bytes] = worker_cache({})

    @classmethod
    def at(cls, path: str) -> PieceIds:
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    def _keys(self, text: str) -> list[str]:
        """The text's pieces. One led by a space is held without it, one led by a line end as it is, any other with a NUL ahead."""
        spaced = text.replace("\n", " \n")
        if "  " in spaced or "\n " in spaced or spaced[0] == " " or any(map(text.__contains__, self._OTHER_ASCII if text.isascii() else self._OTHER)):
            pieces = self._CUT.split(text)
            return [p[1:] if p[0] == " " and p[1:2] not in self._LEADS else p if p[0] == "\n" else "\0" + p for p in pieces if p]
        return ("\0" + spaced).split(" ")

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn_words(self, keys: list[str], lead: str, learned: dict[str, bytes]) -> list[str]:
        """Learn words from one text of them all, each behind `lead`; those whose ids can't be told apart in it are returned."""
        left = []
        for i in range(0, len(keys), 500):
            some = keys[i : i + 500]
            words = some if lead == " " else [k[1:] for k in some]
            text = lead + lead.join(words)
            if text.split() != words:
                left += some
                continue
            flat = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.spaced[flat] if lead == " " else flat == self.line) * 4).tolist()
            if len(cuts) != len(some) or cuts[0]:
                left += some
                continue
            raw, ends = flat.tobytes(), [*cuts[1:], len(flat) * 4]
            if lead != " ":
                cuts = [at if k[0] == lead else at + 4 for k, at in zip(some, cuts, strict=True)]
            learned.update(zip(some, map(raw.__getitem__, map(slice, cuts, ends)), strict=True))
        return left

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        """The ids of pieces that are not held, and of the stems of those that end in marks.

        Words led by a space are encoded many at a time: only their first token begins with a
        space. So are those led by a line end, which is a token by itself, or by nothing.
        Between a letter and a mark no tokens are joined either, so a stem serves all the
        marks behind it.
        """
        ends = []
        for k in keys:
            if k[-1:] in self._LAST:
                stem = k.rstrip(self._MARKS)
                if stem[-1:].isalpha() and stem[-1] < "\u0250":
                    ends.append((k, stem, "\0" + k[len(stem) :]))
        parts = {part for end in ends for part in end[1:]}
        learned = {k: self.held[k] for k in parts if k in self.held}
        whole = (keys | parts).difference((k for k, _, _ in ends), learned)
        others = self._learn_words([k for k in whole if k[:1] > "\n"], " ", learned)
        others += self._learn_words([k for k in whole if k[:1] in ("\0", "\n")], "\n", learned)
        others += [k for k in whole if k[:1] <= "\n" and k[:1] not in ("\0", "\n")]
        for i in range(0, len(others), 500):
            some = others[i : i + 500]
            learned.update(zip(some, self._encoded([k[1:] if k[:1] == "\0" else k if k[:1] == "\n" else " " + k for k in some]), strict=True))
        learned.update((k, learned[stem] + learned[marks]) for k, stem, marks in ends)
        return learned

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        keys = [self._keys(t) if t else [] for t in texts]
        ids = [list(map(self.held.get, k)) for k in keys]
        # no piece is without ids, so what is false is not held
        gaps = [[i for i, one in enumerate(x) if not one] for x in ids]
        learned = self._learn({k[i] for k, at in zip(keys, gaps, strict=True) for i in at})
        for k, x, at in zip(keys, ids, gaps, strict=True):
            for i in at:
                x[i] = learned[k[i]]
        if len(self.held) + len(learned) > CACHE and 3 * sum(map(len, gaps)) > sum(map(len, keys)):
            self.held.clear()  # the texts have changed
        if len(self.held) + len(learned) <= CACHE:
            self.held.update((k, v) for k, v in learned.items() if len(k) <= LONG_PIECE)
        return list(map(b"".join, ids))


# --- the stored corpus ---

_LEVEL = pa.struct([("width", pa.int32()), ("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_SEGMENT = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("levels", pa.list_(_LEVEL))])
_SEGMENT_DDL = "part int, nth int, first long, n long, doc_ids array<bigint>, lengths array<bigint>, levels array<struct<width: int, chunks: binary, more: binary, ranks: binary>>"


def _write(path: str, end: int, segment: int, batch_chars: int = 2_000_000) -> Callable:
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids_of = TaskContext.get().partitionId(), PieceIds.at(path)
        free_caches(keep=ids_of.held)
        held, docs, nth, first = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs, nth, first
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"part": part, "nth": nth, "first": first, "n": len(ids), "doc_ids": [d for d, _ in docs], "lengths": [n for _, n in docs], "levels": encode(ids)}
            held, docs, nth, first = [], [], nth + 1, first + len(ids)
            return pa.RecordBatch.from_pylist([row], _SEGMENT)

        size = 0
        for batch in batches:
            at, texts, keys = 0, batch.column(1).to_pylist(), batch.column(0).to_pylist()
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= batch_chars):
                    chars += len(texts[stop] or "")
                    stop += 1
                for doc, ids in zip(keys[at:stop], ids_of(texts[at:stop]), strict=True):
                    held += (ids, last)
                    docs.append((doc, len(ids) // 4 + 1))
                    size += docs[-1][1]
                    if size >= segment:
                        yield flush()
                        size = 0
                at = stop
        if docs:
            yield flush()

    return run


def write_codes(docs: DataFrame, path: str, folder: str, end: int = 0, segment: int = SEGMENT) -> str:
    """Encode every text of docs, append the id `end` to each, and store the ids in `folder` in ascending doc_id order.

    Rows without doc_id come first; rows of one doc_id stand in the order of their texts'
    hashes, equal rows in any order. A null or empty text is its end id alone. Columns but
    doc_id and text are ignored. An empty table stores no segment. The folder must be new.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the place parts equal rows, so no doc_id and no group of copies is bound to one task
    order = ["doc_id", "hash", "place"]
    dealt = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    with arrow_batches(docs.sparkSession):
        dealt.select("doc_id", "text").mapInArrow(_write(path, end, segment), _SEGMENT_DDL).write.parquet(f"{folder}/segments")
    spark = docs.sparkSession
    segments = spark.read.schema(_SEGMENT_DDL).parquet(f"{folder}/segments")
    # one row a part: the running sum is over parts, not over documents
    totals = segments.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.withColumn("before", before).coalesce(1).write.parquet(f"{folder}/parts")
    return folder


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Stored segments with the ids before each in the corpus (`first`)."""
    parts = spark.read.schema("part int, n long, before long").parquet(f"{folder}/parts").select("part", "before")
    stored = spark.read.schema(_SEGMENT_DDL).parquet(f"{folder}/segments")
    return stored.join(broadcast_if_small(parts, 16), "part").withColumn("first", F.col("first") + F.col("before")).drop("before")


def _documents(digest: bool) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, at = [], 0
                ready, base = np.empty(0, np.uint32), 0  # ids decoded ahead, and the place of their first
                for doc, n in zip(row["doc_ids"], row["lengths"], strict=True):
                    got, crc, end = [], 0, at + n
                    for i in range(at, end, PART):
                        stop = min(end, i + PART)
                        if stop > base + len(ready):
                            base, ready = i, tokens_between(row["levels"], i, min(row["n"], i + PART))
                        some = ready[i - base : stop - base]
                        if digest:
                            crc = zlib.crc32(some.astype("<u4"), crc)
                        else:
                            got += some.tolist()
                    out.append((doc, row["first"] + at, n, crc if digest else got))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def read_documents(spark: SparkSession, folder: str, digest: bool = False, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """Per stored document: doc_id, start (ids before it), n_tokens, and its ids, or with digest the CRC-32 of them as little-endian 32-bit numbers.

    doc_ids: a lowest and highest doc_id; only segments that meet it are decoded.
    """
    rows = _segments(spark, folder)
    if doc_ids:
        rows = rows.where(F.exists("doc_ids", lambda d: d.between(*doc_ids)))
    last = "ids_crc32 long" if digest else "ids array<bigint>"
    docs = rows.select("part", "nth", "first", "n", "doc_ids", "lengths", "levels").mapInArrow(_documents(digest), f"doc_id long, start long, n_tokens long, {last}")
    return docs.where(F.col("doc_id").between(*doc_ids)) if doc_ids else docs


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("place", pa.int64()), ("id", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            ids = [token_at(row["levels"], p - row["first"]) for p in row["places"]]
            yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array(ids, pa.int64())], schema=schema)


def tokens_at(spark: SparkSession, folder: str, places: DataFrame, at_once: int = 1 << 16) -> DataFrame:
    """The ids at places (one column `place` of positions in the whole corpus): place, id; places outside the corpus give no row.

    Places find their segments by an equi-join on spans of the corpus, then each segment's
    levels are read at those places alone.
    """
    span = SEGMENT
    rows = _segments(spark, folder)
    cover = F.explode(F.sequence(F.floor(F.col("first") / span), F.floor((F.col("first") + F.col("n") - 1) / span)))
    where = rows.select("part", "nth", "first", "n", cover.alias("span"))
    asked = places.select(F.col("place").cast("long")).where("place is not null").distinct().withColumn("span", F.floor(F.col("place") / span))
    found = asked.join(where, "span").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n")))
    groups = found.groupBy("part", "nth", F.floor((F.col("place") - F.col("first")) / at_once).alias("block")).agg(F.collect_list("place").alias("places"))
    held = materialize(groups.select("part", "nth", "places"), "places")
    side = broadcast_if_small(held, F.size("places") * 8 + 32)
    return rows.join(side, ["part", "nth"]).select("first", "levels", "places").mapInArrow(_tokens, "place long, id long")


def op12_addressable_codes(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    write_codes(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder)
    with arrow_batches(spark):
        return materialize(read_documents(spark, folder, digest=True), "token-documents")
