"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A plan is made on the histogram of piece lengths (at most `limit` entries whatever the
corpus size): fill a bin greedily, largest first; then replace its smallest piece with two
unpacked pieces that fit the gap this opens more tightly; then repeat the pattern as often
as the histogram allows. Pieces take their places from the plan by their rank among the
pieces of their length, so no task holds more than its own rows.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import broadcast_if_small, free_caches, give_back, materialize, worker_cache

LIMIT = 4096
#: Words whose ids a worker remembers (about 50 MB); past it new ones are not kept, or, where most are new, it starts anew.
CACHE = 300_000

_END = np.array([1], "<u4").tobytes()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of texts, as packed 32-bit numbers, through a bounded cache of words.

    The tokenizer lower-cases and never joins tokens across white space, so a text's ids
    are those of its white-space separated words in turn.
    """

    #: A letter that stands between words encoded together, and in none of them.
    MARK = "\u0e01"
    _workers: dict[str, WordIds] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._encode(self.MARK)
        self.held: dict[bytes, bytes] = worker_cache({})

    @classmethod
    def at(cls, path: str) -> WordIds:
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[bytes]) -> None:
        mark = self.MARK.encode()
        for w in [w for w in words if mark in w]:
            self.held[w] = np.array(self._encode(w.decode()), "<u4").tobytes()
        words = [w for w in words if mark not in w]
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self._encode(f" {self.MARK} ".join(w.decode() for w in some)), "<u4")
            cuts, flat, at = (np.flatnonzero(ids == self.mark) * 4).tolist(), ids.tobytes(), 0
            for w, cut in zip(some, [*cuts, len(flat)], strict=True):
                self.held[w] = flat[at:cut]
                at = cut + 4

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # strings of special tokens are matched before lower-casing
        words = [(r if b"<|" in r else r.lower()).split() for r in ((t or "").encode("utf-8", "replace") for t in texts)]
        every = set().union(*words)
        new = every.difference(self.held)
        self._learn(list(new))
        ids = self.held.__getitem__
        out = [b"".join(map(ids, w)) for w in words]
        if len(self.held) > CACHE:
            if 3 * len(new) > 2 * len(every):
                self.held.clear()  # the texts have changed
            else:
                for w in new:
                    del self.held[w]
        return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _cut(path: str, limit: int, batch_chars: int = 2_000_000):
    def run(batches):
        part, nth = TaskContext.get().partitionId(), Counter()
        ids_of = WordIds.at(path)
        free_caches(keep=ids_of.held)
        for batch in batches:
            rows, held, texts = [], 0, batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end = at
                while end < len(texts) and (end == at or held + len(texts[end] or "") <= batch_chars):
                    held += len(texts[end] or "")
                    end += 1
                for doc, ids in zip(batch.column(0).slice(at, end - at).to_pylist(), ids_of(texts[at:end]), strict=True):
                    ids += _END
                    for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                        one = ids[start : start + 4 * limit]
                        n = len(one) // 4
                        rows.append((doc, piece, start // 4, n, zlib.crc32(one), part, nth[n]))
                        nth[n] += 1
                at, held = end, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_PIECES), _PIECES, strict=True)], schema=_PIECES)
        give_back()

    return run


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs cut into pieces of at most `limit` tokens: doc_id, piece, start, length, ids_crc32, and a stable place (part, nth) among the pieces of that length.

    Each document ends with id 1, so null and empty texts give one piece of one token.
    Repeated rows are pieces of their own; columns but doc_id and text are ignored.
    """
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(path, limit), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
    return materialize(cut, "pieces")


def pack_lengths(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """Bins for the counted lengths, as (repeats, lengths in descending order)."""
    left = {n: c for n, c in counts.items() if c > 0}
    have = sorted(left)
    bins = []
    while have:
        used: Counter = Counter()
        gap, top = limit, len(have)
        while gap and (top := bisect.bisect_right(have, gap, 0, top)):
            n = have[top - 1]
            k = min(gap // n, left[n])
            used[n] += k
            gap -= k * n
            top -= 1
        while gap:
            small = min(used)
            pair = _two_fit(have, left, used, small, gap + small)
            if not pair:
                break
            used[small] -= 1
            used += Counter()
            used.update(pair)
            gap += small - sum(pair)
        times = min(left[n] // k for n, k in used.items())
        bins.append((times, sorted(used.elements(), reverse=True)))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                have.pop(bisect.bisect_left(have, n))
    return bins


def _two_fit(have: list[int], left: dict[int, int], used: Counter, small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum fits room and exceeds `small` by the most, if any."""
    free = [n for n in have[: bisect.bisect_left(have, room)] if left[n] > used[n]]
    lo, hi, best, found = 0, len(free) - 1, small, None
    while lo <= hi:
        a, b = free[lo], free[hi]
        if a + b > room:
            hi -= 1
            continue
        if a + b > best and (lo < hi or left[a] - used[a] > 1):
            best, found = a + b, (a, b)
            if best == room:
                break
        lo += 1
    return found


def _plan(counts: dict[int, int], limit: int) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first bin, offset in the bin), sorted by length and rank."""
    taken: Counter = Counter()
    rows, first = [], 0
    for times, lengths in pack_lengths(counts, limit):
        offset = 0
        for n, k in Counter(lengths).items():
            rows.append((n, taken[n], k, first, offset))
            taken[n] += times * k
            offset += n * k
        first += times
    return np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)


def _place(plan):
    """Arrow batches (doc_id, piece, start, length, ids_crc32, rank) -> those without rank, with sequence_id and offset from the broadcast plan."""

    def run(batches):
        free_caches()  # all pieces are cut, so no words are needed any more
        rows = plan.value
        keys = (rows[:, 0] << 44) | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            seg = rows[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            turn, inside = np.divmod(rank - seg[:, 1], seg[:, 2])
            extra = [pa.array(seg[:, 3] + turn), pa.array(seg[:, 4] + inside * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per piece of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every piece is placed once; a sequence's pieces fill it from offset 0 without gaps. The
    histogram that reaches the driver has at most `limit` rows. Empty tables give no rows.
    """
    cut = pieces(docs, path, limit)
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = cut.sparkSession.sparkContext.broadcast(_plan(counts, limit))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = materialize(by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ahead")
    ranked = cut.join(broadcast_if_small(ahead, 24), ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_two_fit(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
