"""Quality by weak labels: heuristic labellers, their estimated accuracies, a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import broadcast_if_small, materialize, shingles_of_words, table

LABELLERS = ("length", "symbols", "lines", "windows", "capitals", "word_size", "function_words", "endings", "variety")
#: Hash buckets of words, word pairs and word shapes.
BUCKETS = 4096
#: Documents the scorer is trained on at most, chosen by a hash of doc_id and text.
TRAIN_ROWS = 8000
#: Score from which a document is kept.
KEEP = 0.5

#: Common function words of the corpus languages.
FUNCTION_WORDS = frozenset(w.encode() for w in "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat le la les de des et un une du que qui dans est pour pas au sur par plus avec el los y en del se las por con no su para al lo".split())
_SYMBOLS = b"#*$%&|<>^~{}[]\\@=+_"
_ASCII = bytes(range(128))


#: What a byte adds to the shape of its word: capitals in the low half of a count, small letters in the high one.
_CASES = np.array([1 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 1 << 32 if chr(b) in "abcdefghijklmnopqrstuvwxyz" else 0 for b in range(256)], np.int64)
_ENDS = np.array([4 * (chr(b) in ".,;:!?") + 8 * (chr(b) in "%*$#&|") for b in range(256)], np.int64)


class Reading:
    """A text's bytes and words, split and hashed once for votes (runs of five words) and features (one and two). Null counts as empty."""

    def __init__(self, text: str | None, sizes: tuple[int, ...] = (1, 2, 5)) -> None:
        self.raw = (text or "").encode("utf-8", "replace")
        self.words, self.low = self.raw.split(), self.raw.lower().split()
        hashed = self.low
        if b"?" in self.raw and not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text):
            hashed = text.encode("utf-8", "surrogatepass").lower().split()  # lone surrogates are told apart
        self.runs = dict(zip(sizes, shingles_of_words(hashed, sizes), strict=True))

    def shapes(self) -> np.ndarray:
        """A number for each word: led by a capital, capitals alone, ends in a stop, ends in a symbol, over 12 bytes, under 3."""
        flat = np.frombuffer(b" ".join(self.words) + b" ", np.uint8)
        ends = np.flatnonzero(flat == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        cases, size = np.add.reduceat(_CASES[flat], starts), ends - starts
        capitals = (cases > 0) & (cases < 1 << 32)
        return (_CASES[flat[starts]] == 1) + 2 * capitals + _ENDS[flat[ends - 1]] + 16 * (size > 12) + 32 * (size < 3)


def votes(text: str | None) -> str:
    """One sign a labeller: + for good, - for bad, 0 for no opinion. Null and empty texts are bad by length."""
    return votes_of(Reading(text, (5,)))


def votes_of(read: Reading) -> str:
    raw, words, low = read.raw, read.words, read.low
    n = len(words)
    if n < 10:  # too little to test
        return ("0" if n else "-") + "0" * (len(LABELLERS) - 1)
    chars = sum(map(len, words))
    bare = [w.strip(b".,;:!?\"'()") for w in low]
    symbols = (len(raw) - len(raw.translate(None, _SYMBOLS))) / chars
    lines = [x for x in raw.split(b"\n") if x.strip()]
    copied = 1 - len(set(lines)) / len(lines)
    repeated = 1 - len(np.unique(read.runs[5])) / len(read.runs[5])
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) + sum(map(str.isupper, raw.translate(None, _ASCII).decode("utf-8")))
    upper /= chars
    size = chars / n
    common = sum(map(FUNCTION_WORDS.__contains__, bare)) / n
    ended = sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines) / len(lines)
    variety = len(set(bare)) / n**0.8

    def vote(value: float, bad: bool, good: bool) -> str:
        return "-" if bad else "+" if good else "0"

    return "".join((
        vote(n, False, n >= 40),
        vote(symbols, symbols > 0.06, symbols < 0.02),
        vote(copied, copied > 0.4, False),
        vote(repeated, repeated > 0.15, False),
        vote(upper, upper > 0.3, upper < 0.12),
        vote(size, size < 2.5 or size > 12, False),
        vote(common, common < 0.02, common > 0.08),
        vote(ended, ended < 0.2, ended > 0.7),
        vote(variety, variety < 0.4, False),
    ))


def label_model(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for conditionally independent labellers over vote patterns weighted by counts.

    Returns the patterns' posteriors of good, each labeller's probabilities of (+, 0, -)
    by class (bad, good), and the share of good. Abstentions are no evidence. Starts from
    what any "-" calls bad, as those tests are the narrower ones.
    """
    v = np.array([["+0-".index(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
    w = counts.astype(float)
    post = np.where((v == 2).any(axis=1), 0.1, 0.9)
    table_, prior = np.zeros((v.shape[1], 3, 2)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((w * post).sum() / max(w.sum(), 1e-9), 0.02, 0.98))
        for c, weight in ((0, w * (1 - post)), (1, w * post)):
            for k in range(3):
                table_[:, k, c] = (weight[:, None] * (v == k)).sum(axis=0) + 1.0
        table_ /= table_.sum(axis=1, keepdims=True)
        logs = (np.log(np.take_along_axis(table_, v.T[:, :, None], axis=1)) * (v.T != 1)[:, :, None]).sum(axis=0)
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1] + np.log((1 - prior) / prior), -50, 50)))
    return post, table_, prior


def hashed_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text's words, word pairs and word shapes, of unit length."""
    return features_of(Reading(text, (1, 2)))


def features_of(read: Reading) -> tuple[np.ndarray, np.ndarray]:
    words = read.words
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    one, two = read.runs[1], read.runs[2] if len(words) > 1 else read.runs[2][:0]
    # shapes fill the first 64 buckets, words and pairs the others
    at = np.concatenate((read.shapes(), 64 + (one % np.uint64(BUCKETS - 64)).astype(np.int64), 64 + (two % np.uint64(BUCKETS - 64)).astype(np.int64)))
    counts = np.bincount(at, minlength=BUCKETS)
    idx = np.flatnonzero(counts)
    weight = np.log1p(counts[idx])
    weight[idx < 64] = counts[idx][idx < 64] / len(words) * np.sqrt(len(words)) * 4
    return idx, weight / np.sqrt((weight**2).sum())


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Logistic weights over BUCKETS and a bias (last), by Adagrad on soft labels in the given order."""
    beta, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    for _ in range(epochs):
        for idx, weight, soft in rows:
            miss = 1 / (1 + np.exp(-np.clip(beta[idx] @ weight + beta[-1], -30, 30))) - soft
            grad = miss * weight + decay * beta[idx]
            seen[idx] += grad**2
            beta[idx] -= rate * grad / np.sqrt(seen[idx])
            seen[-1] += miss**2
            beta[-1] -= rate * miss / np.sqrt(seen[-1])
    return beta


def quality(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """Per row of docs: doc_id, votes, weak_label, score, kept.

    weak_label is the label model's posterior of good, estimated from the vote patterns of
    all rows; score is the linear scorer's probability, trained on at most TRAIN_ROWS
    distinct texts. Null and empty texts vote bad and score like a text without words;
    repeated rows score alike; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def vote(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in batch.column(0).to_pylist()], pa.string())], names=["votes"])

    found = rows.select("text").mapInArrow(vote, "votes string").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted(r["votes"] for r in found)
    sizes = {r["votes"]: r["n"] for r in found}
    posterior = dict(zip(patterns, label_model(patterns, np.array([sizes[p] for p in patterns]))[0].tolist(), strict=True)) if patterns else {}

    keyed = rows.select(F.xxhash64("text").alias("h"), "text")
    chosen = materialize(keyed.select("h").distinct().orderBy("h").limit(TRAIN_ROWS), "chosen")
    sample = keyed.join(broadcast_if_small(chosen, 8), "h").groupBy("h").agg(F.first("text").alias("text"))

    def featurise(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            both, voted = [], []
            for text in texts:
                read = Reading(text)
                both.append(features_of(read))
                voted.append(votes_of(read))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(voted, pa.string()), pa.array([i.astype(np.int32) for i, _ in both], pa.list_(pa.int32())), pa.array([w.astype(np.float32) for _, w in both], pa.list_(pa.float32()))], names=["h", "votes", "at", "weight"])

    train = sample.mapInArrow(featurise, "h long, votes string, at array<int>, weight array<float>").toArrow().sort_by("h")
    at, weight, voted = train.column("at"), train.column("weight"), train.column("votes").to_pylist()
    beta = fit_scorer([(a.values.to_numpy().astype(np.int64), w.values.to_numpy().astype(float), posterior[v]) for a, w, v in zip(at, weight, voted, strict=True)])
    state = docs.sparkSession.sparkContext.broadcast((posterior, beta))

    def score(batches):
        posterior, beta = state.value
        for batch in batches:
            voted, logit = [], []
            for text in batch.column(1).to_pylist():
                read = Reading(text)
                i, w = features_of(read)
                voted.append(votes_of(read))
                logit.append(beta[i] @ w + beta[-1])
            logit = np.array(logit, float)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(voted, pa.string()), pa.array([posterior.get(v, 0.5) for v in voted], pa.float64()), pa.array(p, pa.float64()), pa.array(p >= keep)], names=["doc_id", "votes", "weak_label", "score", "kept"])

    return materialize(rows.mapInArrow(score, "doc_id long, votes string, weak_label double, score double, kept boolean"), "quality")


def op4_weak_labels(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
