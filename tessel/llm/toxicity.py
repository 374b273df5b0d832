"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.boosting import BoostedTrees, Isotonic
from tessel.llm.common import broadcast_if_small, free_caches, materialize, table

#: Labelled rows the model is fitted on at most, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Words and stems learned from labels at most, and the toxic documents each must occur in.
LEARNED, LEAST_DOCS = 64, 8
#: Odds by which a learned word or stem favours toxic documents.
LEAST_ODDS = 20.0
#: Letters of a stem; a learned stem ends with "*" and stands for all words that start with it.
STEMS = (4, 5, 6)
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3

#: Insults to start from.
SEED = ("idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "jerk", "imbecile", "cretin", "garbage", "vermin", "filth", "dummkopf", "trottel", "arschloch", "abschaum", "crétin", "connard", "salaud", "ordure", "imbécil", "estúpido", "basura", "escoria", "idiota", "tonto")
#: Second-person words of the corpus languages.
SECOND = frozenset(("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros"))
#: Words between an insult and a second-person word that count as near.
NEAR = 6

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[@$0134578!*+]+[^\W\d_]")
_SPACE = re.compile(r"\s")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "!": "i", "+": "t", "*": None})
_REPEAT = re.compile(r"([^\W\d_])\1{3,}")
_UPPER = re.compile(r"\b[^\W\d_a-zà-ÿ]{3,}\b")
_PUNCT = re.compile(r"[!?]+")

FEATURES = ("log_words", "seed_density", "learned_density", "log_hits", "distinct_hits", "near_second", "second_density", "capitals", "shouted", "bangs", "punctuation", "symbols", "obfuscated", "obfuscated_hits", "repeats", "mean_word")


def mixed_words(low: str) -> list[str]:
    """White-space separated words in which a digit or symbol stands before a letter."""
    found, end = [], 0
    for m in _MIXED.finditer(low):
        if m.start() >= end:
            start = m.start()
            while start > end and not low[start - 1].isspace():
                start -= 1
            stop = _SPACE.search(low, m.end())
            end = stop.start() if stop else len(low)
            found.append(low[start:end].rstrip(".,;:?"))
    return found


def dense_features(text: str | None, learned: frozenset[str], seed: frozenset[str] = frozenset(SEED)) -> list[float]:
    """FEATURES of a whole text; null and empty texts give zeros."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(len(words), 1), max(len(text), 1)
    every = seed | learned
    hits = near = in_seed = in_learned = 0
    distinct: set[str] = set(every.intersection(words))
    for k in STEMS:
        stems = {w[:-1] for w in learned if w[-1] == "*" and len(w) == k + 1}
        if stems and (found := stems.intersection([w[:k] for w in words])):
            distinct.update(w for w in words if w[:k] in found)
    you = SECOND.intersection(words)
    second = sum(w in SECOND for w in words) if you else 0
    if distinct:
        places = [i for i, w in enumerate(words) if w in distinct]
        hits = len(places)
        in_seed = sum(words[i] in seed for i in places)
        in_learned = hits - sum(words[i] in seed and words[i] not in learned for i in places)
        if you:
            near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in places)
    odd = mixed_words(low)
    odd_hits = {w.translate(_LEET) for w in odd} & every
    spaced = [re.sub(r"[ .\-_*]", "", m) for m in _SPACED.findall(low)]
    odd_hits |= every.intersection(spaced)
    upper = sum(map(len, _UPPER.findall(text)))
    letters = max(sum(map(len, words)), 1)
    bangs = _PUNCT.findall(text)
    plain = text.count(" ") + text.count("\n")
    return [
        float(np.log1p(len(words))),
        in_seed / n,
        in_learned / n,
        float(np.log1p(hits + len(odd_hits))),
        float(len(distinct | odd_hits)),
        near / n,
        second / n,
        upper / letters,
        float(upper > 0.5 * letters),
        len(bangs) / n,
        sum(map(text.count, ".,;:!?")) / chars,
        max(0, chars - letters - plain) / chars,
        len(odd) / n + len(spaced) / n,
        float(len(odd_hits)),
        len(_REPEAT.findall(low)) / n,
        letters / n,
    ]


def held_out():
    """Whether crc32 of doc_id's text leaves 2 modulo 4; rows without doc_id are not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most `rows` labelled documents outside the held-out part; equal texts count once."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    chosen = materialize(usable.orderBy(F.xxhash64("doc_id"), "toxic").limit(rows), "labelled")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(broadcast_if_small(chosen, 24), "doc_id")
    keyed = materialize(found.withColumn("h", F.xxhash64("text")), "training")
    once = keyed.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return keyed.join(broadcast_if_small(once, 24), ["h", "doc_id"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")


def learn_words(train: DataFrame, words: int = LEARNED) -> frozenset[str]:
    """Words and stems that occur in toxic training texts by LEAST_ODDS more often than in the others.

    The most frequent come first; what a learned stem covers is left out.
    """

    def split(batches):
        free_caches()
        for batch in batches:
            pairs: list[tuple[str, int]] = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = {w for w in _WORD.findall((text or "").lower()) if len(w) < 40}
                pairs += [(w, y) for w in said | {w[:k] + "*" for w in said for k in STEMS if len(w) >= k}]
                if len(pairs) > 50_000:
                    yield emit(pairs)
                    pairs = []
            yield emit(pairs)

    def emit(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32())], names=["word", "toxic"])

    said = train.select("text", "toxic").mapInArrow(split, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    total = train.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).head()
    bad, good = (total["bad"] or 0) + 1, (total["good"] or 0) + 1
    odds = (F.col("bad") / F.lit(bad)) / ((F.col("good") + 0.5) / F.lit(good))
    top = said.where((F.col("bad") >= max(LEAST_DOCS, bad // 50)) & (odds >= LEAST_ODDS)).orderBy(F.desc("bad"), F.length("word"), "word").limit(16 * words)
    learned: list[str] = []
    for row in top.collect():
        if len(learned) < words and not any(w[-1] == "*" and row["word"].startswith(w[:-1]) for w in learned):
            learned.append(row["word"])
    return frozenset(learned)


def _featurise(learned: frozenset[str], extra: list[tuple[str, pa.DataType]]):
    def run(batches):
        for batch in batches:
            rows = [dense_features(t, learned) for t in batch.column("text").to_pylist()]
            flat = pa.array(np.array(rows, float).reshape(-1))
            vectors = pa.FixedSizeListArray.from_arrays(flat, len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n).cast(t) for n, t in extra], vectors], names=[*[n for n, _ in extra], "features"])

    return run


def fit(train: DataFrame) -> tuple[frozenset[str], BoostedTrees, Isotonic]:
    """The learned words, the trees and the calibration; a quarter of the rows calibrates."""
    learned = learn_words(train)
    rows = train.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).cast("int"))
    got = rows.select("text", "toxic", "fold", "doc_id").mapInArrow(_featurise(learned, [("toxic", pa.int32()), ("fold", pa.int32()), ("doc_id", pa.int64())]), "toxic int, fold int, doc_id long, features array<double>").orderBy("doc_id").collect()
    x = np.array([r["features"] for r in got], float).reshape(-1, len(FEATURES))
    y, fold = np.array([r["toxic"] for r in got], float), np.array([r["fold"] for r in got], int)
    trees = BoostedTrees().fit(x[fold != 0], y[fold != 0])
    return learned, trees, Isotonic().fit(trees.score(x[fold == 0]), y[fold == 0])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, and the string `carry` where one is given.

    The model is fitted on at most TRAIN_ROWS labelled rows outside the held-out part and
    scores every whole text. Null and empty texts score like a text without words. Without
    usable labels every score is 0.5. Repeated rows score alike; only doc_id and text of
    docs are read.
    """
    learned, trees, calibrated = fit(training_rows(docs, labels))
    state = docs.sparkSession.sparkContext.broadcast((learned, trees, calibrated))

    def run(batches):
        free_caches()
        learned, trees, calibrated = state.value
        for batch in batches:
            x = np.array([dense_features(t, learned) for t in batch.column(2).to_pylist()], float).reshape(-1, len(FEATURES))
            score = np.clip(calibrated(trees.score(x)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", "carried"][: 1 + batch.num_columns])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), *([] if carry is None else [carry.alias("carried")]))
    return materialize(rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + ("" if carry is None else ", carried string")), "toxicity")


def op9_boosted_trees(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
