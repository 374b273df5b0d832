"""The semiotic cycle against a plain second reading of its rules, and the stream against the table."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators.cycle import DISSONANCE_WEIGHTS, LEARNING_RATES, Settings, cycles
from tessel.operators.fold import ordered_fold
from tessel.plans.cycle_queries import rocks
from tessel.streaming.cycles import stream_cycles
from tessel.streaming.events import run_to_table

WIDTH = 6
RND = np.random.default_rng(4)


def units(n):
    x = RND.normal(size=(n, WIDTH))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


START = units(8)
SETTINGS = Settings(start=START, reference=START + 0.2 * units(8), articles=units(3), critical=(1,), anchors=units(2), themes=units(5), every=50.0, vigilance=120.0, hold=70.0, speak=1.35, cumulative=0.002, per_dimension=0.5)


def length(v):
    return math.sqrt(sum(a * a for a in v))


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def cosine(a, b):
    return dot(a, b) / (length(a) * length(b)) if length(a) and length(b) else 0.0


def plain(name, triggers, s):
    """The course of one entity, second by second, with lists and loops only."""
    x = [list(map(float, r)) for r in s.start]
    checked, moved_in_all, state, impacts, out = None, 0.0, 0, 0, []

    def drift():
        nonlocal checked, moved_in_all
        flat = [a for r in x for a in r]
        moved = 0.0
        if checked is not None:
            moved = length([a - b for a, b in zip(flat, checked, strict=True)]) / length(checked)
            moved_in_all += moved
        checked = flat
        far = sum(1 - cosine(a, list(b)) > s.per_dimension for a, b in zip(x, s.reference, strict=True))
        return "critical" if moved_in_all > 2 * s.cumulative else "warning" if moved_in_all > s.cumulative or far > 2 or moved > s.per_cycle else "ok"

    def cycle(at, kind, e, context):
        nonlocal x, state, impacts
        e = [a / (length(e) or 1) for a in e]
        total = sum(w * (1 - cosine(e, r)) for w, r in zip(DISSONANCE_WEIGHTS, x, strict=True))
        near = [cosine(e, c) for c in context or []]
        hard = sum(n < 0.1 for n in near)
        total += 0.2 * hard / len(near) + (0.1 * (1 - max(near)) if max(near) < 0.3 else 0) if near else 0.1
        impacts += total > 0.3
        to = lambda k, w: [w * (a - b) for a, b in zip(e, x[k], strict=True)]
        none = [0.0] * WIDTH
        parts = [to(2, 0.1) if dot(e, x[2]) > 0.8 else none]
        aligned = [dot(e, a) for a in s.articles]
        if any(aligned[k] < 0.3 for k in s.critical):
            parts.append(to(7, -0.3))
        elif min(aligned) < 0.3:
            parts.append(to(7, -0.1))
        elif sum(aligned) / len(aligned) > 0.7:
            parts.append(to(7, 0.2))
        elif sum(dot(e, a) for a in s.anchors) / len(s.anchors) > 0.6:
            parts.append(to(2, 0.15))
        else:
            parts.append(none)
        c = sum(dot(e, x[k]) for k in (0, 2, 4, 7)) / 4
        parts.append(to(2, 0.15 * c if c > 0.5 else 0.05))
        if near:
            p = sum(dot(e, v) / (length(v) + 1e-8) for v in context) / len(context)
            parts.append(to(2, 0.3) if p > 0.6 else to(2, 0.15) if p > 0.3 else to(1, 0.1))
        else:
            parts.append(to(1, 0.05))
        size = min(0.001, length([sum(w * p[i] for w, p in zip((0.05, 0.25, 0.25, 0.45), parts, strict=True)) for i in range(WIDTH)]))
        x = [[a + r * size * (b - a) for a, b in zip(row, e, strict=True)] for row, r in zip(x, LEARNING_RATES, strict=True)]
        x = [[a / length(row) for a in row] for row in x]
        state += 1
        if kind == "user":
            reason = "conversation_mode"
        elif total > s.speak:
            reason = "high_dissonance_discovery"
        elif (level := drift()) != "ok":
            reason = f"drift_alert_{level}"
        else:
            reason = "multiple_contradictions" if hard >= 3 else "silent_processing"
        out.append((at, kind, state, total, hard, impacts if total > 0.3 else None, size, size > 0.0005, reason != "silent_processing", reason))

    first, last = triggers[0][0], triggers[-1][0]
    marks = [(t[0], 0, t) for t in triggers]
    marks += [(first + k * s.vigilance, 1, None) for k in range(1, int((last - first) // s.vigilance) + 1)]
    marks += [(first + k * s.every, 2, k) for k in range(1, int((last - first) // s.every) + 1)]
    for at, what, more in sorted(marks, key=lambda m: m[:2]):
        if what == 0 and more[2] == "reset":
            x, checked, moved_in_all, state, impacts = [list(map(float, r)) for r in s.start], None, 0.0, 0, 0
        elif what == 0 and more[3] is not None:
            cycle(at, more[2], more[3], more[4])
        elif what == 1 and (level := drift()) != "ok":
            out.append((at, "vigilance", state, None, None, None, None, None, level == "critical", f"drift_alert_{level}"))
        elif what == 2 and not any(t[2] == "user" and t[0] <= at < t[0] + s.hold for t in triggers):
            cycle(at, "internal", list(s.themes[zlib.crc32(f"{name}:{more}".encode()) % len(s.themes)]), None)
    return out


def triggers():
    rows = []
    for user in (None, 1, 2, 3):
        at = 1_700_000_000.0
        for k in range(60):
            at += float(RND.integers(0, 40)) / 2
            kind = str(RND.choice(["user", "veille", "corpus", "corpus", "reset"], p=[0.15, 0.3, 0.3, 0.2, 0.05]))
            e = None if k % 17 == 5 else RND.normal(size=WIDTH).tolist()
            context = [None, [], RND.normal(size=(4, WIDTH)).tolist()][k % 3]
            rows.append((user, at, k, kind, e, context))
    return rows


SCHEMA = "user_id long, at double, nth long, kind string, e array<double>, context array<array<double>>"
ROWS = triggers()


def plain_all():
    want = []
    for user in (None, 1, 2, 3):
        own = [(r[1], r[2], r[3], r[4], r[5]) for r in ROWS if r[0] == user]
        want += [(user, *r) for r in plain("" if user is None else str(user), own, SETTINGS)]
    return comparable(want)


def comparable(rows):
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in map(plain, r))) for r in rows)


def test_courses(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = comparable(tuple(r) for r in cycles(df, SETTINGS).collect())
    want = plain_all()
    assert got == want
    assert all(any(x in r for r in want) for x in ("internal", "vigilance", "silent", "high_dissonance", "drift_alert_warning", "conversation"))
    assert cycles(df.limit(0), SETTINGS).collect() == []


def stream(spark, folder, out):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    with rocks(spark):
        run_to_table(stream_cycles(raw.withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long"))), SETTINGS, late="110 seconds"), f"{out}/t", f"{out}/c")
    return spark.read.parquet(f"{out}/t")


def test_a_stream_gives_the_same_courses_in_any_order_and_after_a_restart(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    df = spark.createDataFrame(ROWS, SCHEMA)
    # up to 100 seconds of disorder between files
    block = F.least(F.lit(2), F.floor((F.col("at") - 1_700_000_000 + F.pmod(F.xxhash64("user_id", "nth"), F.lit(100))) / 230))
    part = lambda k: df.where(block == k).coalesce(1)
    part(0).write.mode("append").parquet(folder)
    part(1).write.mode("append").parquet(folder)
    early = stream(spark, folder, out)
    n = early.count()
    assert 0 < n < len(plain_all())
    part(2).write.mode("append").parquet(folder)
    # a mark far ahead lets the watermark pass everything
    spark.createDataFrame([(99, ROWS[-1][1] + 10_000, 0, "reset", None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    got = stream(spark, folder, out)  # restarts from the checkpoint
    columns = [c for c in got.columns if c not in ("epoch", "batch")]
    assert comparable(tuple(r) for r in got.select(*columns).collect()) == plain_all()


def test_settings_are_checked():
    Settings(start=units(8)).validate()
    for wrong in ({"fixation": (0.5, 0.5, 0.5, 0.5)}, {"per_cycle": 1.5}, {"critical_multiplier": 1.0}, {"every": 5.0}, {"vigilance": -1.0}, {"reference": units(3)}):
        with pytest.raises(ValueError):
            Settings(start=units(8), **wrong).validate()


def test_conversations_hold_the_clock(spark):
    rows = [(1, 0.0, 0, "corpus", [1.0] * WIDTH, None), (1, 90.0, 1, "user", [1.0] * WIDTH, None), (1, 260.0, 2, "corpus", [1.0] * WIDTH, None)]
    got = cycles(spark.createDataFrame(rows, SCHEMA), Settings(start=units(8), themes=units(2), every=50.0, hold=70.0)).orderBy("at").collect()
    # ticks at 100 and 150 fall into the conversation from 90 to 160
    assert [(r["at"], r["kind"]) for r in got] == [(0.0, "corpus"), (50.0, "internal"), (90.0, "user"), (200.0, "internal"), (250.0, "internal"), (260.0, "corpus")]


def test_folds_stream_by(spark):
    """A key's rows pass in order over many batches; only its state stays."""
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("x"))
    fold = ordered_fold(df, ["k"], ["o"], "k bigint, last bigint, n bigint", lambda s, r: (((s or (0, 0))[0] * 31 % 1009 + r["x"], (s or (0, 0))[1] + 1), []), lambda key, s: [(*key, s[0], s[1])])
    want = []
    for k in range(3):
        s = 0
        for i in range(k, 50_000, 3):
            s = s * 31 % 1009 + i * 7 % 11
        want.append((k, s, len(range(k, 50_000, 3))))
    assert sorted(tuple(r) for r in fold.collect()) == want


def test_tensors_by_brute_force(spark, small):
    from tessel.plans.state_queries import tensor_recursion

    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    x = np.array([v[i] for i in range(8)])
    for i in sorted(v)[8:]:
        x = x + np.array((0.1, 0.2, 0.3, 0.2, 0.1, 0.1, 0.05, 0.05))[:, None] * 0.001 * (v[i] - x)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = sorted((r["dim"], r["first"]) for r in tensor_recursion(spark, small).collect())
    assert np.allclose([f for _, f in got], x[:, 0], atol=1e-8)


def test_the_streamed_query_equals_the_table(spark, small):
    from tessel.plans.cycle_queries import semiotic_cycles, stream_semiotic_cycles

    a, b = (sorted(map(str, f(spark, small).collect())) for f in (semiotic_cycles, stream_semiotic_cycles))
    assert a and len(a) == len(b)
    assert a == b
