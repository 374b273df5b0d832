"""Vectors joined by blocks, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessel.operators import search as S


def _table(spark, m, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids or range(len(m)), m, strict=True)], "id long, vector array<double>").repartition(3)


def _far(a, b):
    return float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))))


def test_near_pairs_are_all_found(spark):
    """no pair below the distance is lost, whatever the vectors' scale, and no table of pairs is joined."""
    m = 20 * np.random.default_rng(3).normal(size=(400, 2))
    m[7] = m[300]
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if _far(m[i], m[j]) < 6.0}
    for block in (1000, 60):
        got = [(r["a_id"], r["b_id"]) for r in S.similar_pairs(_table(spark, m), 6.0, **({"block": block} if block < 1000 else {})).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_without_a_join_of_pairs(spark):
    """batch_knn pairs no rows in a join, and ties of copies go by id across blocks; null vectors come last."""
    rng = np.random.default_rng(4)
    m = [*rng.normal(size=(40, 6))] * 3 + [None, np.zeros(6)]
    df = _table(spark, m)
    q = df.where("id % 20 = 0 AND id < 100").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    plan = S.batch_knn(df, q, 7)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

    def cosine(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return 0.0 if size == 0 else round(float(a @ b / size), 9)

    for out in (S.batch_knn(df, q, 7), S.batch_knn_blocked(df, q, 7, block=16)):
        got = {(r["query_id"], r["rank"]): (r["id"], round(r["similarity"], 9)) for r in out.collect()}
        for i in range(0, 100, 20):
            best = sorted((-cosine(m[i], v), j) for j, v in enumerate(m) if v is not None)[:7]
            assert [got[i, k + 1] for k in range(7)] == [(j, -s) for s, j in best]
    few = S.batch_knn(_table(spark, [[1.0], None, [-1.0]]), _table(spark, [[2.0]]).toDF("query_id", "query_vector"), 5)
    assert [(r["id"], r["similarity"]) for r in few.orderBy("rank").collect()] == [(0, 1.0), (2, -1.0), (1, None)]


def test_all_distances_by_products(spark):
    """rounded distances by products equal those summed in element order, and no pair is a row of a join."""
    m = [*np.random.default_rng(5).normal(size=(90, 8)), np.full(8, 1e-9), np.zeros(8), None, [float("inf")] * 8]
    df = _table(spark, m).withColumn("label", F.when(F.col("id") != 5, F.col("id") % 2))
    plan = S.pairwise_l2_blocked(df, within="label")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
    for places, block in ((6, 20), (6, 1000), (None, 30)):
        got = [(r["a_id"], r["b_id"], r["distance"]) for r in S.pairwise_l2_blocked(df, within="label", places=places, block=block).collect()]
        pairs = [(i, j) for i in range(94) for j in range(i + 1, 94) if i % 2 == j % 2 and 5 not in (i, j)]
        assert sorted(g[:2] for g in got) == pairs
        for i, j, far in got:
            want = None if m[i] is None or m[j] is None else _far(m[i], m[j])
            assert far == (want if want is None or places is None or want == float("inf") else round(want, places))


def _shuffled(plan):
    """Records that the exchanges of a plan that has run have written, reused ones once."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _shuffled(plan.plan())
    if name == "ReusedExchange":
        return 0
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_blocks_are_written_once(spark, monkeypatch):
    """F1 of round 4: rows are not repeated for each block they meet, whatever a group's blocks; groups of one block and of several give each pair once."""
    from tessel.operators import blocks

    monkeypatch.setattr(blocks, "SIDES", 3)
    monkeypatch.setattr(blocks, "HELD", 3)
    m = np.random.default_rng(6).normal(size=(330, 4)).astype(np.float32)
    group = [0 if i < 200 else 1 if i < 300 else 2 if i < 329 else None for i in range(330)]
    df = spark.createDataFrame([(f"k{i:03}", v.tolist(), g) for i, (v, g) in enumerate(zip(m, group, strict=True))], "id string, vector array<float>, label int")
    out = S.pairwise_l2_blocked(df, within="label", places=6, block=25)
    got = sorted(map(tuple, out.collect()))
    pairs = [(i, j) for i in range(329) for j in range(i + 1, 329) if group[i] == group[j]]
    assert [g[:2] for g in got] == [(f"k{i:03}", f"k{j:03}") for i, j in pairs]
    assert all(g[2] == round(_far(m[i].astype(float), m[j].astype(float)), 6) for g, (i, j) in zip(got, pairs, strict=True))
    assert _shuffled(out._jdf.queryExecution().executedPlan()) < 2 * len(m)
    few = S.pairwise_l2_blocked(df.where("label = 2"), within="label", places=6, block=25).collect()
    assert len(few) == 29 * 28 // 2 and S.pairwise_l2_blocked(df.where("label IS NULL"), within="label").count() == 0


def test_rounded_distances_come_in_order(monkeypatch):
    """F1 of round 4: equal distances follow each other, sheet by sheet, so that files of pairs are small; every pair is there, also those too far for a sheet's keys."""
    from tessel.operators import blocks

    monkeypatch.setattr(blocks, "SHEET", 1 << 19)
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(700, 8)), rng.normal(size=(2100, 8))
    y[5] = y[4]

    def distances(x, y):
        parts = list(blocks.all_distances(6)((x, np.full(len(x), 8)), (y, np.full(len(y), 8))))
        i, j, far = (np.concatenate([p[k] for p in parts]) for k in range(3))
        assert len(i) == len(x) * len(y) == len(set(zip(i.tolist(), j.tolist(), strict=True)))
        return far, np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))[i, j]

    far, want = distances(x, y)
    assert np.abs(far - want).max() < 6e-7 and (np.diff(far) < 0).sum() < 4
    far, want = distances(np.vstack([x[:3], np.full((1, 8), 1e9)]), y)
    assert np.allclose(far, want, rtol=1e-12, atol=6e-7)
