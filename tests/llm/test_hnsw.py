import numpy as np
from pyspark.sql import functions as F

from ledgerscope.llm import hnsw


def search(spark, rows, count=5, shard=300):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = hnsw.neighbours(table, F.col("vec_id") % 20 == 0, count, shard=shard).collect()
    out = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def exact(rows, query, count):
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    scores = [(i, float((vectors[query] * v).sum())) for i, v in vectors.items() if i != query]
    return sorted(scores, key=lambda s: (-s[1], s[0]))[:count]


def test_recall_and_scores(spark):
    random = np.random.default_rng(3)
    rows = [(i, (random.normal(size=16) * (1 + i % 3)).tolist(), 1) for i in range(1000)]
    found = search(spark, rows, 10)
    assert len(found) == 50
    recall = []
    for query, near in found.items():
        best = dict(exact(rows, query, 10))
        recall.append(len(best.keys() & dict(near).keys()) / 10)
        assert all(abs(score - dict(exact(rows, query, 1000))[i]) < 1e-9 for i, score in near)
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
    assert np.mean(recall) > 0.95


def test_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1)]
    rows += [(6, [None, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (20, [0.5, -2.0], 1), (40, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1)]
    assert search(spark, rows) == {0: [(1, 1.0), (2, 1.0), (20, 0.5)], 20: [(0, 0.5), (1, 0.5), (2, 0.5)]}


def test_equal_vectors(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(200)] + [(i, [0.0, 1.0 + i], 1) for i in range(200, 230)]
    found = search(spark, rows, 3, shard=50)
    assert all(len(near) == 3 for near in found.values())


def test_equal_vectors_by_smallest_id(spark):
    """Groups larger than a result, and more rows of the query's own id than that."""
    near = [[2.0, 1.0], [2.0, 0.5], [1.0, 2.0]]
    rows = [(i * 7 % 400 + 1000, near[i % 3] if i % 2 else [-1.0, float(i)], 1) for i in range(400)]
    rows += [(20, near[0], 1)] * 30 + [(20, [1.9, 0.9 + j / 1000], 1) for j in range(30)] + [(40, near[1], 1), (60, near[2], 1)]
    others = {20: [(i, v) for i, v, _ in rows if i != 20], 40: [(i, v) for i, v, _ in rows if i != 40], 60: [(i, v) for i, v, _ in rows if i != 60]}
    for shard in (1000, 150):
        found = search(spark, [r for r in rows if r[0] % 20 or r[0] < 100], 5, shard=shard)
        for query, vector in ((40, near[1]), (60, near[2])):
            scored = [(i, float(np.dot(np.array(vector, np.float32).astype(float), np.array(v, np.float32).astype(float)))) for i, v in others[query] if i % 20 or i < 100]
            best = sorted(scored, key=lambda s: (-s[1], s[0]))[:5]
            assert [i for i, _ in found[query]] == [i for i, _ in best]
        assert len(found[20]) == 5 and all(i != 20 for i, _ in found[20])


def test_empty_tables(spark):
    assert search(spark, []) == {}
    assert search(spark, [(1, [0.0], 1)]) == {}
