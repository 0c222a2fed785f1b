import math
import random

import pytest

from factloom.llm import knn

ROWS = "vec_id long, embedding array<float>, label string"


def brute(rows, every=5):
    def whole(v):
        return [math.floor(1024 * x) for x in v]

    fine = [(i, whole(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in fine if i % every == 0}:
        mine = min(v for i, v in fine if i == q)
        scored = [(-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in fine if i != q and len(v) == len(mine)]
        out[q] = [(i, -s) for s, i in sorted(scored)[:10]]
    return {q: v for q, v in out.items() if v}


def check(spark, rows, every=5):
    found = {}
    for r in knn.top_k(spark.createDataFrame(rows, ROWS), every).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert found == brute([(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v], t) for i, v, t in rows], every)


def test_random_ties_nulls_and_lengths(spark):
    random.seed(4)
    rows = [(i, [random.choice([-1.0, 0.25, 0.1, 3.3]) for _ in range(4)], "x") for i in range(120)]
    rows += [(200, None, "x"), (205, [1.0, None, 2.0, 3.0], "x"), (210, [1.0, float("nan"), 0.0, 0.0], "x"), (215, [float("inf")] * 4, "x")]
    rows += [(None, [1.0] * 4, "x"), (7, [0.1] * 4, "x"), (10, [0.1] * 4, "x"), (300, [1.0, 2.0], "x"), (301, [2.0, 1.0], "x"), (400, [], "x"), (401, [], "x")]
    check(spark, rows)


def test_clustered_data_is_pruned_and_exact(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_QUERIES", 8)
    random.seed(5)
    centres = [[random.uniform(-30, 30) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + random.gauss(0, 0.05) for x in random.choice(centres)], "x") for i in range(400)]
    rows += [(1000 + i, centres[0], "hot") for i in range(200)]
    check(spark, rows, every=10)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], "x")], [(0, [1.0], "x"), (1, [2.0], "x")], [(5, [1e30, 2.0], "x"), (6, [1e30, 1.0], "x")]])
def test_tiny_tables(spark, rows):
    if rows and rows[0][1] and rows[0][1][0] > 1e20:
        assert knn.top_k(spark.createDataFrame(rows, ROWS), 5).collect()[0]["score"] == 2**63 - 1
    else:
        check(spark, rows)


def test_only_cells_with_queries_and_near_ones_are_sent(spark):
    random.seed(6)
    centres = [[random.uniform(-30, 30) for _ in range(8)] for _ in range(60)]
    rows = [(i, [x + random.gauss(0, 0.05) for x in centres[i % 60]], "x") for i in range(1500)]
    found = knn.plan(spark.createDataFrame(rows, ROWS), 300)
    assert len(found.groups()) >= 1 and found.replication() < 0.25
    check(spark, rows, every=300)


def test_cells_that_need_different_data_stay_apart_and_others_merge():
    import numpy as np

    apart = np.kron(np.eye(3, dtype=bool), np.ones((100, 1), bool))
    assert knn.merge_cells(apart, np.array([50, 50, 50]), 10.0).tolist() == [0, 1, 2]
    assert knn.merge_cells(np.ones((100, 3), bool), np.array([50, 50, 50]), 10.0).tolist() == [0, 0, 0]
    assert len(set(knn.merge_cells(np.ones((100, 3), bool), np.array([knn.GROUP_QUERIES] * 3), 10.0).tolist())) == 3


def test_clashing_columns_are_not_read(spark):
    rows = [(i, [float(i), 1.0], "c", "g", i) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string, cell string, grp long")
    assert knn.top_k(frame, 6).count() == 20


def test_chunks_and_parts_agree(spark, monkeypatch):
    random.seed(7)
    rows = [(i, [random.choice([-1.0, 0.5, 2.0]) for _ in range(3)], "x") for i in range(300)]
    monkeypatch.setattr(knn, "CHUNK_ROWS", 40)
    monkeypatch.setattr(knn, "GROUP_QUERIES", 7)
    check(spark, rows, every=3)
