import math
import random

import numpy as np
import pytest

from freshet.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score long, block int"


def brute(rows, k, step):
    v = {}
    items = []
    for i, e in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e):
            items.append((i, [math.floor(256 * x) for x in e]))
    out = set()
    for i, q in items:
        if i % step == 0:
            scored = [(-sum(a * b for a, b in zip(q, c)), j) for j, c in items if j != i and len(c) == len(q)]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])}
    del v
    return out


def run(spark, rows, k=5, step=7, **more):
    df = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], SCHEMA)
    v = topk.integer_vectors(df)
    got = topk.top_products(v.where(f"vec_id % {step} = 0"), v, k=k, **more).collect()
    return {tuple(r) for r in got}, len(got)


@pytest.mark.parametrize("scale", [0.02, 1.0, 300.0])
def test_equals_brute_force(spark, scale):
    draw = random.Random(scale)
    rows = [
        (i, [draw.gauss(0.3, scale) * draw.random() for _ in range(12)]) for i in range(400)
    ]
    got, n = run(spark, rows, rows_in_slice=100, block=20)
    assert got == brute(rows, 5, 7) and n == len(got)


def test_odd_rows(spark):
    draw = random.Random(2)
    rows = [(i, [float(draw.randrange(-2, 3)) for _ in range(3)]) for i in range(40)]
    rows += [(None, [1.0, 1.0, 1.0]), (70, None), (77, []), (84, [None, 1.0, 1.0]), (91, [math.nan, 1.0, 1.0])]
    rows += [(98, [math.inf, 1.0, 1.0]), (105, [0.0, 0.0, 0.0]), (112, [1.0, 2.0]), (119, [2.0, 1.0]), (126, [5.0])]
    got, _ = run(spark, rows)
    assert got == brute(rows, 5, 7)
    assert run(spark, [])[0] == set()


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**22 + i, -(2.0**22) + 3 * i, 1.0]) for i in range(30)]
    assert run(spark, rows)[0] == brute(rows, 5, 7)


def test_pruning_changes_nothing():
    rng = np.random.default_rng(0)
    vectors = np.floor(256 * rng.normal(size=(3000, 32)) * rng.random((3000, 1)) ** 3).astype(np.int64)
    queries = vectors[:40]
    _, axes = np.linalg.eigh((vectors.T @ vectors).astype(float))
    best = topk.search(np.arange(40), queries, np.arange(3000), vectors, axes[:, ::-1].T, 5, head=8, rows=128)
    for q in range(40):
        scores = (vectors @ queries[q]).astype(float)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(3000), -scores))[:5]
        assert best.ids[q].tolist() == want.tolist()
