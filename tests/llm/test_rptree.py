import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from freshet.llm import rptree

SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, x int, class int"


def brute(rows, threshold=0.93):
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], l) for i, e, l in rows]

    def usable(r):
        i, e, l = r
        return i is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    def cosine(a, b):
        return np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)

    n = len(rows)
    good = [usable(r) for r in rows]
    link = [
        [j for j in range(n) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2]
         and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold]
        for i in range(n)
    ]
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            for j in link[i]:
                if label[j] != label[i]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    out = []
    for i, (v, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i]] if good[i] else [v]
        least = min((x for x in ids if x is not None), default=None)
        out.append((v, len(link[i]), least, v is not None and v == least))
    return out


def key(r):
    return tuple(str(x) for x in r)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return [tuple(r) for r in rptree.near_vectors(df, **more).collect()]


def clustered(n, size, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 5, size))
    return [
        (i, (centres[draw.integers(len(centres))] + draw.normal(size=size) * 0.15).tolist(), i % 2)
        for i in range(n)
    ]


def test_equals_brute_force_in_one_leaf(spark):
    rows = clustered(200, 8, 1)
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_odd_rows(spark):
    draw = random.Random(1)
    v = [draw.gauss(0, 1) for _ in range(4)]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (None, v, 1), (5, [2 * x for x in v], 1)]
    rows += [(6, None, 1), (7, [], 1), (8, [0.0] * 4, 1), (9, [None, 1.0, 0.0, 0.0], 1), (10, [math.nan] * 4, 1)]
    rows += [(11, [math.inf, 0.0, 0.0, 0.0], 1), (12, [-0.0, 1.0, 0.0, 0.0], 1), (13, [0.0, 1.0, 0.0, 0.0], 1)]
    rows += [(14, v[:2], 1), (15, v[:2], 1), (16, [1e-30 * x for x in v], 1)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert run(spark, []) == []


def test_forest_finds_the_links(spark):
    """Many small leaves and parts: no link twice, none below the threshold, hardly one missed."""
    rows = clustered(1500, 16, 2)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    classes = rptree.distinct_vectors(df).select("class", "bucket", "x", "copies")
    found = rptree.link_vectors(classes, leaf=40, block=50)
    got = found.groupBy("class").sum("linked").collect()
    want = {r[0]: r[1] for r in brute(rows)}
    names = {r["class"]: r["least"] for r in rptree.distinct_vectors(df).collect()}
    total = {names[r["class"]]: r[1] for r in got}
    assert all(total.get(i, 0) <= n for i, n in want.items())
    assert sum(total.values()) >= 0.97 * sum(want.values())


def test_a_dense_group_is_compared_in_parts(spark):
    draw = np.random.default_rng(5)
    centre = draw.normal(size=8)
    rows = [(i, (centre + draw.normal(size=8) * 0.02).tolist(), 1) for i in range(300)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    classes = rptree.distinct_vectors(df).select("class", "bucket", "x", "copies")
    got = rptree.link_vectors(classes, leaf=20, block=40).groupBy("class").sum("linked").collect()
    assert sorted(r[1] for r in got) == [299] * 300


def test_leaves_are_cut_in_rounds_by_small_samples(spark):
    """A sample too thin for the whole tree at once: later rounds go on, and links stay found."""
    rows = clustered(3000, 16, 3)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    classes = rptree.distinct_vectors(df).select("class", "bucket", "x", "copies")
    once = rptree.plant(classes, 0.93, trees=3, leaf=50, sample=128, rounds=1)
    planted = rptree.plant(classes, 0.93, trees=3, leaf=50, sample=128)

    def largest(out):
        sizes = out.selectExpr("explode(leaves) AS leaf").groupBy("leaf").count()
        return sizes.agg({"count": "max"}).first()[0]

    assert planted.count() == 3000 and planted.where("size(leaves) < 3").isEmpty()
    assert largest(planted) <= 100 < largest(once)
    sides = {r["class"]: (r["bucket"], set(r["leaves"])) for r in planted.join(classes.select("class", "bucket"), "class").collect()}
    buckets = {}
    for bucket, names in sides.values():
        for name in names:
            assert buckets.setdefault(name, bucket) == bucket
    x = {r["class"]: np.array(r["x"]) / np.linalg.norm(r["x"]) for r in classes.collect()}
    names, matrix = list(x), np.stack(list(x.values()))
    a, b = np.nonzero(np.triu(matrix @ matrix.T >= 0.93, 1))
    pairs = [(names[i], names[j]) for i, j in zip(a, b) if sides[names[i]][0] == sides[names[j]][0]]
    met = sum(bool(sides[i][1] & sides[j][1]) for i, j in pairs)
    assert met >= 0.95 * len(pairs)


def test_deep_trees_keep_the_links_of_one_label(spark, tmp_path):
    """60,000 vectors of one label, in small groups at cosines about the threshold."""
    draw = np.random.default_rng(8)
    n, size, group = 60_000, 64, 4
    centres = draw.normal(size=(n // group, size)).astype(np.float32)
    spread = np.sqrt(1 / 0.935 - 1)
    x = np.repeat(centres, group, axis=0) + spread * draw.normal(size=(n, size)).astype(np.float32)
    lists = pa.ListArray.from_arrays(np.arange(0, n * size + 1, size, dtype=np.int32), x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists, "label": np.ones(n, int)}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = sum(int((b @ unit.T >= 0.93).sum()) for b in np.array_split(unit, 60)) - n
    got = rptree.near_vectors(df).agg({"n_links": "sum"}).first()[0]
    assert want > 20_000 and 0.999 * want <= got <= want
