"""Exact top-k inner products over norm-sorted blocks.

Vectors of integers are rotated to the principal axes of a bounded sample, so that the first few
rotated components carry most of a product, and cut into blocks by descending length. A query
meets the longest vectors first; later ones are left out where the Cauchy-Schwarz bound on the
whole product, or on what the first components leave open, is below the k-th best so far. Only
bounds are rounded, with a margin; scores are integer products of the vectors themselves.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.storage import stage

SAMPLE = 4096  # Vectors that the rotation is fitted on, per dimension, at most.
SHAPES = 8  # Dimensions with a rotation of their own, the most frequent; others are not rotated.
HEAD = 16  # Rotated components summed before a candidate may be left out.
QUERIES = 512  # In a block.
ROWS = 1024  # Candidates compared at a time; the long ones come first.
SLICE = 8192  # Candidates in a slice, which one task holds, about.
_EXACT = 2.0**53


def integer_vectors(rows: DataFrame, id="vec_id", vector="embedding", scale=256):
    """vec_id, v (array<long>: floor(scale * x)), size, of vectors without null or non-finite
    components; null and empty vectors go."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda a: F.coalesce(~F.isnan(a) & (F.abs(a) < float("inf")), F.lit(False)))
    return (
        rows.where(good & (F.size(x) > 0) & F.col(id).isNotNull())
        .select(
            F.col(id).alias("vec_id"), F.transform(x, lambda a: F.floor(a * scale).cast("long")).alias("v")
        )
        .withColumn("size", F.size("v"))
    )


def fit_rotations(vectors: DataFrame, sample=SAMPLE, shapes=SHAPES):
    """For the most frequent sizes, the singular vectors of a sample, as rows by falling weight."""
    sizes = vectors.groupBy("size").count().orderBy(F.desc("count"), "size").limit(shapes).collect()
    out = {}
    for row in sizes:
        own = vectors.where(F.col("size") == row["size"])
        drawn = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
        matrix = np.array([r["v"] for r in drawn], float)
        _, axes = np.linalg.eigh(matrix.T @ matrix)
        out[row["size"]] = np.ascontiguousarray(axes[:, ::-1].T)
    return out


def _products(a, b):
    """Exact integer products of rows of ``a`` with rows of ``b``, as objects if they are too large."""
    bound = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0)))
    if bound * a.shape[1] < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound * a.shape[1] < 2.0**63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


class Best:
    """The k best (score, id) of each of ``n`` queries; ties go to the smaller id."""

    def __init__(self, n, k):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)

    def add(self, q, scores, ids):
        scores = np.concatenate([self.scores[q], scores])
        ids = np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = float(self.scores[q][-1])


def search(query_ids, queries, ids, vectors, axes, k, head=HEAD, rows=ROWS):
    """Top k of each query among ``vectors``: a Best.

    A candidate with the query's own id is passed over.
    """
    best = Best(len(queries), k)
    lengths = np.linalg.norm(vectors.astype(float), axis=1)
    order = np.argsort(-lengths, kind="stable")
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    q = queries.astype(float) @ axes.T
    c = vectors.astype(float) @ axes.T
    q_length = np.linalg.norm(q, axis=1)
    q_rest = np.linalg.norm(q[:, head:], axis=1)
    c_rest = np.linalg.norm(c[:, head:], axis=1)
    for a in range(0, len(vectors), rows):
        b = min(a + rows, len(vectors))
        margin = 1e-9 * q_length * lengths[a] + 1e-6
        live = np.flatnonzero(q_length * lengths[a] + margin >= best.floor)
        if not len(live):
            break  # No later vector is longer.
        bound = q[live, :head] @ c[a:b, :head].T + np.outer(q_rest[live], c_rest[a:b])
        hopeful = bound + margin[live, None] >= best.floor[live, None]
        several = hopeful.mean() > 0.25
        if several:
            scores = _products(queries[live], vectors[a:b])
        for row, at in enumerate(live):
            # The floor rises as queries are met, not within a row: a row's scores come at once.
            these = np.flatnonzero(hopeful[row] & (ids[a:b] != query_ids[at]))
            if not len(these):
                continue
            got = scores[row, these] if several else _products(queries[at : at + 1], vectors[a + these])[0]
            if len(got) > 4 * k:
                edge = np.partition(got, len(got) - k)[len(got) - k]
                keep = got >= edge
                these, got = these[keep], got[keep]
            best.add(at, got, ids[a + these])
    return best


def _matrix(column, size):
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def top_products(queries: DataFrame, vectors: DataFrame, k=5, rows_in_slice=SLICE, block=QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of each query.

    Both take vec_id, v, size as from ``integer_vectors``; products are of vectors of equal size,
    with every vector but those of the query's own id. Ties go to the smaller vec_id; a query has
    fewer rows where there are fewer vectors. Rows that repeat a candidate count each; those that
    repeat a query id give their best together, once each rank. Empty tables give an empty one.

    Candidates are dealt to slices that mix all lengths, queries to blocks; a task compares one
    block with one slice and returns k rows a query, so neither side is ever whole in a task.
    """
    vectors = stage(vectors, "vectors")
    queries = stage(queries, "queries")
    n, m = vectors.count(), queries.count()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    slices, blocks = max(1, -(-n // rows_in_slice)), max(1, -(-m // block))
    axes = fit_rotations(vectors)
    none = F.lit(None).cast(kind)
    dealt = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(slices)).cast("int").alias("slice"),
        none.alias("query_id"),
        "vec_id",
        "size",
        "v",
    ).union(
        queries.select(
            F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
            F.col("vec_id").alias("query_id"),
            none.alias("vec_id"),
            "size",
            "v",
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        asks = table.column("query_id").is_valid().to_numpy(zero_copy_only=False)
        left, right = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q_ids = left.column("query_id").to_numpy()
            best = search(
                q_ids,
                _matrix(left.column("v"), size),
                right.column("vec_id").to_numpy(),
                _matrix(right.column("v"), size),
                axes.get(size, np.eye(size)),
                k,
            )
            for q, scores, ids in zip(q_ids, best.scores, best.ids):
                out["query_id"] += [q] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table(
            {
                "query_id": pa.array(out["query_id"], table.schema.field("query_id").type),
                "vec_id": pa.array(out["vec_id"], table.schema.field("vec_id").type),
                "score": pa.array(out["score"], pa.int64()),
            }
        )

    found = dealt.groupBy("block", "slice", "size").applyInArrow(
        compare, f"query_id {kind}, vec_id {kind}, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
