"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits a group at the median of a random projection, again and again, until its leaves are
small; vectors near a split go to both sides. Of a few random directions the split takes the one
that has the fewest vectors near it, which keeps more pairs together and copies fewer vectors. Vectors that share a leaf of any tree are compared
exactly, and counted in the first leaf they share, so no pair has to be kept to count it once.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import merge_labels
from freshet.llm.components import components
from freshet.storage import stage

TREES = 6
LEAF = 512  # Vectors a leaf should hold.
BLOCK = 2048  # A leaf over this size is cut, and compared part against part in several tasks.
WAYS = 8  # Directions that are tried at a split.
SAMPLE = 2048  # Vectors of a leaf that its splits of one round are fitted on, about.
LEAST = 32  # Sampled vectors a node must have to be split.
REACH = 0.5  # Vectors as near a split as this many times the spread of a link's projection go to both sides.
WIDEST = 0.8  # A split whose larger side keeps more than this share of its node is not made.
ROUNDS = 16  # Of fitting, each of which cuts large leaves to a sixtieth or so; more are never needed.
SEED = 7
FAMILIES = 512  # Sequences of directions; a leaf's name chooses its own.
_PAIRS = 200_000  # Found pairs whose shared leaves are looked up at a time.


@dataclass(frozen=True)
class Tree:
    """Splits by node number, the root 1, its sides 2n and 2n + 1: a threshold, and which of the
    level's directions it is on."""

    seed: int
    margin: float
    splits: dict


def _margin(threshold, size):
    """Half the width of a split's overlap: it follows from how far apart vectors at the
    ``threshold`` cosine lie."""
    return REACH * np.sqrt(max(0.0, 2 - 2 * threshold) / size)


@lru_cache(maxsize=8192)
def _directions(seed, level, size):
    """The directions, a column each, that a level of a tree chooses from."""
    axes = np.random.default_rng([SEED, seed, level]).standard_normal((size, WAYS))
    return axes / np.linalg.norm(axes, axis=0)


def _sides(tree, node, x):
    """Whether each vector goes to the lower and to the upper side of a split node."""
    threshold, way = tree.splits[node]
    at = x @ _directions(tree.seed, node.bit_length(), x.shape[1])[:, way]
    return at <= threshold + tree.margin, at >= threshold - tree.margin


def grow(x, seed, leaf, threshold, least=LEAST):
    """A tree whose leaves hold ``leaf`` of the sampled vectors ``x`` or too few to split.

    A group that lies closer together than the overlap of a split is not split.
    """
    tree = Tree(seed, _margin(threshold, x.shape[1]), {})
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= max(leaf, least):
            continue
        at = x[rows] @ _directions(seed, node.bit_length(), x.shape[1])
        middle = np.median(at, axis=0).astype(np.float32).astype(float)
        way = int((np.abs(at - middle) <= tree.margin).sum(axis=0).argmin())
        tree.splits[node] = float(middle[way]), way
        low, high = _sides(tree, node, x[rows])
        if max(low.sum(), high.sum()) > WIDEST * len(rows):
            del tree.splits[node]  # Too many lie near the split: parts of the leaf do better.
            continue
        todo += [(2 * node, rows[low]), (2 * node + 1, rows[high])]
    return tree


def leaves(tree, x):
    """(row, leaf) of each vector's leaves; a vector can have several."""
    rows, nodes = [], []
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, some = todo.pop()
        if not len(some):
            continue
        if node not in tree.splits:
            rows.append(some)
            nodes.append(np.full(len(some), node))
            continue
        low, high = _sides(tree, node, x[some])
        todo += [(2 * node, some[low]), (2 * node + 1, some[high])]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(nodes)


def _unit(column):
    """Rows of a list column as unit vectors in double precision."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = x.reshape(len(values), -1) if len(values) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # keeps the squares finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(x):
    """Whether a vector is not null, and holds only finite components and one that is not zero."""
    finite = F.forall(x, lambda a: F.coalesce(~F.isnan(a) & (F.abs(a) < float("inf")), F.lit(False)))
    return finite & F.exists(x, lambda a: a != 0)


def _components(rows, vector):
    """The vector column, -0.0 as 0.0, in its own precision if that is float and in double otherwise."""
    kind = rows.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    return F.transform(F.col(vector).cast("array<double>"), lambda a: a + F.lit(0.0)).cast(kind)


def distinct_vectors(rows: DataFrame, id="vec_id", vector="embedding", label="label"):
    """One row per distinct usable vector of a label: class, bucket (label and size), x, copies,
    least (its least id). Rows with a null id or label are left out."""
    return (
        rows.select(F.col(id).alias("vec_id"), F.col(label).cast("string").alias("label"), _components(rows, vector).alias("x"))
        .where(_usable(F.col("x")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
        .groupBy(F.xxhash64("label", "x").alias("class"), "label", "x")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .select("class", F.xxhash64("label", F.size("x")).alias("bucket"), "x", "copies", "least")
    )


def plant(vectors: DataFrame, threshold, trees=TREES, leaf=LEAF, sample=SAMPLE, rounds=ROUNDS) -> DataFrame:
    """``vectors`` (class, bucket, x, copies) with an array of their leaves in all trees: leaves.

    Each round splits the leaves over twice ``leaf``, each by a bounded sample of its own vectors
    in a task of its own, and sends every vector down; a leaf whose sample was too thin to cut it
    small enough is split further in the next. The splits are a table, joined to the vectors by
    leaf, so neither their number nor the driver limits how many leaves there can be. Vectors of
    equal bucket must have equal size.
    """
    roots = F.array(*(F.xxhash64("bucket", F.lit(t)) for t in range(trees)))
    out = vectors.select("class", "x", "copies", roots.alias("leaves"))
    for turn in range(rounds):
        in_leaves = out.select("class", F.explode("leaves").alias("leaf"), "x")
        sizes = stage(
            in_leaves.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf), "leaf-sizes"
        )
        if sizes.isEmpty():
            break
        draw = F.pmod(F.xxhash64("class", "leaf", F.lit(turn)), F.lit(1 << 40))
        drawn = in_leaves.join(sizes, "leaf").where(draw * F.col("n") < F.lit(float(sample * (1 << 40))))
        splits = stage(_fitted(drawn, threshold, leaf), "splits")
        if splits.isEmpty():
            break
        stay = in_leaves.join(splits, "leaf", "left_anti").select("class", "leaf")
        moved = _descend(in_leaves.join(splits, "leaf").sortWithinPartitions("leaf"), threshold)
        named = stay.union(moved).groupBy("class").agg(F.collect_set("leaf").alias("leaves"))
        out = stage(out.drop("leaves").join(named, "class"), "leaves")
    return out


def _fitted(drawn, threshold, leaf):
    """leaf, nodes, cuts, ways: the splits of each leaf that can be split, from its sample (leaf, n, x)."""

    def fit(table: pa.Table) -> pa.Table:
        name, n = table.column("leaf")[0].as_py(), table.column("n")[0].as_py()
        x = _unit(table.column("x"))
        grown = grow(x, name % FAMILIES, max(1, leaf * len(x) // n), threshold).splits
        cuts, ways = zip(*grown.values()) if grown else ((), ())
        rows = [{"leaf": name, "nodes": list(grown), "cuts": cuts, "ways": ways}] if grown else []
        return pa.Table.from_pylist(rows, schema=kinds)

    lists = {"nodes": pa.int32(), "cuts": pa.float32(), "ways": pa.int32()}
    kinds = pa.schema([("leaf", pa.int64()), *((c, pa.list_(k)) for c, k in lists.items())])
    return drawn.groupBy("leaf").applyInArrow(fit, "leaf long, nodes array<int>, cuts array<float>, ways array<int>")


def _descend(rows, threshold):
    """(class, leaf): each vector's new leaves below its leaf, from rows (class, leaf, x, nodes, cuts, ways)."""

    def walk(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            owners, names = (columns[c].to_numpy() for c in ("class", "leaf"))
            order = np.argsort(names, kind="stable")
            at, to = [], []
            for some in np.split(order, np.flatnonzero(np.diff(names[order])) + 1):
                if not len(some):
                    continue
                first = int(some[0])
                x = _unit(columns["x"].take(pa.array(some)))
                nodes, cuts, ways = (columns[c][first].as_py() for c in ("nodes", "cuts", "ways"))
                tree = Tree(int(names[first]) % FAMILIES, _margin(threshold, x.shape[1]), dict(zip(nodes, zip(cuts, ways))))
                rows, nodes = leaves(tree, x)
                at.append(owners[some][rows])
                # A leaf's name: its group's, mixed with the node's number.
                mixed = names[some[:1]].view(np.uint64) ^ (nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                to.append((mixed ^ (mixed >> np.uint64(29))).view(np.int64))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(at), pa.int64()), pa.array(np.concatenate(to), pa.int64())],
                    ["class", "leaf"],
                )

    return rows.mapInArrow(walk, "class long, leaf long")


def _shared_before(mine, other, own, lists):
    """Whether each pair (mine[k], other[k]) shares a leaf that comes before ``own``."""
    out = np.zeros(len(mine), bool)
    for k in range(0, len(mine), _PAIRS):
        a, b = lists[mine[k : k + _PAIRS]], lists[other[k : k + _PAIRS]]
        met = np.zeros(len(a), bool)
        for j in range(b.shape[1]):
            column = b[:, j : j + 1]
            met |= ((a == column) & (a < own)).any(axis=1)
        out[k : k + _PAIRS] = met
    return out


def _padded(column):
    """Lists of leaf names as a matrix; what is missing is larger than any and so before none."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), sizes.max(initial=0)), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def link_vectors(vectors: DataFrame, threshold=0.93, trees=TREES, leaf=LEAF, block=BLOCK):
    """(class, linked, root) rows for the distinct ``vectors`` (class, bucket, x, copies).

    linked is a part of the number of vectors, copies included, that the class is linked to, to
    be summed; (class, root) are links enough for the components, not all pairs. A leaf over
    ``block`` vectors is dealt to parts, and each pair of parts compared in a task of its own.
    """
    planted = plant(vectors, threshold, trees, leaf)
    in_leaves = planted.withColumn("leaf", F.explode("leaves"))
    sizes = in_leaves.groupBy("leaf").count().where(F.col("count") > block)
    parts = F.ceil(F.coalesce("count", F.lit(1)) / block).cast("int")
    dealt = (
        in_leaves.join(sizes, "leaf", "left")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("class", F.lit(3)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "leaf",
            F.least("part", "other").alias("i"),
            F.greatest("part", "other").alias("j"),
            "part",
            "class",
            "copies",
            "x",
            "leaves",
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        own = table.column("leaf")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = _unit(table.column("x"))
        names = table.column("class").to_numpy()
        copies = table.column("copies").to_numpy()
        lists = _padded(table.column("leaves"))
        part = table.column("part").to_numpy()
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        linked = np.zeros(len(names), np.int64)
        label = np.arange(len(names))
        for k in range(0, len(left), 512):
            some = left[k : k + 512]
            a, b = np.nonzero(x[some] @ x[right].T >= threshold)
            a, b = some[a], right[b]
            if i == j:
                a, b = a[b > a], b[b > a]
            merge_labels(label, a, b)
            first = ~_shared_before(a, b, own, lists)
            a, b = a[first], b[first]
            np.add.at(linked, a, copies[b])
            np.add.at(linked, b, copies[a])
        seen = np.flatnonzero((linked > 0) | (label != np.arange(len(names))))
        return pa.table(
            {
                "class": pa.array(names[seen], pa.int64()),
                "linked": pa.array(linked[seen], pa.int64()),
                "root": pa.array(names[label[seen]], pa.int64()),
            }
        )

    return dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "class long, linked long, root long")


def near_vectors(rows: DataFrame, id="vec_id", vector="embedding", label="label", threshold=0.93, trees=TREES):
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal size are linked where their cosine, in double
    precision, is at least ``threshold``; none below is, and pairs that share no leaf of the
    forest are missed. n_links counts the other rows linked directly, component_id is the least
    id reachable, kept says whether it is the row's own. Vectors that are null, empty, zero, or
    hold a null or non-finite component link with nothing, as do rows with a null id or label.
    Rows that repeat a vector are linked copies. An empty table gives an empty one; other columns
    are ignored, whatever their names.
    """
    classes = stage(distinct_vectors(rows, id, vector, label), "vector-classes")
    found = stage(
        link_vectors(classes.select("class", "bucket", "x", "copies"), threshold, trees), "leaf-links"
    )
    counts = found.groupBy("class").agg(F.sum("linked").alias("linked"))
    joined = components(found, "class", "root").withColumnRenamed("node", "class")
    rooted = stage(
        classes.select("class", "copies", "least")
        .join(counts, "class", "left")
        .join(joined, "class", "left")
        .select(
            "class",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            "least",
            F.coalesce("component", "class").alias("root"),
        ),
        "vector-roots",
    )
    named = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "vector-names")
    named = rooted.select("class", "n_links", "root").join(named, "root").drop("root")
    x = _components(rows, vector)
    usable = _usable(x) & F.col(label).isNotNull() & F.col(id).isNotNull()
    key = F.when(usable, F.xxhash64(F.col(label).cast("string"), x)).alias("class")
    mine = rows.select(F.col(id).alias("vec_id"), key)
    least = F.coalesce("component_id", "vec_id")
    return mine.join(named, "class", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        least.alias("component_id"),
        F.coalesce(F.col("vec_id") == least, F.lit(False)).alias("kept"),
    )
