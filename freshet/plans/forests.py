"""Several forests grown together, level by level, over the same rows.

The forests are Spark's: bins from a sample of 10,000 rows, Poisson samples of all rows for each
tree, a random subset of inputs for each node, Gini gains, sibling leaves of one prediction joined.
What differs is the work per row, tree and level. Inputs are turned into bin numbers once, a byte
each, and stored in blocks; every level is one job for the trees of all forests, whose tasks add up
a block's counts with array operations, tree by tree, so that a tree's counts stay in the
processor's cache. Counts are shuffled by tree, and tasks find the best splits. The driver holds
the trees alone.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import add_month_cycle, is_complete
from freshet.operators.stats import class_weights
from freshet.plans.encoding import encode_category
from freshet.plans.training import FeatureSpec, ForestModel, build_pipeline, fit, from_votes
from freshet.sources.forests import forest_model
from freshet.storage import stage

BLOCK_ROWS = 65_536
# Rows of a task at most; fewer where cores would be idle.
TASK_ROWS = 4_000_000
# Bytes of counts that a task holds at a time: trees beyond it are counted in another pass.
COUNT_BYTES = 128 * 1024 * 1024
# Splits are taken from so many rows, or the square of the bins if that is more.
SPLIT_ROWS = 10_000
# A cell holds its rows, and its rows of class 1 times this: both are exact up to CELL_ROWS rows.
ONE = float(2**27)
CELL_ROWS = 2**22

_CUMULATIVE = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 16.0)])))
_UNSURE = 255


def _draw_table():
    """Poisson draws by the first 16 bits of a uniform number; unsure where these do not decide."""
    low, high = (np.searchsorted(_CUMULATIVE, np.arange(k, k + 65536) / 65536, "right") for k in (0, 1))
    return np.where(low == high, low, _UNSURE).astype(np.uint8)


_DRAWS = _draw_table()


def _bag(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    """How often each row of a block is in a tree's sample: independent Poisson draws of mean 1."""
    random = np.random.Generator(np.random.SFC64([seed % 2**64, tree, block]))
    first = np.frombuffer(random.bytes(2 * rows), np.uint16)
    drawn = _DRAWS.take(first)
    unsure = np.flatnonzero(drawn == _UNSURE)
    exact = (first[unsure] + random.random(len(unsure))) / 65536
    drawn[unsure] = np.minimum(np.searchsorted(_CUMULATIVE, exact, "right"), 15)
    return drawn


@dataclass
class _Plan:
    """What one forest is grown from: where its inputs are among the blocks' columns, and more."""

    spec: FeatureSpec
    inputs: list  # names, as the assembler takes them
    columns: np.ndarray  # each input's column in the blocks
    cuts: list  # each input's number of places to cut at
    splits: list  # thresholds of each input, None for a category
    weights: tuple
    encoding: object
    bagged: bool
    mark: int = None  # bit of the marks that its rows have, None where all rows are its own

    @property
    def drawn(self):
        """How many inputs are tried in each node, as Spark does by default."""
        n = len(self.inputs)
        return n if self.spec.trees == 1 else int(np.ceil(np.sqrt(n)))


@dataclass
class _Tree:
    """A tree so far. Nodes are numbered as they were made, so children follow their parents."""

    input: list = field(default_factory=lambda: [np.array([-1])])
    left: list = field(default_factory=lambda: [np.array([-1])])
    goes_left: list = field(default_factory=list)
    counts: list = field(default_factory=lambda: [np.zeros((1, 2), np.int64)])
    gain: list = field(default_factory=lambda: [np.array([-1.0])])
    levels: list = field(default_factory=lambda: [1])
    open: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def all(self, name):
        return np.concatenate(getattr(self, name))


def fit_together(train: DataFrame, specs: dict) -> dict:
    """A ``ForestModel`` for each of ``specs``, all trained on ``train``: name to model.

    ``specs`` share label and time column. Each forest is trained on the rows complete in its own
    inputs, with weights, splits and numbers of the category from these rows alone, as ``fit``
    does. Forests of one seed draw the same samples of rows. ``train`` is read once, into a
    stored table. Labels other than 0 and 1 are left to ``fit``.
    """
    if len({(s.label, s.ts) for s in specs.values()}) > 1:
        raise ValueError("forests grown together have one label and one time column")
    rows = _inputs(train, list(specs.values()))
    rows = stage(rows, "training")
    some = next(iter(specs.values()))
    categories = sorted({s.category for s in specs.values() if s.use_category})
    groups = stage(rows.groupBy(some.label, "marks_", *categories).agg(F.count("*").alias("n")), "class-counts")
    found = groups.groupBy(some.label, "marks_").agg(F.sum("n").alias("n")).collect()
    of = [_counts(found, k) for k in range(len(specs))]
    if any(set(counts) != {0, 1} for counts in of):
        return {name: fit(train, spec) for name, spec in specs.items()}
    marks = {r["marks_"] for r in found}
    plans, rows, columns = _plans(rows, groups, list(specs.values()), of, marks)
    plans = dict(zip(specs, plans))
    blocks = stage(_blocks(rows, columns, some.label, max(s.max_bins for s in specs.values())), "blocks")
    dealt = _dealt(blocks).persist()
    try:
        trees = _grow(dealt, plans, len(columns))
    finally:
        dealt.unpersist()
    return {name: _model(train.sparkSession, plan, trees[name]) for name, plan in plans.items()}


def _inputs(train, specs):
    """Rows complete for at least one forest: their inputs, and a bit for each forest they are for."""
    if any(s.month_cycle for s in specs):
        train = add_month_cycle(train, specs[0].ts)
    complete = [is_complete(train, (*s.required, s.label)) for s in specs]
    marks = sum((F.when(c, F.lit(1 << k)).otherwise(0).cast("long") for k, c in enumerate(complete)), F.lit(0))
    numbers = dict.fromkeys(c for s in specs for c in (*s.numeric, *s.cycle))
    categories = dict.fromkeys(s.category for s in specs if s.use_category)
    return train.select(
        *(F.col(c).cast("double").alias(c) for c in numbers),
        *(c for c in categories if c not in numbers),
        specs[0].label,
        marks.alias("marks_"),
    ).filter("marks_ > 0")


def _counts(found, k):
    counts = {}
    for r in found:
        if r["marks_"] >> k & 1:
            counts[r[0]] = counts.get(r[0], 0) + r["n"]
    return counts


def _plans(rows, groups, specs, counts, marks):
    """Forests' plans, the rows with their categories' numbers, and what the blocks' columns are.

    A column is (name in rows, thresholds or None). Forests of the same rows share them.
    """
    columns, place, encodings, thresholds, plans = [], {}, {}, {}, []

    def column(key, name, splits):
        if key not in place:
            place[key] = len(columns)
            columns.append((name, splits))
        return place[key]

    balanced = {}
    for k, spec in enumerate(specs):
        own = tuple(sorted(m for m in marks if m >> k & 1))
        mine = F.col("marks_").isin(*own)
        weights = (1.0, 1.0)
        if spec.weighted:
            if own not in balanced:
                made = class_weights(groups.filter(mine), spec.label, "n").collect()
                balanced[own] = tuple(r["class_weight"] for r in sorted(made, key=lambda r: r[0]))
            weights = balanced[own]
        sampled = (own, weights, spec.max_bins, spec.seed)
        numbers = [*spec.numeric, *spec.cycle]
        if not set(numbers) <= set(thresholds.get(sampled, {})):
            n = sum(counts[k].values())
            share = min(1.0, max(spec.max_bins**2, SPLIT_ROWS) / n)
            sample = rows.filter(mine).select(*numbers, spec.label)
            sample = (sample.sample(share, spec.seed) if share < 1 else sample).toPandas()
            weight = np.where(sample[spec.label] == 1, weights[1], weights[0])
            for c in numbers:
                cuts = _thresholds(sample[c].to_numpy(), weight, min(spec.max_bins, n) - 1)
                thresholds.setdefault(sampled, {}).setdefault(c, cuts)
        encoding, digits = None, []
        if spec.use_category:
            known = (own, spec.category, spec.max_bins, spec.digits)
            if known not in encodings:
                encoding = encode_category(groups.filter(mine), spec.category, spec.max_bins, spec.digits, "n")
                names = {c: f"{c}_{len(encodings)}" for c in (encoding.index, *encoding.digit_columns)}
                rows = encoding.add(rows).withColumnsRenamed(names)
                encodings[known] = (encoding, names)
            encoding, names = encodings[known]
            digits = encoding.digit_columns
        inputs, at, splits = [*spec.inputs, *digits], [], []
        for c in inputs:
            if encoding and c in names:
                at.append(column((known, c), names[c], None))
                splits.append(None)
            else:
                splits.append(thresholds[sampled][c])
                at.append(column((sampled, c), c, splits[-1]))
        cuts = [spec.max_bins - 1 if s is None else len(s) for s in splits]
        mark = None if set(own) == marks else k
        bagged = build_pipeline(spec).getStages()[-1].getBootstrap()
        plans.append(_Plan(spec, inputs, np.array(at), cuts, splits, weights, encoding, bagged, mark))
    return plans, rows, columns


def _thresholds(values, weight, most):
    """Midpoints of a sample's values that cut it into parts of about one weight, as Spark finds them."""
    distinct, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weight)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middle) <= most:
        return middle
    before = np.cumsum(weights)
    stride = before[-1] / (most + 1)
    target, chosen = stride, []
    for k in range(len(middle)):
        if abs(before[k] - target) < abs(before[k + 1] - target):
            chosen.append(middle[k])
            target += stride
    return np.array(chosen[:most])


def _blocks(rows, columns, label, bins):
    """Rows as blocks: for each input the number of its bin, row by row, and classes and marks."""
    names = list(dict.fromkeys(name for name, _ in columns))
    kind = _kind(bins)

    def run(batches):
        from pyspark import TaskContext

        part, held, n, made = TaskContext.get().partitionId(), [], 0, 0

        def block():
            table = pa.Table.from_batches(held)
            codes = np.empty((table.num_rows, len(columns)), kind)
            for k, (name, splits) in enumerate(columns):
                values = table.column(name).to_numpy()
                codes[:, k] = values if splits is None else np.searchsorted(splits, values)
            one = table.column(label).to_numpy() == 1
            marks = table.column("marks_").to_numpy()
            cells = [part * 2**32 + made], [table.num_rows], [codes.tobytes()], [one.tobytes()], [marks.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _BLOCK.types)], schema=_BLOCK)

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, BLOCK_ROWS - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == BLOCK_ROWS:
                    yield block()
                    held, n, made = [], 0, made + 1
        if n:
            yield block()

    schema = "block long, n long, codes binary, ones binary, marks binary"
    return rows.select(*names, label, "marks_").mapInArrow(run, schema)


_BLOCK = pa.schema(
    [("block", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()), ("ones", pa.binary()), ("marks", pa.binary())]
)


def _dealt(blocks):
    """Blocks dealt so that all tasks have about the same rows."""
    spark = blocks.sparkSession
    sizes = sorted(blocks.select("n", "block").collect(), reverse=True)
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r["n"] for r in sizes) // TASK_ROWS))
    loads = [(0, task) for task in range(min(tasks, len(sizes)))]
    owner = []
    for n, block in sizes:
        load, task = heapq.heappop(loads)
        heapq.heappush(loads, (load + n, task))
        owner.append((block, task))
    owners = F.broadcast(spark.createDataFrame(owner, "block long, task int"))
    return blocks.join(owners, "block").repartitionById(len(loads), "task").select(*_BLOCK.names)


def _kind(bins):
    return np.uint8 if bins <= 2**8 else np.uint16 if bins <= 2**16 else np.uint32


def _grow(blocks, plans, width):
    """All trees of all plans: a pass over the blocks for each level, more where counts are many."""
    grown = {name: [_Tree() for _ in range(plan.spec.trees)] for name, plan in plans.items()}
    trees = {(t, name): tree for name, some in grown.items() for t, tree in enumerate(some)}
    kind = _kind(max(p.spec.max_bins for p in plans.values()))
    for level in range(max(p.spec.depth for p in plans.values())):
        chunk, held = [], 0
        # By number first, as trees of one number and seed have the same sample of rows.
        for key in sorted(trees, key=lambda k: k[0]):
            plan, tree = plans[key[1]], trees[key]
            if level < plan.spec.depth and len(tree.open):
                need = len(tree.open) * plan.drawn * plan.spec.max_bins * 8
                if chunk and held + need > COUNT_BYTES:
                    _level(blocks, plans, trees, chunk, level, width, kind)
                    chunk, held = [], 0
                chunk.append(key)
                held += need
        if chunk:
            _level(blocks, plans, trees, chunk, level, width, kind)
    return grown


@dataclass
class _Open:
    """What tasks are told of a tree: how its rows reach the open nodes, and what is tried there."""

    number: int
    plan: _Plan
    at: np.ndarray  # column that each node looks at
    next: np.ndarray  # node that each bin of it leads to
    place: np.ndarray  # each node's place among the open ones, or -1
    steps: int
    tried: np.ndarray  # for each try and open node, an input of the plan


def _opened(number, plan, tree, level):
    at, left = tree.all("input"), tree.all("left")
    next = _leads_to(tree, left >= 0, plan.spec.max_bins)
    place = np.full(len(at), -1, np.int32)
    place[tree.open] = np.arange(len(tree.open))
    n, inputs = len(tree.open), len(plan.inputs)
    if plan.drawn < inputs:
        random = np.random.default_rng([plan.spec.seed % 2**64, number, level])
        tried = np.argsort(random.random((n, inputs)), axis=1)[:, : plan.drawn].T
    else:
        tried = np.repeat(np.arange(inputs)[:, None], n, axis=1)
    return _Open(number, plan, plan.columns[np.maximum(at, 0)], next, place, level, np.ascontiguousarray(tried))


def _leads_to(tree, inner, bins):
    """The node that each bin of each node's input leads to; leaves lead to themselves."""
    left = tree.all("left")
    next = np.repeat(np.arange(len(left), dtype=np.int32)[:, None], bins, axis=1)
    if inner.any():
        next[inner] = (left[:, None] + 1 - _goes_left(tree, bins))[inner]
    return next.ravel()


def _goes_left(tree, bins):
    found = np.zeros((sum(tree.levels), bins), bool)
    if tree.goes_left:
        found[tree.all("left") >= 0] = np.concatenate(tree.goes_left)
    return found


def _level(blocks, plans, trees, chunk, level, width, kind):
    """Count the rows of the open nodes of ``chunk`` and split these nodes, or leave them as leaves."""
    opened = [_opened(t, plans[name], trees[t, name], level) for t, name in chunk]
    told = [(o.number, o.plan.spec, o.plan.columns, o.plan.bagged, o.plan.mark, o.at, o.next, o.place, o.steps, o.tried) for o in opened]
    counts = blocks.mapInArrow(_counter(told, width, kind), "tree int, counts binary")
    asked = [(o.plan.spec.max_bins, o.plan.weights, o.plan.cuts, [s is None for s in o.plan.splits], o.tried) for o in opened]
    best = counts.groupBy("tree").applyInArrow(_chooser(asked), _BEST).toArrow().to_pandas()
    for k, found in best.groupby("tree"):
        _split(trees[chunk[k]], opened[k], found.sort_values("place"), level)


def _counter(told, width, kind):
    """Tasks' counts of rows by open node, input tried, bin and class, for each tree."""

    def run(batches):
        held, seen = {}, 0
        for batch in batches:
            for block, n, codes, ones, marks in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if seen + n > CELL_ROWS:
                    yield from _sent(held)
                    held, seen = {}, 0
                seen += n
                codes = np.frombuffer(codes, kind)
                factor = 1.0 + ONE * np.frombuffer(ones, bool)
                marks = np.frombuffer(marks, np.int64)
                drawn, sample = None, None
                for k, (number, spec, columns, bagged, mark, at, next, place, steps, tried) in enumerate(told):
                    if drawn != (number, spec.seed, bagged):
                        drawn = (number, spec.seed, bagged)
                        sample = _sample(drawn, block, n, factor, width)
                    rows, start, weight = sample
                    if mark is not None:
                        own = np.flatnonzero(marks.take(rows) >> mark & 1)
                        start, weight = start.take(own), weight.take(own)
                    made = _tree_counts(codes, start, weight, spec.max_bins, columns, at, next, place, steps, tried)
                    if k in held:
                        held[k] += made
                    else:
                        held[k] = made
        yield from _sent(held)

    return run


def _sample(drawn, block, n, factor, width):
    """Rows of a block that are in a tree's sample, where their codes start, and their counts."""
    number, seed, bagged = drawn
    bag = _bag(seed, number, block, n) if bagged else np.ones(n, np.uint8)
    rows = np.flatnonzero(bag != 0)
    weight = bag.take(rows).astype(np.float64)
    weight *= factor.take(rows)
    return rows, rows * width, weight


def _tree_counts(codes, start, weight, bins, columns, at, next, place, steps, tried):
    if steps:
        node, next = np.zeros(len(start), np.int64), next.astype(np.int64)
        for _ in range(steps):
            look = at.take(node)
            look += start
            node *= bins
            node += codes.take(look)
            node = next.take(node)
        node = place.take(node)
        ended = np.count_nonzero(node < 0)
        if ended:
            going = np.flatnonzero(node >= 0)
            node, start, weight = node.take(going), start.take(going), weight.take(going)
    else:
        node = np.zeros(len(start), np.int64)
    made = np.empty((len(tried), tried.shape[1] * bins))
    row = node.astype(np.int64) * bins
    for k, inputs in enumerate(tried):
        look = columns.take(inputs).take(node)
        look += start
        made[k] = np.bincount(row + codes.take(look), weight, tried.shape[1] * bins)
    return made


def _sent(held):
    for k, counts in held.items():
        yield pa.RecordBatch.from_pydict({"tree": pa.array([k], pa.int32()), "counts": [counts.tobytes()]})


_BEST = (
    "tree int, place int, zeros long, ones long, left_zeros long, left_ones long, input int, gain double, goes_left binary"
)


def _chooser(asked):
    """The best split of each open node of a tree, from the tasks' counts."""

    def run(key, table):
        k = key[0].as_py()
        bins, weights, cuts, category, tried = asked[k]
        n = tried.shape[1]
        counts = np.zeros((2, len(tried), n, bins), np.int64)
        for cell in table.column("counts"):
            packed = np.frombuffer(cell.as_buffer(), np.float64).reshape(len(tried), n, bins)
            ones = np.floor(packed / ONE)
            counts[0] += (packed - ones * ONE - ones).astype(np.int64)
            counts[1] += ones.astype(np.int64)
        zeros, ones = counts.transpose(0, 2, 1, 3)  # node, try, bin
        tried = tried.T
        # A category's bins in order of their weight of class 1, those without rows last.
        is_category = np.array(category)[tried]
        rank = np.where(zeros + ones > 0, ones * weights[1], np.inf)
        order = np.argsort(rank, axis=2, kind="stable")
        order = np.where(is_category[:, :, None], order, np.arange(bins))
        left0, left1 = (np.cumsum(np.take_along_axis(c, order, 2), axis=2) for c in (zeros, ones))
        all0, all1 = left0[:, :1, -1:], left1[:, :1, -1:]
        gain = _gains(left0, left1, all0, all1, weights)
        gain[np.arange(bins) >= np.array(cuts)[tried][:, :, None]] = -np.inf
        best = gain.reshape(n, -1).argmax(axis=1)
        tries, cut = best // bins, best % bins
        node = np.arange(n)
        goes_left = np.zeros((n, bins), bool)
        np.put_along_axis(goes_left, order[node, tries], np.arange(bins) <= cut[:, None], 1)
        return pa.table(
            {
                "tree": pa.array(np.full(n, k), pa.int32()),
                "place": pa.array(node, pa.int32()),
                "zeros": all0[:, 0, 0],
                "ones": all1[:, 0, 0],
                "left_zeros": left0[node, tries, cut],
                "left_ones": left1[node, tries, cut],
                "input": pa.array(tried[node, tries], pa.int32()),
                "gain": gain[node, tries, cut],
                "goes_left": [row.tobytes() for row in goes_left],
            }
        )

    return run


def impurity(zeros, ones):
    """Gini impurity of weighted counts, added up in Spark's order."""
    total = zeros + ones
    some = np.where(total > 0, total, 1.0)
    return np.where(total > 0, 1.0 - (zeros / some) ** 2 - (ones / some) ** 2, 0.0)


def _gains(left0, left1, all0, all1, weights):
    right0, right1 = all0 - left0, all1 - left1
    whole = all0 * weights[0] + all1 * weights[1]
    some = np.where(whole > 0, whole, 1.0)
    sides = []
    for zeros, ones in ((left0, left1), (right0, right1)):
        zeros, ones = zeros * weights[0], ones * weights[1]
        sides.append((zeros + ones) / some * impurity(zeros, ones))
    gain = impurity(all0 * weights[0], all1 * weights[1]) - sides[0] - sides[1]
    return np.where((left0 + left1 > 0) & (right0 + right1 > 0), gain, -np.inf)


def _split(tree, opened, found, level):
    """Add the chosen splits' children; those with one class, and the last level's, are leaves."""
    plan, bins = opened.plan, opened.plan.spec.max_bins
    if level == 0:
        tree.counts[0] = found[["zeros", "ones"]].to_numpy()
    inner = found[found["gain"] > 0]
    at, made = tree.open[inner["place"]], sum(tree.levels)
    left = made + 2 * np.arange(len(inner))
    # Nodes of one level are the last ones made.
    first = made - tree.levels[-1]
    tree.input[-1][at - first] = inner["input"]
    tree.left[-1][at - first] = left
    tree.gain[-1][at - first] = inner["gain"]
    if len(inner):
        tree.goes_left.append(np.frombuffer(b"".join(inner["goes_left"]), bool).reshape(-1, bins))
    ours = inner[["left_zeros", "left_ones"]].to_numpy()
    counts = np.stack([ours, inner[["zeros", "ones"]].to_numpy() - ours], axis=1).reshape(-1, 2)
    tree.counts.append(counts)
    tree.levels.append(len(counts))
    for name, kind in (("input", np.int64), ("left", np.int64), ("gain", np.float64)):
        getattr(tree, name).append(np.full(len(counts), -1, kind))
    mixed = (counts > 0).all(axis=1) & (level + 1 < plan.spec.depth)
    tree.open = made + np.flatnonzero(mixed)


@dataclass(frozen=True)
class GrownModel(ForestModel):
    """A forest with its trees as tables too: rows are scored tree by tree, a batch at a time.

    Scores are those of the pipeline. Saved and loaded it is the pipeline alone.
    """

    votes: object = None

    def transform(self, df: DataFrame) -> DataFrame:
        assembler = self.pipeline.stages[0]
        found = assembler.transform(self.encoding.add(df) if self.encoding else df)
        inputs = [F.col(c).cast("double") for c in assembler.getInputCols()]
        return from_votes(found, found.columns, F.arrow_udf(self.votes, "array<double>")(*inputs))


def _votes(plan, tables):
    """A function of batches of a forest's inputs: each row's votes, a share a tree and class."""
    splits, bins, depth = plan.splits, plan.spec.max_bins, plan.spec.depth

    def votes(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        trees = [(at, next.astype(np.int64), *shares.T) for at, next, shares in tables]
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch]
            n, width = len(values[0]), len(values)
            codes = np.empty((n, width), _kind(bins))
            for k, (value, cuts) in enumerate(zip(values, splits)):
                codes[:, k] = value if cuts is None else np.searchsorted(cuts, value)
            codes, start, found = codes.ravel(), np.arange(n) * width, np.zeros((n, 2))
            for at, next, zero, one in trees:
                node = np.zeros(n, np.int64)
                for _ in range(depth):
                    look = at.take(node)
                    look += start
                    node *= bins
                    node += codes.take(look)
                    node = next.take(node)
                found[:, 0] += zero.take(node)
                found[:, 1] += one.take(node)
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2), pa.array(found.ravel()))

    return votes


def _model(spark, plan, trees):
    digits = plan.encoding.digit_columns if plan.encoding else []
    assembler, forest = build_pipeline(plan.spec, digits).getStages()
    joined = [_joined(plan, tree) for tree in trees]
    nodes = [_nodes(plan, tree, inner) for tree, inner in zip(trees, joined)]
    made = forest_model(spark, forest, len(plan.inputs), nodes)
    tables = [_table(plan, tree, inner) for tree, inner in zip(trees, joined)]
    return GrownModel(PipelineModel([assembler, made]), plan.encoding, _votes(plan, tables))


def _weighted(plan, tree):
    return tree.all("counts") * np.array(plan.weights)


def _says(plan, tree):
    zeros, ones = _weighted(plan, tree).T
    return ones > zeros


def _joined(plan, tree):
    """Which nodes are no leaves once sibling leaves of one prediction are joined."""
    left, says = tree.all("left"), _says(plan, tree)
    inner = left >= 0
    for end, n in zip(np.cumsum(tree.levels)[::-1], tree.levels[::-1]):
        at = np.arange(end - n, end)
        at = at[inner[at]]
        ours, others = left[at], left[at] + 1
        inner[at] = inner[ours] | inner[others] | (says[ours] != says[others])
    return inner


def _table(plan, tree, inner):
    weighted = _weighted(plan, tree)
    total = weighted.sum(axis=1, keepdims=True)
    shares = np.divide(weighted, total, out=np.zeros_like(weighted), where=total > 0)
    return np.maximum(tree.all("input"), 0), _leads_to(tree, inner, plan.spec.max_bins), shares


def _nodes(plan, tree, inner):
    """The tree's nodes as Spark keeps them."""
    counts, weighted, says = tree.all("counts"), _weighted(plan, tree), _says(plan, tree)
    input, left, gain = tree.all("input"), tree.all("left"), tree.all("gain")
    goes_left = _goes_left(tree, plan.spec.max_bins)
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for end, n in zip(np.cumsum(tree.levels), tree.levels):
        at = np.arange(end - n, end)
        at = at[kept[at] & inner[at]]
        kept[left[at]] = kept[left[at] + 1] = True
    number = np.cumsum(kept) - 1
    return [
        {
            "id": int(number[i]),
            "prediction": float(says[i]),
            "impurity": float(impurity(*weighted[i])),
            "impurityStats": weighted[i].tolist(),
            "rawCount": int(counts[i].sum()),
            "gain": float(gain[i]) if inner[i] else -1.0,
            "leftChild": int(number[left[i]]) if inner[i] else -1,
            "rightChild": int(number[left[i] + 1]) if inner[i] else -1,
            "split": _condition(plan, input[i], goes_left[i]) if inner[i] else _NO_SPLIT,
        }
        for i in np.flatnonzero(kept)
    ]


_NO_SPLIT = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}


def _condition(plan, input, goes_left):
    splits = plan.splits[input]
    if splits is None:
        left, n = np.flatnonzero(goes_left).astype(float).tolist(), plan.spec.max_bins
    else:
        left, n = [float(splits[np.count_nonzero(goes_left) - 1])], -1
    return {"featureIndex": int(input), "leftCategoriesOrThreshold": left, "numCategories": n}
