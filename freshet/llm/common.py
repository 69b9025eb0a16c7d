"""Helpers that several operators of this folder use."""

from itertools import chain

import numpy as np
import pyarrow.compute as pc

TEXT_BYTES = 2_000_000  # Python-side working set: texts are handled in slices of about this size.


def free_name(df, base):
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts, limit=TEXT_BYTES):
    """(start, end) ranges of ``texts`` that hold about ``limit`` characters, one text at least."""
    start = held = 0
    for k, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > limit:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def text_slices(column, limit=TEXT_BYTES):
    """(start, texts) of an Arrow string column, in lists of about ``limit`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    edges = (np.flatnonzero(np.diff(ends // limit)) + 1).tolist() if len(column) else []
    for a, b in zip([0, *edges], [*edges, len(column)]):
        if b > a:
            yield a, column.slice(a, b - a).to_pylist()


class Codes(dict):
    """Numbers strings in the order they come; ``fresh`` lists those not seen before."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, key):
        code = self[key] = len(self)
        self.fresh.append(key)
        return code


class Ragged:
    """Growing list of integer arrays, kept flat."""

    def __init__(self, dtype):
        self.flat = np.zeros(1024, dtype)
        self.ends = np.zeros(1, np.int64)

    def extend(self, rows):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        used = self.ends[-1]
        need = used + sizes.sum()
        if need > len(self.flat):
            grown = np.zeros(max(need, 2 * len(self.flat)), self.flat.dtype)
            grown[:used] = self.flat[:used]
            self.flat = grown
        if need > used:
            self.flat[used:need] = np.fromiter(chain.from_iterable(rows), self.flat.dtype, need - used)
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])

    def sizes(self, at):
        return self.ends[at + 1] - self.ends[at]

    def gather(self, at):
        """The arrays numbered ``at``, one after another."""
        sizes = self.sizes(at)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.zeros(0, self.flat.dtype)
        step = np.repeat(self.ends[at] - (ends - sizes), sizes)
        return self.flat[np.arange(total) + step]


def merge_labels(label, a, b):
    """Join the classes of ``a[k]`` and ``b[k]`` for all k; a class is named by its least index.

    ``label`` points to smaller or equal indices; it is changed in place and flat on return.
    """
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label[:] = flat
