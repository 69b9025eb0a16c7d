"""Best-fit packing of tokenised documents by length patterns.

The lengths' histogram, of at most ``capacity`` bars, is all that the plan needs: patterns of a
few lengths that fill a sequence, or nearly, are fitted to it by non-negative least squares (Krell
et al. 2021), their repeat counts rounded, and what is left packed best-fit, longest first. Each piece
then finds its place by its rank among the pieces of its length.
"""

import json
import os
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from freshet.llm.common import free_name, text_slices
from freshet.llm.segments import SegmentEncoder, byte_level_segments, is_word
from freshet.storage import stage

CAPACITY = 1024
END = 2  # Id put after each document.
ROUNDS = (150, 2000)  # Of the least-squares fit, at least and at most.
WORK = 40_000_000  # Patterns times rounds, about.
EMPTY = 0.001  # Cost of an empty sequence in the fit, in units of the mean count.
SHARES = (1.0, 0.9, 0.7, 0.4, 0.0)  # Of the fitted repeats that are tried; what is left is packed best-fit.
RANKED = 100_000  # Pieces of a length that one task ranks, about.
_SHIFT = 48  # A place's key is its length and, below this many bits, its rank.


def _byte_characters():
    """The character that stands for each byte in a byte-level vocabulary: itself where it is
    printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {byte: byte if byte in own else next(others) for byte in range(256)}


_BYTES = _byte_characters()


def _merger(said):
    """The BPE model alone, if the tokenizer merges white-space segments by themselves, else None."""
    before, model = said.get("pre_tokenizer") or {}, said["model"]
    apart = (
        said.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space", True)
        and before.get("use_regex", True)
        and model["type"] == "BPE"
        and not any(
            model.get(k)
            for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        and not any(
            t.get("lstrip") or t.get("rstrip") or t.get("normalized") or any(map(str.isspace, t["content"]))
            for t in said.get("added_tokens", [])
        )
    )
    if not apart:
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return models.BPE(vocab=model["vocab"], merges=merges)


@lru_cache(maxsize=2)
def _loaded(path, changed):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Tokenizer.from_file(path)
    return made, _merger(json.loads(made.to_str()))


def load_tokenizer(path):
    """The tokenizer, and its model alone where segments can be encoded by themselves.

    Kept by the worker process, so that only its first task reads the file.
    """
    return _loaded(path, os.stat(path).st_mtime_ns)


def text_encoder(path):
    """A function from a list of texts to their arrays of ids, without added special tokens."""
    made, merger = load_tokenizer(path)

    def encode(texts):
        return [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]

    if merger is None:
        return lambda texts: (np.array(ids, np.uint32) for ids in encode([t or "" for t in texts]))
    merge = merger.tokenize

    def segments(some):
        words = [is_word(s) for s in some]
        others = iter(encode([s for s, word in zip(some, words) if not word]))
        # A word is one piece for the model: it needs none of the steps before.
        return [
            [t.id for t in merge(s.encode().decode("latin-1").translate(_BYTES))] if word else next(others)
            for s, word in zip(some, words)
        ]

    return SegmentEncoder(byte_level_segments, segments)


def cuts(n, capacity):
    """(start, length) of the pieces of ``n`` tokens: all of ``capacity``, but maybe the first."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer, id="doc_id", text="text", capacity=CAPACITY, end=END, with_ids=False):
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for.

    A document is its text's ids and then ``end``; a null text counts as empty, so each document
    has a piece. Only documents over ``capacity`` are cut, the remainder first. Other columns are
    ignored, whatever their names.
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<int>" if with_ids else ""
    )

    def encode(batches):
        encoder = text_encoder(tokenizer)
        for batch, first, texts in ((b, *part) for b in batches for part in text_slices(b.column(1))):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, body in enumerate(encoder(texts), first):
                whole = np.append(body, np.uint32(end)).astype("<u4")
                for p, (a, size) in enumerate(cuts(len(whole), capacity)):
                    row.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(size)
                    crc.append(zlib.crc32(whole[a : a + size].tobytes()))
                    if with_ids:
                        ids.append(whole[a : a + size].astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema)


def few_patterns(lengths, capacity):
    """Multisets of up to three of the rising ``lengths`` that fill ``capacity`` exactly or nearly:
    every pair with the longest third that is no longer than either and still fits. Rows of indices,
    longest first, -1 none."""
    lengths = np.asarray(lengths)
    longest = np.full(capacity + 1, -1)
    longest[lengths] = np.arange(len(lengths))
    longest = np.maximum.accumulate(longest)  # the longest of at most so many tokens
    a, b = np.meshgrid(np.arange(len(lengths)), np.arange(len(lengths)), indexing="ij")
    fits = (a >= b) & (lengths[a] + lengths[b] <= capacity)
    a, b = a[fits], b[fits]
    third = np.minimum(longest[capacity - lengths[a] - lengths[b]], b)
    alone = np.flatnonzero(longest[capacity - lengths] < 0)
    none = np.full(len(alone), -1)
    return np.concatenate([np.column_stack([a, b, third]), np.column_stack([alone, none, none])])


def fit_counts(patterns, counts, penalty=None, start=None):
    """Repeat counts x >= 0 that minimise |A x - counts|^2 / 2 + penalty . x, by accelerated projected
    gradients. A column of A counts how often its pattern holds each length."""
    if not len(patterns):
        return np.zeros(0)
    n = len(counts)
    filled = patterns >= 0
    index = np.where(filled, patterns, n)
    penalty = 0.0 if penalty is None else penalty

    def apply(x):
        return np.bincount(index.ravel(), np.repeat(x, 3), n + 1)[:n]

    def back(r):
        return np.append(r, 0.0)[index].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):  # The largest eigenvalue gives the step.
        v = back(apply(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * v @ back(apply(v)))
    x = y = np.zeros(len(patterns)) if start is None else start
    t = 1.0
    least, most = ROUNDS
    for _ in range(int(np.clip(WORK // len(patterns), least, most))):
        new = np.maximum(0, y - step * (back(apply(y) - counts) + penalty))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def fitted_patterns(lengths, counts, capacity):
    """Patterns with the repeats that least squares give them.

    What a pattern leaves empty costs a little in the fit, so that of all fits one with few
    sequences is found; the patterns it uses are then fitted again without that cost.
    """
    patterns = few_patterns(lengths, capacity)
    held = np.append(np.asarray(lengths), 0)[patterns].sum(axis=1)
    empty = (capacity - held) / capacity
    repeats = fit_counts(patterns, counts, EMPTY * counts.mean() * empty)
    used = repeats > 0.5
    return patterns[used], fit_counts(patterns[used], counts, start=repeats[used])


def best_fit(lengths, counts, capacity):
    """(lengths, repeats) of sequences: longest first, each into the fullest that has room.

    Works on counts of equal lengths and equal sequences, so its cost does not grow with them.
    """
    room = {}  # room left -> list of [lengths, repeats]
    for size, left in sorted(zip(lengths, counts), reverse=True):
        while left:
            fits = [r for r in room if r >= size]
            space = min(fits) if fits else capacity
            held, bins = room[space].pop() if fits else ((), left)
            if fits and not room[space]:
                del room[space]
            per = space // size
            full = min(bins, left // per)
            if full:
                room.setdefault(space - per * size, []).append((held + (size,) * per, full))
                left -= full * per
            if full < bins and 0 < left < per:
                room.setdefault(space - left * size, []).append((held + (size,) * left, 1))
                left, full = 0, full + 1
            if fits and full < bins:
                room.setdefault(space, []).append((held, bins - full))
    return [b for group in room.values() for b in group]


def patterns_for(histogram: dict, capacity=CAPACITY):
    """(lengths, repeats) of sequences that hold ``histogram`` (length -> count) exactly.

    The fitted repeats are tried whole and in smaller SHARES, the rest of the pieces packed
    best-fit each time; the plan with the fewest sequences is taken.
    """
    lengths = sorted(k for k, n in histogram.items() if n)
    if not lengths:
        return []
    counts = np.array([histogram[k] for k in lengths], np.int64)
    patterns, fitted = fitted_patterns(lengths, counts.astype(float), capacity)
    plans = (_rounded(lengths, counts, patterns, share * fitted, capacity) for share in SHARES)
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _rounded(lengths, counts, patterns, fitted, capacity):
    """A plan of the rounded repeats, as far as the counts go, and best-fit for what is left."""
    left, plan = counts.copy(), []
    wanted = np.rint(fitted).astype(np.int64)
    for k in np.argsort(-wanted, kind="stable"):
        if wanted[k] <= 0:
            break
        held, times = np.unique(patterns[k][patterns[k] >= 0], return_counts=True)
        n = int(min(wanted[k], (left[held] // times).min()))
        if n:
            left[held] -= n * times
            sizes = tuple(lengths[i] for i, t in zip(held, times) for _ in range(t))
            plan.append((sizes[::-1], n))
    rest = left > 0
    return plan + best_fit(np.array(lengths)[rest].tolist(), left[rest].tolist(), capacity)


@dataclass(frozen=True)
class Places:
    """For runs of ranks of a length: the key of the first, its sequence, and the offset there."""

    keys: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray


def places(plan):
    """Where the pieces of each length go, by rank: the plan's size, not the pieces', bounds it."""
    taken, rows, base = {}, [], 0
    for sizes, repeats in plan:
        offset = 0
        for size in sizes:
            first = taken.get(size, 0)
            rows.append(((size << _SHIFT) + first, base, offset))
            taken[size] = first + repeats
            offset += size
        base += repeats
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return Places(table[:, 0], table[:, 1], table[:, 2])


def pack(pieces: DataFrame, capacity=CAPACITY, length="length") -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity``, without gaps.

    Every row is placed, repeated ones too; an empty table stays empty. ``length`` must be
    between 1 and ``capacity``; columns named sequence_id or offset are replaced, others kept whatever
    their names. The driver sees the histogram only. Ranks within a length come
    from counts of (length, bucket) and row numbers inside these, so that a length of many pieces
    is ranked by many tasks.
    """
    row, bucket, earlier, rank, placed_at = (free_name(pieces, n) for n in ("row", "bucket", "before", "rank", "placed"))
    pieces = stage(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count("*")).collect()}
    where = places(patterns_for(histogram, capacity))
    buckets = max(1, -(-max(histogram.values(), default=0) // RANKED))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)))
    n = F.count("*").alias(rank)
    so_far = F.sum(rank).over(Window.partitionBy(length).orderBy(bucket)) - F.col(rank)
    before = dealt.groupBy(length, bucket).agg(n).select(length, bucket, so_far.alias(earlier))
    within = Window.partitionBy(length, bucket).orderBy(row)
    ranked = (
        dealt.withColumn(rank, F.row_number().over(within) - 1)
        .join(before, [length, bucket])
        .withColumn(rank, F.col(rank) + F.col(earlier))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (size.to_numpy() << _SHIFT) + rank.to_numpy()
        at = np.searchsorted(where.keys, key, side="right") - 1
        return pd.DataFrame(
            {
                "sequence_id": where.sequences[at] + key - where.keys[at],
                "offset": where.offsets[at],
            }
        )

    placed = ranked.withColumn(placed_at, place(F.col(length), F.col(rank)))
    made = ("sequence_id", "offset")
    kept = (F.col(f"`{c}`") for c in pieces.columns if c != row and c not in made)
    return placed.select(*kept, *(F.col(f"{placed_at}.{c}").alias(c) for c in made))


def pack_documents(docs: DataFrame, tokenizer, id="doc_id", text="text", capacity=CAPACITY, end=END, with_ids=False):
    """Tokenise whole documents, cut those over ``capacity``, and pack the pieces.

    Columns: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset. A null or empty
    text is its end mark alone; repeated rows are packed each, an empty table gives an empty one;
    other columns are ignored, whatever their names.
    """
    return pack(token_pieces(docs, tokenizer, id, text, capacity, end, with_ids), capacity)
