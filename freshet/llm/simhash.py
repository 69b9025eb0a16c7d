"""SimHash near-duplicates, compared on vertical bit planes.

A text's words are the runs of other than ASCII white space after lower-casing A-Z; its shingles
are ``width`` neighbouring words joined by a space. Each bit of the 64-bit fingerprint is 1 where
over half of the shingles' XXH64 values have it set. Fingerprints that differ in at most
``radius`` bits are linked.

Candidates come from the pigeonhole principle, so none is missed: cut the 64 bits into more
blocks than ``radius``; two linked fingerprints agree in all blocks but ``radius`` of them. Rows
that agree in those blocks meet in one bucket, whose fingerprints are compared by bit slices.
"""

import re
from itertools import combinations, repeat
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from freshet.llm.common import free_name, merge_labels, text_slices
from freshet.llm.components import components
from freshet.storage import stage

SEED = 42
BUCKET = 512  # Fingerprints a bucket should hold; decides how many bits the buckets agree in.
BLOCK = 4096  # A bucket over this size is cut, and compared part against part in several tasks.
CHUNK = 1 << 20  # Bytes of a text whose words are held at once.
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_TILE = 64  # Queries compared with a block at a time.


def _words(data: bytes):
    """Lists of words, cut from pieces of about CHUNK bytes that end at white space."""
    start = 0
    while start < len(data):
        end = min(start + CHUNK, len(data))
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end


def fingerprint(text, width=3) -> int:
    """Unsigned fingerprint of one whole text; zero for null and for a text without words.

    A text with fewer than ``width`` words has one shingle, the whole sequence. Works through
    the text in pieces, so its length does not bound it.
    """
    if not text:
        return 0
    set_bits, total, tail = np.zeros(64, np.int64), 0, []
    for words in _words(text.encode("utf-8", "surrogatepass").lower()):
        tail += words
        grams = map(b" ".join, zip(*(tail[k:] for k in range(width))))
        hashes = np.array(list(map(xxh64_intdigest, grams, repeat(SEED))), np.uint64)
        if len(hashes):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_bits += bits.sum(axis=0, dtype=np.int32)
            total += len(hashes)
            tail = tail[len(tail) - width + 1 :]
    if not total:
        return xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * set_bits > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text, width=3):
    """Fingerprint of a text column, as a long with the same bits."""

    @F.arrow_udf(T.LongType())
    def marks(column: pa.Array) -> pa.Array:
        found = [fingerprint(t, width) for _, texts in text_slices(column) for t in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return marks(text)


def planes(values):
    """Bit planes of 64-bit values: row p holds bit p of all of them, 64 values to a word."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-len(values) // 64)
    lanes = np.zeros((64, words * 64), np.uint8)
    lanes[:, : len(values)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def close_pairs(queries, block, radius):
    """Index pairs (query, member) that differ in at most ``radius`` bits, and how far.

    Each step reads two planes and adds them, with the counters' lowest bit, in a carry-save
    adder: all distances of a tile are updated by a few bitwise operations on whole words. A
    lane whose counter runs over is beyond the radius; a query is abandoned when all its lanes
    are, and the tile when all its queries are.
    """
    lanes = planes(block)
    depth = max(1, ceil(log2(radius + 1)))
    found_q, found_m = [], []
    for at in range(0, len(queries), _TILE):
        rows = np.arange(at, min(at + _TILE, len(queries)))
        q = queries[rows]
        count = [np.zeros((len(rows), lanes.shape[1]), np.uint64) for _ in range(depth)]
        over = np.zeros_like(count[0])
        for p in range(0, 64, 2):
            x, y = (
                lanes[k][None, :] ^ (((q >> np.uint64(k)) & np.uint64(1)) * FULL)[:, None]
                for k in (p, p + 1)
            )
            half = count[0] ^ x
            carry = (count[0] & x) | (half & y)
            count[0] = half ^ y
            for k in range(1, depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if p in (14, 22, 30, 46):
                live = (over != FULL).any(axis=1)
                if not live.all():
                    rows, q, over = rows[live], q[live], over[live]
                    count = [c[live] for c in count]
                    if not len(rows):
                        break
        if len(rows):
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            i, m = np.nonzero(near[:, : len(block)])
            found_q.append(rows[i])
            found_m.append(m)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, m = np.concatenate(found_q), np.concatenate(found_m)
    exact = np.bitwise_count(queries[i] ^ block[m]) <= radius  # where 2^depth - 1 > radius
    return i[exact], m[exact]


def bucket_masks(n, radius, bucket=BUCKET):
    """Bit masks of the candidate tables for ``n`` fingerprints.

    Two values within ``radius`` agree under at least one mask, whatever ``n``: more blocks only
    make the buckets smaller, and copies of the rows more.
    """
    wanted = max(0, ceil(log2(max(n, 1) / bucket)))
    if not wanted:
        return [0]
    for blocks in range(radius + 1, 64):
        chosen = blocks - radius
        edges = [64 * k // blocks for k in range(blocks + 1)]
        if wanted <= chosen * (64 // blocks) or chosen >= 4:
            break
    masks = []
    for picked in combinations(range(blocks), chosen):
        bits = [b for k in picked for b in range(edges[k], edges[k + 1])]
        masks.append(sum(1 << b for b in bits[:wanted]))
    return masks


def link_fingerprints(marks: DataFrame, column="fingerprint", radius=3, bucket=BUCKET, block=BLOCK):
    """(node, component) for every distinct fingerprint that is linked to another.

    ``marks`` holds distinct non-null longs. A bucket over ``block`` members is dealt to parts,
    and each pair of parts is compared in a task of its own, so one large group of near copies
    neither fills a task nor is cut short. A task returns links to the least member of each of
    its groups, not its pairs.
    """
    masks = bucket_masks(marks.count(), radius, bucket)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    mark = F.col(column).alias("mark")
    tables = F.array(
        *(
            F.struct(F.lit(k).alias("table"), F.col(column).bitwiseAND(F.lit(m)).alias("key"))
            for k, m in enumerate(signed)
        )
    )
    rows = marks.select(mark, F.explode(tables).alias("b")).select("mark", "b.*")
    large = rows.groupBy("table", "key").count().where(F.col("count") > block)
    parts = F.ceil(F.coalesce("count", F.lit(1)) / block).cast("int")
    dealt = (
        rows.join(large, ["table", "key"], "left")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("mark", F.lit(1)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "table",
            "key",
            F.least("part", "other").alias("i"),
            F.greatest("part", "other").alias("j"),
            "part",
            "mark",
        )
    )

    def compare(frame):
        i, j = frame["i"].iat[0], frame["j"].iat[0]
        values = np.sort(frame["mark"].to_numpy().view(np.uint64))
        if i == j:
            a, b = close_pairs(values, values, radius)
        else:
            mine = (frame["part"] == i).to_numpy()
            own = frame["mark"].to_numpy().view(np.uint64)
            left, right = own[mine], own[~mine]
            a, b = close_pairs(left, right, radius)
            values = np.concatenate([left, right])
            b = b + len(left)
        label = np.arange(len(values))
        merge_labels(label, a, b)
        moved = label != np.arange(len(values))
        return pd.DataFrame(
            {
                "a": values[moved].view(np.int64),
                "b": values[label[moved]].view(np.int64),
            }
        )

    edges = dealt.groupBy("table", "key", "i", "j").applyInPandas(compare, "a long, b long")
    return components(edges)


def _grouped(docs, id, text, width, radius):
    marks = stage(
        docs.select(F.col(id).alias("doc_id"), fingerprint_column(F.col(text), width).alias("fingerprint")),
        "simhash",
    )
    classes = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    linked = link_fingerprints(classes.select("fingerprint"), radius=radius)
    rooted = stage(
        classes.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "least", F.coalesce("component", "fingerprint").alias("root")
        ),
        "simhash-classes",
    )
    named = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    classes = rooted.select("fingerprint", "root").join(named, "root")
    return marks.join(classes, "fingerprint")


def simhash_groups(docs: DataFrame, id="doc_id", text="text", width=3, radius=3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (long), component_id.

    component_id is the least id of the rows whose fingerprints are reachable by links, itself
    included; rows with equal fingerprints are one class and always linked. A null or empty text
    has fingerprint zero. A null id takes part, and counts only where all ids of its component
    are null: component_id is then null. Rows that repeat an id give a row each. An empty table
    gives an empty one. Other columns are ignored, whatever their names.
    """
    return _grouped(docs, id, text, width, radius).select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, id="doc_id", text="text", width=3, radius=3) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their group; all columns as they are.

    Of the rows of a group that share this least id, or have none where all ids are null, one
    stays. The other rows go.
    """
    groups = stage(_grouped(docs, id, text, width, radius), "simhash-groups")
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(least).alias("least")
    )
    kept_id, kept_mark = free_name(docs, "kept_id"), free_name(docs, "kept_mark")
    single = ids.where("n = 1 and least and doc_id is not null")
    out = docs.join(
        single.select(F.col("doc_id").alias(kept_id)), F.col(id) == F.col(kept_id), "left_semi"
    )
    repeated = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("id"))
    if repeated.take(1):
        # An id alone does not name these rows: find the kept text, and keep one row of it.
        again = (
            groups.where(least)
            .join(repeated, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
            .groupBy("doc_id", "root")
            .agg(F.min("fingerprint").alias(kept_mark))
            .select(F.col("doc_id").alias(kept_id), kept_mark)
        )
        mark = free_name(docs, "mark_of_text")
        twins = (
            docs.withColumn(mark, fingerprint_column(F.col(text), width))
            .join(
                again,
                F.col(id).eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_mark)),
                "left_semi",
            )
            .dropDuplicates([id, mark])
        )
        out = out.union(twins.select(*(F.col(f"`{c}`") for c in docs.columns)))
    return out
