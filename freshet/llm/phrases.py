"""Collocations by Rabin-Karp fingerprints.

A task sums its texts' bytes, times powers of a base, along the texts: the hash of any word is a
difference of two such sums. The same sums over the words' hashes give the fingerprint of any run
of words. Fingerprints are counted before and after a shuffle, each with a pointer to a text that
has it, and no text is shuffled for them. A run can only be frequent if all its parts are, so
longer runs are counted only where a Bloom filter may hold their parts.

The texts are then read once more, and each frequent run is cut out of the text that its pointer
names. Runs of different text that share a fingerprint are known by a second, independent one:
where it is not the same for all, the fingerprint's runs are counted by their text instead.
"""

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from freshet.llm.bloom import LIMIT, blocks_for, build, mix
from freshet.storage import stage

LONGEST = 4  # Words of the longest phrase.
LEAST = 30  # Occurrences of a phrase.
SCALE = 2_000_000  # Of scores.
SLICE = 500_000  # Bytes of texts that a task handles at once; a piece of a text is never cut.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_LOWER = bytes(range(256)).lower()
_BLANK, _BREAK, _INSIDE = 0, 1, 2


def _kinds():
    out = np.full(256, _INSIDE, np.uint8)
    out[[0x20, 0x09]] = _BLANK
    out[list(b".,;:!?\x0a\x0b\x0c\x0d")] = _BREAK
    return out


_KINDS = _kinds()
_LADDERS = {}


def _ladder(base, n):
    """The first ``n`` powers of ``base``."""
    if n > len(_LADDERS.get(base, ())):
        steps = np.full(n + n // 4, base, np.uint64)
        steps[:1] = 1
        _LADDERS[base] = np.multiply.accumulate(steps)
    return _LADDERS[base][:n]


def _run_hashes(values, start, end):
    """Hash of values[start:end] for each pair of places."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _ladder(_BASE, len(values)), out=sums[1:])
    return (sums[end] - sums[start]) * _ladder(_INVERSE, len(values) + 1)[start]


@dataclass
class Slice:
    """The words of some texts, in order."""

    data: np.ndarray  # bytes of the texts, one after another, A-Z in lower case
    start: np.ndarray  # of each word in data
    end: np.ndarray
    piece: np.ndarray  # number of the piece that each word is in
    row: np.ndarray  # the text that each word is of
    origin: np.ndarray  # where each text begins in data, below zero if that is in a slice before
    seeds: np.ndarray  # of each text's group

    @classmethod
    def of(cls, data: bytes, origin, seeds):
        low = np.frombuffer(data.translate(_LOWER), np.uint8)
        kind = _KINDS[low]
        inside = np.zeros(len(low) + 2, bool)
        inside[1:-1] = kind == _INSIDE
        first = np.zeros(len(low) + 1, bool)  # texts begin here, so words end here
        first[np.clip(origin, 0, len(low))] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        breaks = np.cumsum((kind == _BREAK) + first[:-1], dtype=np.int32)
        row = np.searchsorted(origin, start, side="right") - 1
        return cls(low, start, end, breaks[start], row, origin, seeds)

    @cached_property
    def hashes(self):
        """A hash of each word."""
        plain = _run_hashes(self.data.astype(np.uint64), self.start, self.end)
        return mix(plain ^ (self.end - self.start).astype(np.uint64) << np.uint64(48))

    def prints(self, width, bits=64):
        """(first word, fingerprint) of all runs of ``width`` words within pieces."""
        n = len(self.start)
        at = np.flatnonzero(self.piece[width - 1 :] == self.piece[: n + 1 - width]) if n >= width else np.zeros(0, int)
        runs = _run_hashes(self.hashes, at, at + width)
        return at, mix(runs ^ self.seeds[self.row[at]] ^ np.uint64(width)) >> np.uint64(64 - bits)

    @cached_property
    def others(self):
        """A second hash of each word."""
        return mix(self.hashes ^ np.uint64(0xA0761D6478BD642F))

    def checks(self, at, width):
        """A second fingerprint, of 32 bits, of the runs of ``width`` words at ``at``."""
        runs = mix(_run_hashes(self.others, at, at + width) ^ self.seeds[self.row[at]])
        return (runs >> np.uint64(32)).astype(np.int64)

    def phrases(self, at, width):
        """The text of the runs of ``width`` words at ``at``, a space between words."""
        raw = self.data.tobytes()
        cuts = [zip(self.start[at + k].tolist(), self.end[at + k].tolist()) for k in range(width)]
        return [b" ".join([raw[i:j] for i, j in run]) for run in zip(*cuts)]


def _parts(data, start, end):
    """Ranges of about SLICE bytes of data[start:end], cut after the end of a piece."""
    while end - start > SLICE:
        found = _END.search(data, start + SLICE, end)
        stop = found.end() if found else end
        yield start, stop
        start = stop
    if end > start:
        yield start, end


def read_slices(column, seeds):
    """(first row, Slice) of an Arrow column of texts; ``seeds`` are the groups' by row.

    A text over the size of a slice is read in several.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = memoryview(data if data is not None else b"")
    seeds = np.asarray(seeds, np.uint64)
    edges = (np.flatnonzero(np.diff((at[1:] - at[0]) // SLICE)) + 1).tolist()
    for a, b in zip([0, *edges], [*edges, len(column)]):
        if a == b:
            continue
        if b - a == 1 and at[b] - at[a] > SLICE:
            for start, stop in _parts(data, int(at[a]), int(at[b])):
                yield a, Slice.of(bytes(data[start:stop]), at[a : a + 1] - start, seeds[a : a + 1])
        else:
            yield a, Slice.of(bytes(data[at[a] : at[b]]), at[a:b] - at[a], seeds[a:b])


def _seeds(groups):
    """A 64-bit number for each group's name."""
    return [xxh64_intdigest(g, 7) for g in groups]


def _kept(part, width, within, sieve, bits):
    """(place, fingerprint) of the runs of ``width`` words whose runs of ``within`` words the sieve may hold."""
    at, prints = part.prints(width, bits)
    if sieve is None or not len(at):
        return at, prints
    if width == within:
        keep = sieve.value.holds(0, mix(prints))
        return at[keep], prints[keep]
    whole = np.zeros(len(part.start), bool)
    inner, keys = part.prints(within, bits)
    whole[inner[sieve.value.holds(0, mix(keys))]] = True
    keep = whole[at]
    for k in range(1, width - within + 1):
        keep &= whole[at + k]
    return at[keep], prints[keep]


def _rows(docs, id, text, group):
    kind = docs.schema[id].dataType.simpleString()
    pointer = F.col(id).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(id)
    return docs.select(
        F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("group"),
        F.col(text).alias("text"),
        pointer.alias("doc"),
    )


def _pointers(part, words, docs, first_row):
    """The text and the place in it, in bytes, of the runs that begin at ``words``."""
    row = part.row[words]
    return pc.take(docs, pa.array(first_row + row)), pa.array(part.start[words] - part.origin[row])


def _count(rows, widths, within, sieve, bits):
    """(print, n, doc, low, high): fingerprints with their number, a text that has one, and the least
    and greatest second fingerprint, over all rows."""

    def run(batches):
        for batch in batches:
            seeds = _seeds(batch.column(0).to_pylist())
            for first_row, part in read_slices(batch.column(1), seeds):
                for width in widths:
                    at, prints = _kept(part, width, within, sieve, bits)
                    keys, first, group, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
                    checks = part.checks(at, width)
                    low, high = checks[first], checks[first]
                    apart = np.flatnonzero(checks != low[group])
                    np.minimum.at(low, group[apart], checks[apart])
                    np.maximum.at(high, group[apart], checks[apart])
                    doc, _ = _pointers(part, at[first], batch.column(2), first_row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), doc, pa.array(low), pa.array(high)],
                        ["print", "n", "doc", "low", "high"],
                    )

    counted = rows.mapInArrow(run, "print long, n long, doc long, low long, high long")
    return counted.groupBy("print").agg(
        F.sum("n").alias("n"), F.min("doc").alias("doc"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _pointed(prints, docs):
    """A key for each fingerprint and the text that its pointer names."""
    return mix(prints ^ mix(docs.view(np.uint64) + np.uint64(1)))


def _sieve(prints, limit, pointed=False):
    """Bloom filter of a table of fingerprints, or of them with their pointers, of at most ``limit`` bytes.

    A filter too small for its fingerprints lets more through; the counts stay right.
    """

    def keys(batches):
        for batch in batches:
            prints, docs = (batch.column(k).fill_null(0).to_numpy() for k in (0, 1))
            mixed = _pointed(prints.view(np.uint64), docs) if pointed else mix(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(mixed), np.int32)), pa.array(mixed.view(np.int64))], ["shard", "key"]
            )

    mixed = prints.select("print", "doc").mapInArrow(keys, "shard int, key long")
    return prints.sparkSession.sparkContext.broadcast(build(mixed, {0: blocks_for(prints.count(), limit)}))


def _cut_out(rows, widths, sieve, bits):
    """(print, check, group, phrase, width, doc, at): the runs that ``sieve`` may hold with the text they
    are in, each once a slice, and their second fingerprint; and a row of width 0 for each group and
    slice, where at is the number of words."""

    def run(batches):
        for batch in batches:
            groups, docs = batch.column(0).to_pylist(), batch.column(2)
            for first_row, part in read_slices(batch.column(1), _seeds(groups)):
                totals = Counter()
                for k, n in enumerate(np.bincount(part.row, minlength=len(part.origin)).tolist(), first_row):
                    totals[groups[k]] += n
                none = [0] * len(totals)
                yield _runs(none, none, list(totals), [b""] * len(totals), 0, None, list(totals.values()))
                mine = docs.slice(first_row, len(part.origin)).fill_null(0).to_numpy()
                for width in widths:
                    at, prints = part.prints(width, bits)
                    keys = _pointed(prints, mine[part.row[at]])
                    held = sieve.value.holds(0, keys)
                    at, prints = at[held], prints[held]
                    checks = part.checks(at, width)
                    _, first = np.unique(mix(keys[held] ^ checks.astype(np.uint64)), return_index=True)
                    at, prints, checks = at[first], prints[first], checks[first]
                    doc, place = _pointers(part, at, docs, first_row)
                    group = [groups[first_row + r] for r in part.row[at].tolist()]
                    yield _runs(prints.view(np.int64), checks, group, part.phrases(at, width), width, doc, place)

    return rows.mapInArrow(run, "print long, check long, group string, phrase string, width int, doc long, at long")


def _runs(prints, checks, groups, phrases, width, docs, at):
    n = len(groups)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(prints, pa.int64()),
            pa.array(checks, pa.int64()),
            pa.array(groups, pa.string()),
            pa.array(phrases, pa.binary()).cast(pa.string()),
            pa.array(np.full(n, width, np.int32)),
            pa.nulls(n, pa.int64()) if docs is None else docs,
            pa.array(at, pa.int64()),
        ],
        ["print", "check", "group", "phrase", "width", "doc", "at"],
    )


def _counted_as_text(rows, widths, sieve, bits):
    """(group, phrase, width, a, doc, at) of the runs whose fingerprint ``sieve`` may hold, by their text."""

    def run(batches):
        for batch in batches:
            groups, docs = batch.column(0).to_pylist(), batch.column(2)
            for first_row, part in read_slices(batch.column(1), _seeds(groups)):
                held = {}
                for width in widths:
                    at, _ = _kept(part, width, width, sieve, bits)
                    rows_of = part.row[at].tolist()
                    for word, row, phrase in zip(at.tolist(), rows_of, part.phrases(at, width)):
                        held.setdefault((groups[first_row + row], phrase, width), [word, 0])[1] += 1
                words = np.array([w for w, _ in held.values()], np.int64)
                doc, place = _pointers(part, words, docs, first_row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g for g, _, _ in held], pa.string()),
                        pa.array([t for _, t, _ in held], pa.binary()).cast(pa.string()),
                        pa.array([w for _, _, w in held], pa.int32()),
                        pa.array([n for _, n in held.values()], pa.int64()),
                        doc,
                        place,
                    ],
                    ["group", "phrase", "width", "a", "doc", "at"],
                )

    found = rows.mapInArrow(run, "group string, phrase string, width int, a long, doc long, at long")
    return found.groupBy("group", "phrase", "width").agg(
        F.sum("a").alias("a"), F.min("doc").alias("doc"), F.min_by("at", "doc").alias("at")
    )


def phrase_counts(
    docs: DataFrame, id="doc_id", text="text", group="lang", longest=LONGEST, least=LEAST, limit=LIMIT, bits=64
) -> DataFrame:
    """(group, phrase, width, a, doc, at): each run of up to ``longest`` words that occurs ``least``
    times, and a row of width 0 for each group, where a is the number of all its words.

    Words: A-Z in lower case, texts cut at ``.,;:!?`` and line ends into pieces, pieces at blanks
    and tabs. a counts all occurrences within pieces, overlaps included, by group (null: ``und``).
    doc and at point to one of them: the id (its xxhash64 if it is no whole number), and the
    place of its first word in the text, in bytes of UTF-8. ``bits`` is the length of
    fingerprints; fewer give more collisions and the same result.
    """
    rows = _rows(docs, id, text, group)
    found, sieve, within = None, None, 1
    for widths in ([1], [2], list(range(3, longest + 1))):
        widths = [w for w in widths if w <= longest]
        if widths:
            counted = _count(rows, widths, within, sieve, bits).where(F.col("n") >= least)
            some = stage(counted, "phrase-prints")
            found = some if found is None else found.union(some)
            sieve, within = _sieve(some, limit), widths[0]
    widths = range(1, longest + 1)
    cut = stage(_cut_out(rows, widths, _sieve(found, limit, pointed=True), bits), "phrase-texts")
    totals = cut.where("width = 0").groupBy("group").agg(F.sum("at").alias("a"))
    nothing = F.lit(None).cast("long")
    out = totals.select("group", F.lit("").alias("phrase"), F.lit(0).alias("width"), "a", nothing.alias("doc"), nothing.alias("at"))
    # A text cut in slices, or rows that repeat its id, may hold a run more than once.
    first = (F.min_by(c, "at").alias(c) for c in ("group", "phrase", "width"))
    texts = cut.where("width > 0").groupBy("print", "check").agg(*first, F.min("at").alias("at"))
    sure = found.where("low = high").select("print", F.col("low").alias("check"), F.col("n").alias("a"), "doc")
    out = out.union(texts.join(sure, ["print", "check"]).select("group", "phrase", "width", "a", "doc", "at"))
    shared = found.where("low <> high")
    if not shared.isEmpty():
        recounted = _counted_as_text(rows, widths, _sieve(shared, limit), bits)
        # Beyond the shared fingerprints the filter may hold others: these are counted already.
        known = out.select("group", "phrase", "width")
        recounted = recounted.where(F.col("a") >= least).join(known, ["group", "phrase", "width"], "left_anti")
        out = out.union(recounted.select(*out.columns))
    return out


def _whole(column):
    return column.cast("decimal(20,0)")


def scored_phrases(frequent: DataFrame, scale=SCALE, share=80) -> DataFrame:
    """(group, phrase, a, l, r, score, doc, at) of the frequent phrases of two words or more.

    A phrase cut after its first words gives l and r, the counts of both parts, and the score
    floor(scale * a / (l + r)); the lowest counts, of equal ones that of the first cut. A phrase
    inside a longer one that occurs at least ``share`` percent as often is left out. All figures
    are exact: products are decimals of 38 digits.
    """
    words = F.split("phrase", " ")
    phrases = frequent.where("width > 1").withColumn("words", words)
    known = frequent.select("group", "phrase", "a")

    def some(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    cuts = phrases.select("group", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "group", "phrase", "a", "k", some(F.lit(1), F.col("k")).alias("head"), some(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail")
    )
    heads = known.select("group", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = known.select("group", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    both = cuts.join(heads, ["group", "head"]).join(tails, ["group", "tail"])
    score = F.expr(f"(cast({scale} as decimal(12,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = both.groupBy("group", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    def inner(width):
        return F.transform(
            F.sequence(F.lit(1), F.size("words") - width + 1), lambda i: F.array_join(F.slice("words", i, width), " ")
        )

    widest = frequent.agg(F.max("width").alias("w")).first()["w"] or 2
    parts = F.flatten(
        F.array(*(F.when(F.size("words") > w, inner(F.lit(w))).otherwise(F.array().cast("array<string>")) for w in range(2, max(3, widest))))
    )
    inside = (
        phrases.where("width > 2")
        .select("group", F.explode(parts).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("group", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    covered = F.lit(100) * _whole(F.col("longer")) >= F.lit(share) * _whole(F.col("a"))
    return (
        phrases.select("group", "phrase", "a", "doc", "at")
        .join(inside, ["group", "phrase"], "left")
        .where(F.col("longer").isNull() | ~covered)
        .join(least, ["group", "phrase"])
        .select("group", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), "doc", "at")
    )


def collocations(
    docs: DataFrame, id="doc_id", text="text", group="lang", longest=LONGEST, least=LEAST, first=2000, limit=LIMIT, bits=64
) -> DataFrame:
    """Each group's ``first`` phrases by score, then a, then text: lang, rank, phrase, a, l, r, n, score, doc, at.

    See ``phrase_counts`` and ``scored_phrases``; n is the number of the group's words. Null and
    empty texts have no words. Texts of any length are read whole, a repeated row counts again, a
    null id leaves the pointer null where no other row has the phrase, a null group is ``und``. An
    empty table gives an empty one; other columns are ignored, whatever their names.
    """
    counted = stage(phrase_counts(docs, id, text, group, longest, least, limit, bits), "phrases")
    totals = counted.where("width = 0").select("group", F.col("a").alias("n"))
    scored = scored_phrases(counted.where("width > 0"))
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(totals, "group").select(
        F.col("group").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "doc", "at"
    )
