"""Spelling variants by Bloom-guided neighbourhoods.

Every string that is one edit away from a word of the vocabulary is generated and probed against
Bloom filters of the vocabulary, one for each length, that all tasks hold; the few that may be
words are shuffled to the vocabulary itself, which removes the false ones. Of the two words of a
pair one alone generates the other: the longer by deletion, the one with the smaller letter by
replacement.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.bloom import LIMIT, blocks_for, build, mix
from freshet.llm.common import text_slices
from freshet.storage import stage

LETTERS = "A-Za-zÀ-ÿ"  # What runs are made of.
HELD = 200_000  # Runs whose counts a task holds before it passes them on.
EDITS = 1 << 18  # Edits of words that are probed at a time.
_BASE = np.uint64(0x9E3779B97F4A7C15)  # Of the words' polynomials, odd.
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _table():
    """Latin-1 bytes of letters, A-Z in lower case; of all others a space."""
    letter = re.compile(f"[{LETTERS}]")
    low = [chr(k).lower() if k < 128 else chr(k) for k in range(256)]
    return "".join(low[k] if letter.match(chr(k)) else " " for k in range(256)).encode("latin-1")


_LETTER_TABLE = _table()


def runs(text):
    """Maximal runs of letters of a text, A-Z in lower case, as Latin-1 bytes, one a character."""
    # A character beyond Latin-1 becomes a question mark, which is no letter either.
    return text.encode("latin-1", "replace").translate(_LETTER_TABLE).split()


def _with_typos(counts, id, every):
    """The runs' counts after those whose hash ``every`` divides have lost a letter."""
    prefix = zlib.crc32(f"{'' if id is None else id}:".encode())
    out = Counter()
    for run, n in counts.items():
        said = run if run.isascii() else run.decode("latin-1").encode()
        h = zlib.crc32(said, prefix)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def count_words(docs: DataFrame, id="doc_id", text="text", least_letters=6, least_count=5, typos=None) -> DataFrame:
    """word and n of the words of at least ``least_letters`` letters that occur ``least_count`` times.

    Words are maximal runs of ``LETTERS`` in whole texts, A-Z in lower case. ``typos`` plants
    misspellings, for tests at scale: a run loses a letter where ``typos`` divides the crc32 of
    ``<id>:<run>`` (a null id is empty there). Null and empty texts have no words; a text's runs
    are counted in its task before anything is shuffled, so a common word has few rows.
    """

    def batch_of(held):
        words = [w.decode("latin-1") for w in held if len(w) >= least_letters]
        counts = [n for w, n in held.items() if len(w) >= least_letters]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    def count(batches):
        held = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in text_slices(batch.column(1)):
                for k, one in enumerate(texts, start):
                    found = Counter(runs(one)) if one else {}
                    if typos:
                        found = _with_typos(found, ids[k], typos)
                    held.update(found)
                    if len(held) > HELD:
                        yield batch_of(held)
                        held.clear()
        yield batch_of(held)

    counted = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(
        count, "word string, n long"
    )
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _matrix(words):
    """Code points of words of one length, a row each."""
    return np.array(words).view(np.uint32).reshape(len(words), -1)


def _powers(n):
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.multiply.accumulate(np.full(n, _BASE))
    return out


def _keys(sums, length):
    return mix(sums + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def _by_length(words):
    """Indices of words, by their length in code points."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(some):
            yield int(sizes[some[0]]), some


def word_keys(words):
    """Key of each word."""
    out = np.zeros(len(words), np.uint64)
    for size, some in _by_length(words):
        if size:
            codes = _matrix([words[k] for k in some]).astype(np.uint64)
            out[some] = _keys((codes * _powers(size)[:-1]).sum(axis=1, dtype=np.uint64), size)
    return out


def edits_in(words, alphabet, holds):
    """(index of the word, edited string) of the edits that may be words.

    ``holds(length, keys)`` says which keys may be those of words of a length. The edits are
    those with one character less, and those with one character replaced by a later one of the
    sorted ``alphabet``.
    """
    for size, some in _by_length(words):
        if not size:
            continue
        powers = _powers(size)
        for part in np.array_split(some, max(1, -(-len(some) * len(alphabet) // EDITS))):
            mine = [words[k] for k in part]
            codes = _matrix(mine).astype(np.uint64)
            terms = codes * powers[:-1]
            total = terms.sum(axis=1, dtype=np.uint64)
            before = np.zeros(len(part), np.uint64)  # sum of the terms before the place
            for i in range(size):
                # Of equal neighbours the first alone is taken out: the others give the same word.
                fresh = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(len(part))
                less = before[fresh] + (total[fresh] - before[fresh] - terms[fresh, i]) * _INVERSE
                for k in fresh[holds(size - 1, _keys(less, size - 1))]:
                    yield part[k], mine[k][:i] + mine[k][i + 1 :]
                later = alphabet[None, :] > codes[:, i : i + 1]
                row, letter = np.nonzero(later)
                changed = total[row] + (alphabet[letter] - codes[row, i]) * powers[i]
                for j in np.flatnonzero(holds(size, _keys(changed, size))):
                    word = mine[row[j]]
                    yield part[row[j]], word[:i] + chr(int(alphabet[letter[j]])) + word[i + 1 :]
                before = before + terms[:, i]


def filter_passes(sizes, limit=LIMIT):
    """Passes over the vocabulary, each a list of (length, slice, slices) whose filters fit ``limit`` bytes.

    ``sizes`` has the number of words of each length. A length whose filter is larger is cut
    into slices by the words' keys.
    """
    passes, used = [], limit + 1
    for length in sorted(sizes):
        whole = blocks_for(sizes[length], 1 << 62) * 32
        slices = -(-whole // limit)
        for k in range(slices):
            if used + whole // slices > limit:
                passes.append([])
                used = 0
            passes[-1].append((length, k, slices))
            used += whole // slices
    return passes


def _slice(keys, slices):
    return (keys.astype(np.uint32).astype(np.uint64) * np.uint64(slices)) >> np.uint64(32)


def _vocabulary_keys(vocabulary, shards):
    """(shard, key) of the words of the pass ``shards``: length to (slice, slices)."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys = word_keys(words)
            sizes = np.fromiter(map(len, words), np.int32, len(words))
            keep = np.zeros(len(words), bool)
            for length, (k, slices) in shards.items():
                keep |= (sizes == length) & (_slice(keys, slices) == k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes[keep]), pa.array(keys[keep].view(np.int64))], ["shard", "key"]
            )

    return vocabulary.select("word").mapInArrow(run, "shard int, key long")


def _alphabet(vocabulary):
    """The distinct characters of the words, sorted; there are no more than Unicode has."""

    def run(batches):
        seen = set()
        for batch in batches:
            seen.update(*batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(map(ord, seen)), pa.int32())], ["letter"])

    rows = vocabulary.select("word").mapInArrow(run, "letter int").distinct().collect()
    return np.array(sorted(r["letter"] for r in rows), np.uint64)


def _probe(vocabulary, alphabet, shards, filters):
    """(edit, word, n): edits of the vocabulary's words that the filters of a pass may hold."""

    def run(batches):
        lanes = filters.value

        def holds(length, keys):
            if length not in shards:
                return np.zeros(len(keys), bool)
            k, slices = shards[length]
            mine = np.flatnonzero(_slice(keys, slices) == k) if slices > 1 else np.arange(len(keys))
            out = np.zeros(len(keys), bool)
            out[mine] = lanes.holds(length, keys[mine])
            return out

        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1)
            at, found = [], []

            def rows():
                index = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), batch.column(0).take(index), counts.take(index)],
                    ["edit", "word", "n"],
                )

            for k, edit in edits_in(words, alphabet, holds):
                at.append(k)
                found.append(edit)
                if len(at) >= HELD:
                    yield rows()
                    at, found = [], []
            yield rows()

    wanted = [s + d for s in shards for d in (0, 1)]
    mine = vocabulary.select("word", "n").where(F.length("word").isin(*wanted))
    return mine.mapInArrow(run, "edit string, word string, n long")


def near_words(vocabulary: DataFrame, limit=LIMIT) -> DataFrame:
    """(word, n, other, other_n): each pair of words one edit apart, once.

    ``vocabulary`` has distinct words (word, n) and should be a stored table: it is read for
    each pass. One edit is a character inserted, deleted or replaced. Filters of at most
    ``limit`` bytes are broadcast at once; a larger vocabulary takes more passes.
    """
    spark = vocabulary.sparkSession
    sizes = {r["size"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    alphabet = _alphabet(vocabulary)
    found = vocabulary.selectExpr("word as edit", "word", "n").limit(0)
    for some in filter_passes(sizes, limit):
        shards = {length: (k, slices) for length, k, slices in some}
        blocks = {length: blocks_for(-(-sizes[length] // slices), limit) for length, (_, slices) in shards.items()}
        lanes = build(_vocabulary_keys(vocabulary, shards), blocks)
        found = found.union(_probe(vocabulary, alphabet, shards, spark.sparkContext.broadcast(lanes)))
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("other_n"))
    return found.join(known, "edit").select("word", "n", F.col("edit").alias("other"), "other_n")


def _roots(forms):
    """(word, root) of rows (word, form): forms followed to the last, in rounds that halve the way left."""
    ways = forms.select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = stage(
            ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def spelling_variants(
    docs: DataFrame, id="doc_id", text="text", least_letters=6, least_count=5, ratio=5, typos=None, limit=LIMIT
) -> DataFrame:
    """One row per word (see ``count_words``): word, form, root, n, n_near, form_n.

    Two words are near if one edit parts them. A word's form is its near word of largest n (ties:
    the first in code-point order) if that occurs at least ``ratio`` times as often; else null.
    root is the last of the forms of forms, the word itself where it has none; ``ratio`` must be
    over 1, so that they end. n_near is the number of near words, form_n the form's n.

    Null, empty and repeated texts: as ``count_words``. Long words have their edits probed a part
    at a time. An empty table gives an empty one; other columns are ignored, whatever their names.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    vocabulary = stage(count_words(docs, id, text, least_letters, least_count, typos), "vocabulary")
    pairs = near_words(vocabulary, limit)
    sides = F.array(
        F.struct("word", F.col("other"), F.col("other_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    # Strings compare by their UTF-8 bytes, and so by code points.
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    near = (
        pairs.select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
    )
    likely = -F.col("best.less") >= ratio * F.col("n")
    formed = stage(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(likely, F.col("best.other")).alias("form"),
            F.when(likely, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
