"""Language ID by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its cuts into pieces, by the forward algorithm; a text's is the
product over its words. The piece probabilities come from expectation maximisation over the
same sums, so no cut is ever chosen, in training or in scoring.
"""

import re
import unicodedata
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import Codes, text_slices

SAMPLE_CHARS = 1_500_000  # Characters to learn from per language, about; by hash of id and text.
LONGEST_PIECE = 16  # Characters, with the mark; no piece of letters may be longer.
STRETCH = 24  # Characters of a word that are summed at a time. Bounds memory only.
ROUNDS = 4  # Of expectation maximisation.
POOLED = 200.0  # Occurrences' worth of the pooled distribution in each language's.
UNSEEN = 1e-7  # Probability of a character that no piece covers.
CACHE = 250_000  # Words whose scores a task keeps; it then starts over. Bounds memory only.
MARK = "▁"
SHRUNK = 20  # Letters' worth of usual text that a text's surprise is averaged with.
_STEP = 5_000  # Stretches scored at a time.


def _letters():
    """Character classes of the basic plane's letters, and of its letters and marks."""
    kinds = [unicodedata.category(chr(k))[0] for k in range(1 << 16)]

    def ranges(wanted):
        inside = np.array([False, *(k in wanted for k in kinds), False])
        edges = np.flatnonzero(np.diff(inside.astype(np.int8)))
        return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))

    return ranges("L"), ranges("LM")


_L, _LM = _letters()
_BASIC = re.compile(f"[{_L}][{_LM}]*")
_ANY = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text):
    """Runs of letters of a text in lower case, with the marks on them; numbers are no letters."""
    low = text.lower()
    # The class of the basic plane alone is far quicker to look a character up in.
    basic = len(low.encode("utf-16-le", "surrogatepass")) == 2 * len(low)
    return (_BASIC if basic else _ANY).findall(low)


def _mixed(codes):
    """64 well-spread bits for each code point."""
    x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C55
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(LONGEST_PIECE + 1)], np.uint64)


def _prefix_hashes(words):
    """Lengths, and hashes of all prefixes, of words or of equal stretches of them."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max()) if len(words) else 0
    codes = np.array(words, dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(words), -1)
    mixed = _mixed(codes)
    sums = np.zeros((len(words), width + 1), np.uint64)
    for k in range(width):
        sums[:, k + 1] = sums[:, k] * np.uint64(_BASE) + mixed[:, k]
    return sizes, sums


def _spans(words, keys, lead=0):
    """For each end after ``lead``: (end, words, lengths and numbers of the pieces there, in the
    words' order, words whose last character is no piece)."""
    sizes, sums = _prefix_hashes(words)
    for end in range(lead + 1, sums.shape[1]):
        rows = np.flatnonzero(sizes >= end)
        lengths = np.arange(1, min(LONGEST_PIECE, end) + 1)
        part = sums[rows, end][:, None] - sums[rows[:, None], end - lengths] * _POWERS[lengths]
        at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
        known = keys[at] == part
        found, k = np.nonzero(known)
        yield end, rows[found], lengths[k], at[found, k], rows[~known[:, 0]]


def _forward(words, keys, probs, carried=None):
    """Sums over cuts: (word, position, language), and the spans used.

    ``carried`` holds the sums at the first positions, where words are stretches that go on.
    """
    if carried is None:
        carried = np.ones((len(words), 1, probs.shape[1]))
    lead = carried.shape[1] - 1
    spans = list(_spans(words, keys, lead))
    sums = np.zeros((len(words), max(map(len, words), default=0) + 1, probs.shape[1]))
    sums[:, : lead + 1] = carried
    for end, rows, lengths, pieces, bare in spans:
        if len(rows):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            parts = sums[rows, end - lengths] * probs[pieces]
            sums[rows[first], end] = np.add.reduceat(parts, first, axis=0)
        sums[bare, end] += sums[bare, end - 1] * UNSEEN
    return sums, spans


def _stretches(words, keys, probs):
    """The forward pass over whole words, STRETCH characters at a time.

    Gives, for each stretch: the words that reach it, their length in it, sums and spans, and
    which of them go on. These carry the sums of their last LONGEST_PIECE positions into the next
    stretch, divided by the very last one so that they never vanish.
    """
    words = [MARK + w for w in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at, end, carried = np.arange(len(words)), STRETCH, None
    while len(at):
        lead = 0 if carried is None else carried.shape[1] - 1
        start = end - STRETCH - lead
        parts = [words[k][start:end] for k in at]
        sums, spans = _forward(parts, keys, probs, carried)
        on = sizes[at] > end
        yield at, sizes[at].clip(max=end) - start, sums, spans, on
        if on.any():
            carried = sums[on][:, -min(end, LONGEST_PIECE) - 1 :]
            carried = carried / carried[:, -1:]
        at, end = at[on], end + STRETCH


def _batches(words):
    """(start, end) ranges of ``words`` of about _STEP stretches, one word at least."""
    start = held = 0
    for k, word in enumerate(words):
        n = len(word) // STRETCH + 1
        if held and held + n > _STEP:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(words):
        yield start, len(words)


def word_scores(words, keys, probs):
    """Log-probability of each word in each language."""
    out = np.zeros((len(words), probs.shape[1]))
    for a, b in _batches(words):
        for at, ends, sums, _, _ in _stretches(words[a:b], keys, probs):
            # Each stretch's last sum is in units of the last sum before it.
            out[a + at] += np.log(sums[np.arange(len(at)), ends])
    return out


@dataclass(frozen=True)
class LanguageModel:
    """languages: names, sorted; keys: hashes of pieces, sorted; probs: (piece, language); usual:
    the mean log-probability of a letter of each language's own texts."""

    languages: tuple
    keys: np.ndarray
    probs: np.ndarray
    usual: np.ndarray = None


def vocabulary(model_file):
    """Normal pieces of a SentencePiece model that are lower case.

    Pieces longer than LONGEST_PIECE that hold more than letters are in no word, and left out.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (
        sp.id_to_piece(k)
        for k in range(sp.get_piece_size())
        if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))
    )
    pieces = {p for p in pieces if p == p.lower()}
    long = {p for p in pieces if len(p) > LONGEST_PIECE}
    if any(words_of(p.removeprefix(MARK)) == [p.removeprefix(MARK)] for p in long):
        raise ValueError(f"{model_file} holds a piece of more than {LONGEST_PIECE} letters")
    return sorted(pieces - long)


def _fit(words, counts, pieces, languages):
    """Expectation maximisation over ``words`` seen ``counts[word, language]`` times."""
    _, sums = _prefix_hashes(pieces)
    hashes = sums[np.arange(len(pieces)), [len(p) for p in pieces]]
    keys = np.unique(hashes)
    probs = np.full((len(keys), len(languages)), 1.0 / len(keys))
    for _ in range(ROUNDS):
        expected = np.zeros_like(probs)
        for a, b in _batches(words):
            after = None  # What the next stretch passes back, in its own unit.
            for at, ends, sums, spans, on in reversed(list(_stretches(words[a:b], keys, probs))):
                last = np.arange(len(at)), ends
                back = np.zeros_like(sums)
                back[last] = counts[a + at] / sums[last]
                back[on] = 0.0
                if after is not None:
                    back[on, -after.shape[1] :] = after / sums[on][:, -1:]
                used = []
                for end, rows, lengths, at_piece, bare in reversed(spans):
                    back[bare, end - 1] += back[bare, end] * UNSEEN
                    share = probs[at_piece] * back[rows, end]
                    back[rows, end - lengths] += share
                    used.append((at_piece, sums[rows, end - lengths] * share))
                seen = np.concatenate([k for k, _ in used])
                times = np.concatenate([n for _, n in used])
                for lang in range(len(languages)):
                    expected[:, lang] += np.bincount(seen, times[:, lang], len(keys))
                after = back[:, : spans[0][0]]  # Up to the first end: what was carried.
        pooled = expected.sum(axis=1) + 0.01
        pooled /= pooled.sum()
        total = expected.sum(axis=0) + POOLED
        probs = (expected + POOLED * pooled[:, None]) / total
    own = (counts * word_scores(words, keys, probs)).sum(axis=0)
    letters = counts.T @ np.fromiter(map(len, words), float, len(words))
    return LanguageModel(tuple(languages), keys, probs, own / np.maximum(letters, 1))


def train_language(docs: DataFrame, model_file, id="doc_id", text="text", lang="lang", chars=SAMPLE_CHARS):
    """Learn from the texts of ``docs`` and their non-null ``lang``.

    Uses about ``chars`` characters per language: whole texts of any length, chosen by a hash of
    their id and text at a rate that Spark's totals per language give, and at least the one with
    the least hash; languages with less are used whole. Null texts and null languages are left
    out. Spark counts the words; the driver gets the counts of this sample, of each language the
    most frequent words up to ``chars`` characters, which only a text longer than that can pass.
    Without any usable row the model knows no language.
    """
    rows = docs.select(
        F.col(text).alias("text"),
        F.col(lang).alias("lang"),
        (F.pmod(F.xxhash64(F.col(id), F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("draw"),
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    drawn = F.when(F.col("text").rlike(r"\p{L}"), F.col("draw"))
    totals = rows.groupBy("lang").agg(
        F.sum(F.length("text")).alias("chars"), F.min(drawn).alias("least")
    )
    sizes = {r["lang"]: (r["chars"], r["least"] or 0.0) for r in totals.collect()}
    languages = sorted(name for name, (size, _) in sizes.items() if size)
    rates = {name: min(1.0, max(chars / sizes[name][0], sizes[name][1])) for name in languages}

    def count(batches):
        for batch in batches:
            words = {}
            for text, lang, draw in zip(*(c.to_pylist() for c in batch.columns)):
                if draw > rates.get(lang, -1.0):
                    continue
                for w in words_of(text):
                    words[lang, w] = words.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in words], pa.string()),
                    pa.array([k[1] for k in words], pa.string()),
                    pa.array(list(words.values()), pa.int64()),
                ],
                ["lang", "word", "n"],
            )

    least = min(1.0, max(rates.values(), default=0.0))
    frequent = (
        Window.partitionBy("lang")
        .orderBy(F.desc("n"), "word")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = (
        rows.where(F.col("draw") <= least)
        .mapInArrow(count, "lang string, word string, n long")
        .groupBy("word", "lang")
        .agg(F.sum("n").alias("n"))
        .withColumn("before", F.sum(F.length("word")).over(frequent))
        .where(F.coalesce("before", F.lit(0)) < chars)
        .drop("before")
        .toPandas()
    )
    pieces = vocabulary(model_file)
    if not len(found):
        return LanguageModel((), np.zeros(1, np.uint64), np.zeros((1, 0)))
    found = found.sort_values(["word", "lang"])
    codes, words = pd.factorize(found["word"])
    counts = np.zeros((len(words), len(languages)))
    counts[codes, found["lang"].map({n: k for k, n in enumerate(languages)})] = found["n"]
    return _fit(list(words), counts, pieces, languages)


def language_column(text, model: LanguageModel):
    """struct<lang, score, surprise> of a text column: the likeliest language and its probability.

    All languages are equally likely beforehand; ties go to the first name. A text that is null
    or has no letter is ``und`` with score 0, as is every text under a model without languages.

    score compares the learned languages alone, so a text of none of them may have any. surprise
    tells: by how much the log-probability of its letters, on average, lies below what is usual in
    that language, averaged with SHRUNK usual letters so that short texts surprise little; null
    for ``und``.
    """

    @F.arrow_udf("lang string, score double, surprise double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, scores, sizes = Codes(), np.zeros((0, len(model.languages))), np.zeros(0, np.int64)
        for column in batches:
            names, sure, odd = [], [], []
            for _, texts in text_slices(column):
                if len(table) > CACHE:
                    table, scores, sizes = Codes(), scores[:0], sizes[:0]
                words = (words_of(t) if t else [] for t in texts)
                at = [np.array(list(map(table.__getitem__, w)), np.int64) for w in words]
                if table.fresh:
                    scores = np.concatenate(
                        [scores, word_scores(table.fresh, model.keys, model.probs)]
                    )
                    fresh = np.fromiter(map(len, table.fresh), np.int64, len(table.fresh))
                    sizes = np.concatenate([sizes, fresh])
                    table.fresh.clear()
                for codes in at:
                    if not len(codes) or not model.languages:
                        names.append("und")
                        sure.append(0.0)
                        odd.append(None)
                        continue
                    total = scores[codes].sum(axis=0)
                    best = int(total.argmax())
                    names.append(model.languages[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
                    letters = int(sizes[codes].sum())
                    odd.append(float((model.usual[best] * letters - total[best]) / (letters + SHRUNK)))
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(odd, pa.float64())],
                ["lang", "score", "surprise"],
            )

    return judged(text)


def identify_language(docs: DataFrame, model: LanguageModel, id="doc_id", text="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1).

    Repeated rows give a row each, an empty table an empty one; other columns are ignored,
    whatever their names. For null texts and texts without a letter see ``language_column``.
    """
    judged = docs.select(F.col(id).alias("doc_id"), language_column(F.col(text), model).alias("judged"))
    return judged.select(
        "doc_id", F.col("judged.lang").alias("lang_pred"), F.col("judged.score").alias("score")
    )
