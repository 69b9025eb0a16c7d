"""Secrets in texts: by their shape, and by what guessing them would cost.

Three shapes are found by patterns. Values that stand where credentials stand (after a key word,
in a URL's user part, after an authorisation scheme) are then judged by dynamic programming over
guesses (after Wheeler, zxcvbn, USENIX Security 2016): the cheapest way to put a value together
from common words, dates, repeats, keyboard walks and plain characters says how many guesses it
withstands, so a placeholder such as ``changeme2024`` is left alone and a random key is not.
"""

import json
import re
from functools import lru_cache
from math import inf, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import text_slices

KINDS = ("assign", "access", "hex", "guess")  # In the order in which spans of one start are listed.
SAFE = 12.0  # Decimal digits of guesses from which a value is a secret.
SHORTEST = 6  # Characters of a value that is judged.
SEGMENT = 0.5  # Digits of guesses that each segment costs for not knowing where it ends.
SEPARATOR = 0.5  # Digits of guesses of a single character of ``-_./+ `` between segments.
AHEAD = 4096  # Places over which the search looks whether every way on is costly enough.
PERIOD = 16  # Longest part whose repeats are known.
WALK = 32  # Longest keyboard walk taken as one segment; longer ones take several.
THIS_YEAR = 2020  # Years are guessed from here outwards.

# The shapes, and the rows of the keyboard.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_LONG_HEX = re.compile("[0-9a-f]{24}")
# What a match of the patterns must hold; looked for first, as that is far quicker.
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_CONTEXT_WORDS = (
    *("passw", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access", "private"),
    *("credential", "://", "bearer", "basic"),
)
_VALUE = r"""["']?(?P<value>[^\s"'<>,;]+)"""
_CONTEXTS = [
    re.compile(
        r"""(?:passw(?:or)?d|passphrase|passwort|pwd|secret|token|api[_-]?key|access[_-]?key"""
        r"""|private[_-]?key|credentials?)["']?\x20*(?::=|=>|[:=])\x20*""" + _VALUE,
        re.IGNORECASE | re.ASCII,
    ),
    re.compile(r"://[^\s/:@]+:(?P<value>[^\s/@]+)@"),
    re.compile(r"\b(?:bearer|basic)\x20+(?P<value>[A-Za-z0-9+/_.=~-]{16,})", re.IGNORECASE | re.ASCII),
    re.compile(r"--(?:password|token|secret|api-key)[\x20=]" + _VALUE, re.IGNORECASE | re.ASCII),
]
_DATES = [
    re.compile(p)
    for p in (
        r"(?=(?P<year>1[89]\d\d|20\d\d)[-./]?(?:0?[1-9]|1[0-2])[-./]?(?:0?[1-9]|[12]\d|3[01]))",
        r"(?=(?:0?[1-9]|[12]\d|3[01])[-./]?(?:0?[1-9]|1[0-2])[-./]?(?P<year>1[89]\d\d|20\d\d))",
        r"(?=(?:0?[1-9]|1[0-2])[-./]?(?:0?[1-9]|[12]\d|3[01])[-./]?(?P<year>1[89]\d\d|20\d\d))",
    )
]
_DATE_ENDS = [re.compile(p.pattern[3:-1]) for p in _DATES]
_REFERENCE = re.compile(r"[$%]?[{(<]|\$[A-Z_]+$|%[A-Z_]+%$")  # A place to be filled in, not a value.
_YEAR = re.compile(r"(?=(1[89]\d\d|20\d\d))")


def _place(rows):
    # A key's column is shifted by half a key a row.
    return {c: (x + y / 2, y) for y, row in enumerate(rows) for x, c in enumerate(row)}


_PLACES = _place(KEYS) | _place(SHIFTED)
_STEP_COST = log10(5)  # A key has about five neighbours.


def _neighbours(a, b):
    if a in _PLACES and b in _PLACES:
        (x, y), (u, v) = _PLACES[a], _PLACES[b]
        return (x, y) != (u, v) and abs(y - v) <= 1 and abs(x - u) <= 1
    return False


class Guesses:
    """Costs of values, by a vocabulary of common words, most common first."""

    def __init__(self, words):
        self.cost = {}
        for rank, word in enumerate(words, 1):
            self.cost.setdefault(word, log10(rank + 1))
        self.longest = max(map(len, self.cost), default=0)

    def _words(self, value):
        """(start, end, cost) of each stretch that is a word, in any case and usual spellings."""
        low = value.lower()
        if len(low) != len(value):
            low = value
        plain = "".join(LEET.get(c, c) for c in low)
        for i in range(len(value)):
            for j in range(i + 3, min(i + self.longest, len(value)) + 1):
                cost = self.cost.get(low[i:j])
                if cost is None:
                    cost = self.cost.get(plain[i:j])
                    if cost is None:
                        continue
                    swapped = sum(a != b for a, b in zip(low[i:j], plain[i:j]))
                    cost += log10(2) * swapped
                part = value[i:j]
                if part != low[i:j]:
                    # A capital first letter, or all capitals, is one guess more; others as many as capitals.
                    capitals = sum(a != b for a, b in zip(part, low[i:j]))
                    usual = part[1:] == low[i + 1 : j] or part.isupper()
                    cost += log10(2) * (1 if usual else capitals + 1)
                yield i, j, cost

    def _dates(self, value):
        for starts, ends in zip(_DATES, _DATE_ENDS):
            for m in starts.finditer(value):
                found = ends.match(value, m.start())
                away = max(20, abs(int(found["year"]) - THIS_YEAR))
                apart = log10(4) if found.end() - found.start() > 8 else 0
                yield found.start(), found.end(), log10(365 * away) + apart
        for m in _YEAR.finditer(value):
            yield m.start(), m.start() + 4, log10(max(20, abs(int(m[1]) - THIS_YEAR)))

    def _repeats(self, value):
        """Maximal stretches that repeat a part of up to PERIOD characters."""
        codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
        for period in range(1, min(PERIOD, len(codes) // 2) + 1):
            same = np.concatenate([[False], codes[period:] == codes[:-period], [False]])
            edges = np.flatnonzero(np.diff(same.astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                times = (b - a) // period + 1
                if times >= 2 and times * period >= 3:
                    base = self.least(value[a : a + period], repeats=False)
                    yield a, a + times * period, base + log10(times)

    @staticmethod
    def _walks(value):
        """Stretches of keys each beside the one before, or of characters in code order."""
        start = 0
        kinds = (_neighbours, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1)
        for kind, beside in enumerate(kinds):
            start = 0
            for k in range(1, len(value) + 1):
                if k < len(value) and beside(value[k - 1], value[k]):
                    continue
                yield from Guesses._parts(value, start, k, kind == 0)
                start = k

    @staticmethod
    def _parts(value, start, end, keys):
        for i in range(start, end - 2):
            turns, last = 0, None
            for j in range(i + 1, min(end, i + WALK)):
                if keys:
                    (x, y), (u, v) = _PLACES[value[j - 1]], _PLACES[value[j]]
                    way = (u - x, v - y)
                    turns += way != last
                    last = way
                if j - i >= 2:
                    length = log10(j - i + 1)
                    yield i, j + 1, log10(47) + length + _STEP_COST * turns if keys else log10(26) + length

    def least(self, value, enough=inf, repeats=True):
        """Decimal digits of the guesses that the cheapest segmentation of ``value`` takes.

        Where that is over ``enough``, a smaller figure that is at least ``enough`` may be given:
        the search ends once every way on is that costly.
        """
        n = len(value)
        if not n:
            return 0.0
        classes = (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26))
        size = sum(k for a, b, k in classes if any(a <= c <= b for c in value))
        if any(not (c.isascii() and c.isalnum()) for c in value):
            size += 33
        single = log10(size)
        spans = [*self._dates(value), *self._walks(value)]
        if repeats:
            spans += self._repeats(value)
        ways = {}
        for i, j, cost in spans:
            ways.setdefault(i, []).append((j, cost))
        words = iter(self._words(value))
        word = next(words, None)
        # By place: the least cost of a way that ends there with a pattern, and with plain characters.
        best, plain = [inf] * (n + 1), [inf] * (n + 1)
        best[0] = 0.0
        reach = 0
        for i in range(n):
            here = min(best[i], plain[i])
            if i % 32 == 0 and here >= enough and reach < i + AHEAD:
                open_ways = min(plain[i], *best[i : reach + 1], here)
                if open_ways >= enough:
                    return open_ways
            plain[i + 1] = min(plain[i], best[i] + (SEGMENT if i else 0.0)) + single
            begin = here + (SEGMENT if i else 0.0)
            if value[i] in "-_./+ " and begin + SEPARATOR < best[i + 1]:
                best[i + 1] = begin + SEPARATOR
                reach = max(reach, i + 1)
            for j, cost in ways.get(i, ()):
                if begin + cost < best[j]:
                    best[j] = begin + cost
                    reach = max(reach, j)
            while word and word[0] == i:
                if begin + word[2] < best[word[1]]:
                    best[word[1]] = begin + word[2]
                    reach = max(reach, word[1])
                word = next(words, None)
        return min(best[n], plain[n])


def common_words(path):
    """Whole words of a BPE vocabulary file, in the order they were learned, so most common first."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    marked = ((k, w.removesuffix("</w>")) for w, k in vocabulary.items() if w.endswith("</w>"))
    return [w for k, w in sorted(marked) if len(w) >= 3 and w.isalpha()]


@lru_cache(maxsize=2)
def _guesses(path):
    return Guesses(common_words(path))


def base_spans(text, low):
    """(kind, start, end) of the three shapes, by kind, each leftmost first and not overlapping.

    ``low`` is the text in lower case.
    """
    if any(w in low for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield "access", m.start(), m.end()
    # A run of 24 is looked for first; the run itself is then taken from its first character.
    at = _LONG_HEX.search(text)
    while at:
        m = _HEX.match(text, at.start())
        yield "hex", m.start(), m.end()
        at = _LONG_HEX.search(text, m.end())


def credential_values(text, low):
    """(start, end) of values where credentials stand, without a full stop or bracket at their end.

    ``low`` is the text in lower case.
    """
    if not any(w in low for w in _CONTEXT_WORDS):
        return
    seen = set()
    for pattern in _CONTEXTS:
        for m in pattern.finditer(text):
            start, end = m.span("value")
            end = start + len(text[start:end].rstrip(".:!?)]}"))
            if end - start >= SHORTEST and (start, end) not in seen and not _REFERENCE.match(text, start, end):
                seen.add((start, end))
                yield start, end


def spans_of(text, guesses, safe=SAFE, known=None):
    """All spans of a text by start and kind: (kind, start, end, cost), cost null but for ``guess``."""
    if not text:
        return []
    low = text.lower()
    out = [(kind, a, b, None) for kind, a, b in base_spans(text, low)]
    known = {} if known is None else known
    for a, b in credential_values(text, low):
        value = text[a:b]
        if value not in known:
            if len(known) > 10_000:
                known.clear()
            known[value] = guesses.least(value, enough=safe)
        if known[value] >= safe:
            out.append(("guess", a, b, known[value]))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


_SPANS = "array<struct<kind:string,start:int,end:int,cost:double>>"


def spans_column(text: Column, words, safe=SAFE) -> Column:
    """Array of spans of a text column; ``words`` is the path of the vocabulary file."""

    @F.arrow_udf(_SPANS)
    def spans(column: pa.Array) -> pa.Array:
        guesses, known = _guesses(words), {}
        rows = [spans_of(t, guesses, safe, known) for _, texts in text_slices(column) for t in texts]
        flat = [s for row in rows for s in row]
        kinds, starts, ends, costs = zip(*flat) if flat else ([], [], [], [])
        values = pa.StructArray.from_arrays(
            [
                pa.array(kinds, pa.string()),
                pa.array(starts, pa.int32()),
                pa.array(ends, pa.int32()),
                pa.array(costs, pa.float64()),
            ],
            ["kind", "start", "end", "cost"],
        )
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)

    return spans(text)


def find_secrets(docs: DataFrame, words, id="doc_id", text="text", safe=SAFE) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end, cost).

    Kinds: assign (a key word, a sign and a value, the whole of it), access and hex (keys of that
    shape), guess (a value where a credential stands, whose guesses have at least ``safe``
    decimal digits; cost says how many at least). Places are code points, end exclusive. Spans
    of different kinds may overlap; they are in order of start, then kind as listed, then end.

    A null or empty text has no spans. Values of any length are judged whole. Null ids and
    repeated rows give a row each, an empty table an empty one; other columns are ignored,
    whatever their names.
    """
    return docs.select(F.col(id).alias("doc_id"), spans_column(F.col(text), words, safe).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
