"""Encode texts by their distinct segments.

Both kinds of tokenizer here never join characters across certain borders: a byte-level BPE
encodes each stretch from one white space to the next by itself, a SentencePiece BPE without
pieces that hold an inner marker each stretch from one marker to the next. A task so encodes
each distinct segment once and puts the texts' ids together from those.
"""

import re

import numpy as np

from freshet.llm.common import Codes, Ragged, slices

CACHE = 250_000  # Segments a task keeps; it then starts over. Bounds memory only.
# White space as the byte-level pattern takes it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters of which some are enough; a run of them, if something else of ASCII follows, is a token's border.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_BYTE_LEVEL = re.compile(
    f"[{_WHITE}]*(?:[{_LETTERS}]++(?=[{_WHITE}!-@\\[-`{{-~]|\\Z)|[^{_WHITE}]+)|[{_WHITE}]+"
)

_WORD = re.compile(f" ?[{_LETTERS}]+\\Z")


def is_word(segment):
    """Whether a byte-level tokenizer takes a segment as one piece to merge: letters, maybe a space before."""
    return _WORD.match(segment) is not None


def byte_level_segments(text):
    """A text cut before each run of white space, and after letters that other ASCII follows."""
    return _BYTE_LEVEL.findall(text)


class SegmentEncoder:
    """Ids of whole texts. ``cut`` gives a text's segments, ``encode`` the ids of a list of them."""

    def __init__(self, cut, encode, cache=CACHE):
        self.cut, self.encode, self.cache = cut, encode, cache
        self._clear()

    def _clear(self):
        self.table, self.ids = Codes(), Ragged(np.uint32)

    def _codes(self, texts):
        """For each text, in order, the numbers of its segments, all encoded."""
        for a, b in slices(texts):
            if len(self.table) > self.cache:
                self._clear()
            look = self.table.__getitem__
            cuts = (self.cut(t) if t else [] for t in texts[a:b])
            at = [np.fromiter(map(look, c), np.int64, len(c)) for c in cuts]
            if self.table.fresh:
                self.ids.extend(self.encode(self.table.fresh))
                self.table.fresh.clear()
            yield from at

    def __call__(self, texts):
        """For each text, in order, an array of its ids."""
        return (self.ids.gather(codes) for codes in self._codes(texts))

    def counts(self, texts):
        """For each text, in order, how many ids it has."""
        return (int(self.ids.sizes(codes).sum()) for codes in self._codes(texts))
