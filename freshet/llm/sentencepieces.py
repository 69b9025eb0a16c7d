"""SentencePiece models run by the tokenizers library.

The model file's protobuf gives pieces, scores, normaliser and flags; from these the same
tokenizer is built there: normaliser, marker for spaces, merges or unigram scores, byte
fallback, decoder. Texts are encoded by their distinct segments; every text is encoded whole by
SentencePiece too, the ids are compared, and all of them are decoded again.
"""

import hashlib
import os
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from freshet.llm.common import text_slices
from freshet.llm.segments import SegmentEncoder

MARK = "▁"
THREADS = 2  # Of the library, for one task's batch.
# Fixed values of the format: kinds of model and of piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def parse(path):
    """The model file's protobuf message."""
    message = proto.ModelProto()
    with open(path, "rb") as file:
        message.ParseFromString(file.read())
    return message


def separable(message):
    """Whether each run of markers and what follows it is encoded by itself.

    It is where pieces are merged from characters, none holds a marker after another character,
    and the normaliser changes nothing but spaces.
    """
    trainer, normalizer = message.trainer_spec, message.normalizer_spec
    return (
        trainer.model_type == BPE
        and not normalizer.precompiled_charsmap
        and normalizer.add_dummy_prefix
        and normalizer.escape_whitespaces
        and not normalizer.remove_extra_whitespaces
        and not trainer.treat_whitespace_as_suffix
        and not any(p.type == USER or MARK in p.piece.lstrip(MARK) for p in message.pieces)
        and any(p.piece == MARK and p.type == NORMAL for p in message.pieces)
    )


def _merges(pieces):
    """Pairs of pieces, best first, whose union is a piece."""
    ids = {p.piece: k for k, p in enumerate(pieces) if p.type in (NORMAL, USER)}
    found = []
    for p in pieces:
        if p.type == NORMAL:
            for k in range(1, len(p.piece)):
                left, right = p.piece[:k], p.piece[k:]
                if left in ids and right in ids:
                    found.append((-p.score, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(path) -> Tokenizer:
    """The model file's tokenizer, rebuilt; it adds no special tokens by itself."""
    message = parse(path)
    pieces, rules, trainer = message.pieces, message.normalizer_spec, message.trainer_spec
    unknown = next((k for k, p in enumerate(pieces) if p.type == UNKNOWN), 0)
    fallback = any(p.type == BYTE for p in pieces)
    if trainer.model_type == BPE:
        made = Tokenizer(
            models.BPE(
                vocab={p.piece: k for k, p in enumerate(pieces)},
                merges=_merges(pieces),
                unk_token=pieces[unknown].piece,
                fuse_unk=True,
                byte_fallback=fallback,
            )
        )
    elif trainer.model_type == UNIGRAM:
        reachable = (NORMAL, USER, UNKNOWN)
        scored = [(p.piece, p.score if p.type in reachable else -1e6) for p in pieces]
        made = Tokenizer(models.Unigram(scored, unk_id=unknown, byte_fallback=fallback))
    else:
        raise ValueError("only BPE and unigram models can be rebuilt")
    steps = []
    if rules.precompiled_charsmap:
        steps.append(normalizers.Precompiled(rules.precompiled_charsmap))
    if rules.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if rules.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if rules.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    made.normalizer = normalizers.Sequence(steps)
    if separable(message):
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    made.decoder = decoders.Sequence(
        [
            decoders.Replace(MARK, " "),
            decoders.ByteFallback(),
            decoders.Fuse(),
            *([decoders.Strip(" ", 1, 0)] if rules.add_dummy_prefix else []),
        ]
    )
    return made


_SPACED = re.compile(" +[^ ]*")


def cut(text):
    """Segments of a text, each from one space to the next, without the space that opens it.

    The model puts a marker before the text and reads spaces and markers alike.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    parts = text.split(" ")
    # Spaces in a row belong to the segment that they open.
    return [s[1:] for s in _SPACED.findall(" " + text)] if "" in parts else parts


def digest(path):
    """Names the model file and the libraries that read it."""
    with open(path, "rb") as file:
        said = hashlib.sha256(file.read())
    said.update(f"sentencepiece {sentencepiece.__version__}".encode())
    return said.hexdigest()


def reference_encoder(path):
    """SentencePiece itself, as a function from a list of texts to arrays of ids."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if not separable(parse(path)):
        return lambda texts: (
            np.array(ids, np.uint32) for ids in sp.encode([t or "" for t in texts], num_threads=1)
        )
    alone = [sp.piece_to_id(MARK)]

    def encode(segments):
        return [x if s else alone for s, x in zip(segments, sp.encode(segments, num_threads=1))]

    return SegmentEncoder(cut, encode)


@dataclass
class Encoded:
    ids: np.ndarray
    agrees: bool
    decodes: bool


AGREES, DECODES = 1, 2


class _Checked(SegmentEncoder):
    """Keeps, beside the ids of each segment, what its checks gave; ``encode`` gives both."""

    def __init__(self, cut, encode):
        super().__init__(cut, self._encode)
        self.checked = encode

    def _clear(self):
        super()._clear()
        self.flags = np.zeros(0, np.uint8)

    def _encode(self, segments):
        ids, flags = self.checked(segments)
        self.flags = np.concatenate([self.flags, np.array(flags, np.uint8)])
        return ids

    def documents(self, texts):
        """For each text, in order, its ids and what holds of all its segments."""
        for codes in self._codes(texts):
            held = np.bitwise_and.reduce(self.flags[codes], initial=AGREES | DECODES)
            yield self.ids.gather(codes), int(held)


class Backend:
    """Encodes and decodes by the rebuilt tokenizer, and compares it with SentencePiece."""

    def __init__(self, path, threads=THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.threads = threads
        self.made = build(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        message = parse(path)
        self.apart = separable(message)
        self.raw = [_piece_bytes(p.piece) for p in message.pieces]
        self.alone = [self.sp.piece_to_id(MARK)]
        # A segment is marked and cut already: this one only merges.
        self.merger = build(path)
        self.merger.normalizer = self.merger.pre_tokenizer = None
        self.plain = SegmentEncoder(cut, self._merged)
        self.encoder = _Checked(cut, self._segments)

    def _merged(self, segments):
        """Ids of segments."""
        marked = [MARK + s.replace(" ", MARK) for s in segments]
        return [e.ids for e in self.merger.encode_batch_fast(marked, add_special_tokens=False)]

    def _segments(self, segments):
        """Ids of segments, and whether the libraries agree on each and its ids give it again."""
        ours = [e.ids for e in self.made.encode_batch_fast(segments, add_special_tokens=False)]
        theirs = self.sp.encode(segments, num_threads=self.threads)
        flags = [AGREES * (a == b) for a, b in zip(ours, theirs)]
        ours = [x if s else self.alone for s, x in zip(segments, ours)]
        back = self.made.decode_batch(ours, skip_special_tokens=False)
        return ours, [f | DECODES * (s == t) for f, s, t in zip(flags, segments, back)]

    def encode(self, texts):
        """For each text its ids, whether SentencePiece gives the same ones, and whether they give the
        text again; both by segments where the model encodes these by themselves."""
        if self.apart:
            for text, (ids, held) in zip(texts, self.encoder.documents(texts)):
                # A marker in the text itself is decoded as the space that it is read as.
                decodes = bool(held & DECODES) and not (text and MARK in text)
                yield Encoded(ids, bool(held & AGREES), decodes)
            return
        whole = [t or "" for t in texts]
        ours = [e.ids for e in self.made.encode_batch_fast(whole, add_special_tokens=False)]
        theirs = self.sp.encode(whole, num_threads=self.threads)
        back = self.made.decode_batch(ours, skip_special_tokens=False)
        for text, a, b, t in zip(whole, ours, theirs, back):
            yield Encoded(np.array(a, np.uint32), a == b, t == text)

    def compare(self, texts):
        """For each text its ids, whether SentencePiece gives the same ones for the whole text, and
        whether they, all decoded again, give the text."""
        whole = [t or "" for t in texts]
        if not self.apart:
            return list(self.encode(whole))
        ours = list(self.plain(whole))
        theirs = self.sp.encode(whole, num_threads=self.threads)
        agree = [np.array_equal(x, np.array(y, np.uint32)) for x, y in zip(ours, theirs)]
        back = self.decode(ours)
        return [Encoded(x, a, t == b) for x, a, t, b in zip(ours, agree, whole, back)]

    def whole(self, text, encoded):
        """The same result after the whole text was encoded by SentencePiece and its ids decoded."""
        agrees = encoded.agrees and self.sp.encode(text) == encoded.ids.tolist()
        [back] = self.decode([encoded.ids])
        return Encoded(encoded.ids, agrees, encoded.decodes and back == text)

    def decode(self, ids):
        """The text of each array of ids.

        Where segments are encoded by themselves, the decoder joins the pieces' bytes and drops the
        space that the model puts before a text. Bytes that are no text are left to the library.
        """
        if not self.apart:
            return self.made.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        return [self._joined(x.tolist()) for x in ids]

    def _joined(self, ids):
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.made.decode(ids, skip_special_tokens=False)
        return text[1:] if text.startswith(" ") else text


_BYTE = re.compile("<0x([0-9A-Fa-f]{2})>")


def _piece_bytes(piece):
    """What the decoder makes of a piece: its byte, or its text with spaces for markers."""
    byte = _BYTE.fullmatch(piece)
    return bytes.fromhex(byte[1]) if byte else piece.replace(MARK, " ").encode()


@lru_cache(maxsize=1)
def _backend(model):
    """Kept by a worker from task to task: its segments stay encoded."""
    return Backend(model)


def _crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_documents(docs: DataFrame, model, id="doc_id", text="text", with_ids=True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_crc32, agrees, decodes (and ids).

    agrees: SentencePiece gives the same ids. decodes: the ids, decoded again, give the text; a
    text that holds the marker character itself does not, as the marker stands for a space. Both
    are checked on every whole text. ids_crc32 is over little-endian unsigned 32-bit ids. A null
    text is encoded as empty, without ids. Repeated rows give a row each, an empty table an empty
    one; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, agrees boolean, decodes boolean" + (
        ", ids array<int>" if with_ids else ""
    )

    def run(batches):
        backend = _backend(model)
        for batch in batches:
            for k, texts in text_slices(batch.column(1)):
                encoded = backend.compare(texts)
                columns = [
                    batch.column(0).slice(k, len(texts)),
                    pa.array([len(e.ids) for e in encoded], pa.int64()),
                    pa.array([_crc(e.ids) for e in encoded], pa.int64()),
                    pa.array([e.agrees for e in encoded], pa.bool_()),
                    pa.array([e.decodes for e in encoded], pa.bool_()),
                ]
                if with_ids:
                    columns.append(pa.array([e.ids.astype(np.int32) for e in encoded], pa.list_(pa.int32())))
                names = re.findall(r"(\w+) (?:array<int>|\w+)", schema)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model, id="doc_id", ids="ids") -> DataFrame:
    """doc_id and text of rows of ids; null or no ids give an empty text. A null id is left out of its row."""
    kind = encoded.schema[id].dataType.simpleString()

    def run(batches):
        backend = _backend(model)
        for batch in batches:
            rows = [
                np.array([x for x in r or [] if x is not None], np.uint32)
                for r in batch.column(1).to_pylist()
            ]
            texts = backend.decode(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.select(F.col(id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, text string"
    )
