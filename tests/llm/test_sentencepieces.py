import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from freshet.llm import sentencepieces as pieces
from freshet.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
BITS = [" ", "  ", "   ", "\n", "\t", "a", "the", "Über", "42", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "中文", "🙂", "\x00", ".", "é"]


def texts(n=2000):
    draw = random.Random(1)
    return ["".join(draw.choice(BITS) for _ in range(draw.randrange(30))) for _ in range(n)]


def test_equals_the_library_on_whole_texts():
    some = texts()
    backend = pieces.Backend(PATH)
    for text, got, want in zip(some, backend.encode(some), SP.encode(some)):
        assert got.ids.tolist() == want, repr(text)
        assert got.agrees
    for text, ids, want in zip(some, pieces.reference_encoder(PATH)(some), SP.encode(some)):
        assert ids.tolist() == want, repr(text)


def test_whole_documents_equal_the_library(spark):
    """All documents of sf0.01, long ones included, encoded whole by SentencePiece."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in pieces.encode_documents(docs, PATH, with_ids=False).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = SP.encode(r["text"] or "")
        row = got[r["doc_id"]]
        assert (row["n_tokens"], row["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert row["agrees"] and row["decodes"] == ("▁" not in (r["text"] or ""))


def test_registered_query(spark):
    got = QUERIES["op3_sentencepiece"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_crc32", "agrees", "decodes"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r["doc_id"], len(SP.encode(r["text"] or ""))) for r in docs.select("doc_id", "text").collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want


def test_whole_texts_find_a_wrong_cut(monkeypatch):
    backend = pieces.Backend(PATH)
    monkeypatch.setattr(backend.encoder, "cut", lambda text: list(text))
    text = "the whole text"
    [wrong] = backend.encode([text])
    assert wrong.agrees and not backend.whole(text, wrong).agrees


def test_every_text_is_compared_whole(monkeypatch):
    """With a wrong cut no text of several characters agrees, whatever its hash."""
    backend = pieces.Backend(PATH)
    monkeypatch.setattr(backend.plain, "cut", lambda text: list(text))
    some = [f"the whole text {k}" for k in range(200)]
    assert not any(e.agrees or e.decodes for e in backend.compare(some))
    assert all(e.agrees and e.decodes for e in pieces.Backend(PATH).compare(some))


def test_pieces_decode_as_the_library():
    backend = pieces.Backend(PATH)
    draw = random.Random(3)
    runs = [[draw.randrange(300) if draw.random() < 0.5 else draw.randrange(len(backend.raw)) for _ in range(9)] for _ in range(3000)]
    runs += [[k] for k in range(len(backend.raw))]
    want = backend.made.decode_batch(runs, skip_special_tokens=False)
    assert backend.decode([np.array(r, np.uint32) for r in runs]) == want


def test_rebuilt_tokenizer_on_whole_texts():
    made = pieces.build(PATH)
    for text in texts(300):
        assert made.encode(text, add_special_tokens=False).ids == SP.encode(text), repr(text)


def test_decodes_as_the_library():
    some = texts()
    backend = pieces.Backend(PATH)
    ids = [e.ids for e in backend.encode(some)]
    for text, got, x in zip(some, backend.decode(ids), ids):
        assert got == SP.decode(x.tolist()), repr(text)
        if "▁" not in text:
            assert got == text


def unigram(path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    message = proto.ModelProto()
    message.trainer_spec.model_type = 1
    message.normalizer_spec.add_dummy_prefix = True
    message.normalizer_spec.escape_whitespaces = True
    message.normalizer_spec.remove_extra_whitespaces = False
    kinds = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
    kinds += [(p, s, 1) for p, s in [("▁", -2.1), ("▁a", -1.2), ("a", -2.3), ("b", -2.7), ("ab", -3.1), ("ba", -3.9), ("▁ab", -3.3)]]
    for piece, score, kind in kinds:
        message.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(message.SerializeToString())
    return str(path)


def test_unigram_models(tmp_path):
    path = unigram(tmp_path / "u.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    draw = random.Random(2)
    some = ["".join(draw.choice("ab ") for _ in range(12)).strip() or "a" for _ in range(200)]
    for text, got in zip(some, pieces.Backend(path).encode(some)):
        assert got.ids.tolist() == sp.encode(text) and got.agrees


def test_odd_rows_and_round_trip(odd_docs):
    got = pieces.encode_documents(odd_docs, PATH).collect()
    want = [(r["doc_id"], SP.encode(r["text"] or "")) for r in odd_docs.collect()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (str(i), len(ids), crc(ids)) for i, ids in want
    )
    assert all(r["agrees"] for r in got)
    assert [r["doc_id"] for r in got if not r["decodes"]] == [10]  # holds the marker itself
    back = pieces.decode_documents(pieces.encode_documents(odd_docs, PATH), PATH)
    texts = {(str(r["doc_id"]), r["text"]) for r in back.where("doc_id <> 10").collect()}
    assert texts == {
        (str(r["doc_id"]), r["text"] or "") for r in odd_docs.where(F.col("doc_id") != 10).collect()
    }
    assert pieces.encode_documents(odd_docs.limit(0), PATH).count() == 0
