"""Registered queries without SQL against brute force, over the smallest tables."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from freshet.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def fold(id, parts):
    return zlib.crc32(str(id).encode()) % parts


def test_every_dealt_operator_is_registered():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_op5_folds_and_accuracy(spark, small_dir, docs):
    rows = QUERIES["op5_language_id"](spark, small_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    judged = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean(judged) >= 0.97


def test_op7_pieces_and_places(spark, small_dir, docs):
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op7_packing"](spark, small_dir).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sorted(pieces) == sorted(docs)
    total = 0
    for id, text in docs.items():
        ids = np.array([*made.encode(text, add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        mine = sorted(pieces[id], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        at = 0
        for k, r in enumerate(mine):
            assert r["start"] == at and 1 <= r["length"] <= 1024
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == 1024 or len(mine) == 1
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(mine) == 1)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(sequences) <= 1.05 * -(-total // 1024) + 1


def test_op8_fingerprints_and_components(spark, small_dir, docs):
    def mark(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        bits = Counter(b for g in grams for b in range(64) if xxh64_intdigest(g.encode(), 42) >> b & 1)
        return sum(1 << b for b, n in bits.items() if 2 * n > len(grams))

    marks = {id: mark(t) for id, t in docs.items()}
    ids = sorted(marks)
    values = np.array([marks[i] for i in ids], np.uint64)
    label = list(range(len(ids)))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    moved = True
    while moved:
        new = [min(label[j] for j in np.flatnonzero(near[k])) for k in range(len(ids))]
        moved, label = new != label, new
    want = sorted((i, f"{marks[i]:016x}", ids[label[k]]) for k, i in enumerate(ids))
    got = QUERIES["op8_simhash"](spark, small_dir).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == want


def test_op9_folds_and_held_out_rows(spark, small_dir, docs):
    rows = QUERIES["op9_toxicity"](spark, small_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op10_counts(spark, small_dir, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in docs.items()]
    got = QUERIES["op10_token_counts"](spark, small_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline_is_its_stages(spark, small_dir, docs):
    """Every document that was neither toxic, strange nor a copy is packed whole, once."""
    rows = QUERIES["pipeline"](spark, small_dir).collect()
    toxic = {r["doc_id"] for r in QUERIES["op9_toxicity"](spark, small_dir).collect() if r["predicted"]}
    whole = {r["doc_id"]: 0 for r in rows}
    for r in rows:
        whole[r["doc_id"]] += r["length"]
    assert not toxic & set(whole)
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for id, n in whole.items():
        assert n == len(made.encode(docs[id], add_special_tokens=False).ids) + 1
    lettered = {i for i, t in docs.items() if re.search(r"[^\W\d_]", t)}
    assert set(whole) <= lettered - toxic
    copies = {}
    for r in QUERIES["op8_simhash"](spark, small_dir).collect():
        copies.setdefault(r["component_id"], set()).add(r["doc_id"])
    for some in copies.values():
        if some <= lettered - toxic:
            assert len(some & set(whole)) == 1 and min(some) in whole
