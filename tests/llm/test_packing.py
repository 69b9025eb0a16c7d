import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from freshet.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole_ids(text):
    made = Tokenizer.from_file(PATH)
    return made.encode(text or "", add_special_tokens=False).ids


def test_segments_equal_whole_texts():
    draw = random.Random(1)
    bits = [" ", "  ", "\n", "\t", " ", "\x1c", "\xa0", " ", "a", "Bé", "'s", "'", "42", "!?", "<|endoftext|>", "中文", "🙂", "\x00", "​"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(3000)]
    got = packing.text_encoder(PATH)(texts)
    made = Tokenizer.from_file(PATH)
    for text, ids, want in zip(texts, got, made.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, repr(text)


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_come_back(odd_docs):
    got = packing.pack_documents(odd_docs, PATH, capacity=128, with_ids=True).collect()
    sequences = check_packed(got, 128)
    assert sequences <= -(-sum(r["length"] for r in got) // 128) + 2
    want = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], whole_ids(r["text"]) + [2]) for r in odd_docs.collect()
    )
    docs = {}
    for r in sorted(got, key=lambda r: (r["piece"], r["sequence_id"])):
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        docs.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append(r)
    for i, ids in want:
        mine = docs[i]
        pieces = max(1, -(-len(ids) // 128))
        copies = sum(1 for k, _ in want if k == i)
        if copies == 1:
            assert sum((r["ids"] for r in mine), []) == ids
            assert [r["start"] for r in mine] == [a for a, _ in packing.cuts(len(ids), 128)]
            assert len(mine) == pieces
    assert len(got) == sum(len(packing.cuts(len(ids), 128)) for _, ids in want)


def test_cuts():
    assert packing.cuts(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(3, 4) == [(0, 3)]


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_the_histogram(seed):
    draw = random.Random(seed)
    capacity = 64
    histogram = {k: draw.randrange(1, 400) for k in draw.sample(range(1, 65), draw.randrange(1, 60))}
    plan = packing.patterns_for(histogram, capacity)
    held = {}
    for sizes, n in plan:
        assert n > 0 and sum(sizes) <= capacity
        for s in sizes:
            held[s] = held.get(s, 0) + n
    assert held == histogram
    simple = sum(n for _, n in packing.best_fit(list(histogram), list(histogram.values()), capacity))
    assert sum(n for _, n in plan) <= simple


def test_patterns_that_leave_room_are_fitted():
    """No three of these fill a sequence; 72,500 sequences are the least possible."""
    plan = packing.patterns_for({300: 100_000, 400: 50_000, 700: 30_000}, 1024)
    assert 72_500 <= sum(n for _, n in plan) <= 72_510
    held = {k: sum(n * sizes.count(k) for sizes, n in plan) for k in (300, 400, 700)}
    assert held == {300: 100_000, 400: 50_000, 700: 30_000}


def test_few_patterns_are_pairs_with_the_longest_third():
    lengths = [2, 3, 5, 8]
    rows = {tuple(lengths[k] for k in r if k >= 0) for r in packing.few_patterns(lengths, 10).tolist()}
    assert rows == {(8, 2), (5, 5), (5, 3, 2), (5, 2, 2), (3, 3, 3), (3, 2, 2), (2, 2, 2)}
    assert packing.few_patterns([10], 10).tolist() == [[0, -1, -1]]


def test_clashing_columns_are_kept(spark):
    names = ("rank", "before", "placed", "row", "bucket", "piece_row", "count")
    pieces = spark.range(200).selectExpr("id", "id % 60 + 1 as length", *(f"'{n}' as {n}" for n in names), "7 as offset")
    got = packing.pack(pieces, capacity=64)
    assert got.columns == ["id", "length", *names, "sequence_id", "offset"]
    rows = got.collect()
    check_packed(rows, 64)
    assert len(rows) == 200 and all(r[n] == n for r in rows for n in names)


def test_one_length_ranked_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    pieces = spark.range(1000).selectExpr("id as doc_id", "cast(if(id % 3 = 0, 100, id % 90 + 1) as long) as length")
    got = packing.pack(pieces, capacity=200).collect()
    assert len(got) == 1000 and len({r["doc_id"] for r in got}) == 1000
    check_packed(got, 200)


def test_empty_table(odd_docs):
    assert packing.pack_documents(odd_docs.limit(0), PATH).count() == 0
