import re

import numpy as np
import pytest
import xxhash

from freshet.llm import simhash
from freshet.llm.components import components


def brute_mark(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    if not grams and words:
        grams = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    marks = [brute_mark(t) for _, t in rows]
    label = list(range(len(rows)))
    while True:
        new = [
            min(label[j] for j in range(len(rows)) if (marks[i] ^ marks[j]).bit_count() <= 3)
            for i in range(len(rows))
        ]
        if new == label:
            break
        label = new
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((i, marks[k], min(ids, default=None)))
    return out


def key(row):
    return tuple(-1 if x is None else x for x in row)


def test_fingerprint_of_pieces(monkeypatch):
    text = " ".join(f"W{k % 97}x\té{k}" for k in range(500))
    whole = brute_mark(text)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert simhash.fingerprint(text) == whole


def test_groups_equal_brute_force(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [
        (r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"])
        for r in simhash.simhash_groups(odd_docs).collect()
    ]
    assert sorted(got, key=key) == sorted(brute_groups(rows), key=key)


def test_close_pairs_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    values = np.concatenate([base, near, near ^ np.uint64(0b1011)])
    for radius in (0, 1, 2, 3, 5):
        a, b = simhash.close_pairs(values, values, radius)
        want = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
        assert sorted(zip(a.tolist(), b.tolist())) == [tuple(x) for x in want.tolist()]


@pytest.mark.parametrize("n", [100, 10_000, 10**8, 10**11])
def test_masks_miss_no_pair(n):
    masks = simhash.bucket_masks(n, 3)
    rng = np.random.default_rng(2)
    for _ in range(300):
        bits = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & bits == 0 for m in masks)


def test_buckets_and_parts_equal_brute_force(spark):
    """Small buckets and parts, so that one group is compared part against part."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    marks = {centre ^ (1 << a) ^ (1 << b) for a in range(14) for b in range(a)}
    marks |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint long")
    got = {r["node"]: r["component"] for r in simhash.link_fingerprints(df, bucket=8, block=16).collect()}
    all_marks = sorted(marks)
    label = {m: m for m in all_marks}
    moved = True
    while moved:
        moved = False
        for a in all_marks:
            low = min(label[b] for b in all_marks if (a ^ b).bit_count() <= 3)
            if low < label[a]:
                label[a], moved = low, True
    assert {m: got.get(m, m) for m in all_marks} == label


def test_components_of_a_path(spark):
    edges = spark.range(60).selectExpr("id as a", "id + 1 as b").where("a <> 30")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k: 0 if k <= 30 else 31 for k in range(61)}


def test_drop_keeps_one_of_each_group(odd_docs):
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = {(i, c) for i, _, c in brute_groups(rows) if i == c}
    assert sorted(key((r["doc_id"],)) for r in kept.collect()) == sorted(key((i,)) for i, _ in want)


def test_empty_table(odd_docs):
    none = odd_docs.limit(0)
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.drop_near_copies(none).count() == 0
