import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from freshet.llm import bloom, spelling
from freshet.llm.queries import QUERIES
from freshet.storage import stage


def texts(n, seed):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(4, 9))) for _ in range(60)]
    for _ in range(n):
        out = []
        for _ in range(draw.randrange(5, 120)):
            word = draw.choice(stems[: draw.choice([6, 60])])
            if draw.random() < 0.3:
                at = draw.randrange(len(word))
                word = word[:at] + draw.choice(["", "b", "ÿ", "à"]) + word[at + draw.choice([0, 1]) :]
            out.append(word.upper() if draw.random() < 0.1 else word)
        yield draw.choice([" ", "-", "œ", "\n"]).join(out)


def lower(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def brute_words(rows, typos, letters=6, least=5):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if typos and h % typos == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows, typos, ratio=5):
    words = brute_words(rows, typos)
    beside = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, some in beside.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(beside[w]), words.get(form[w])))
    return sorted(out)


def key(r):
    return r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]


def rows_of(n, seed):
    rows = list(enumerate(texts(n, seed)))
    return [*rows, (n, None), (n + 1, ""), (None, rows[0][1]), rows[1], rows[1], (n + 2, "abcdeabcde " * 20_000)]


def test_registered_query(spark, tmp_path):
    rows = rows_of(400, 3)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(key, QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()), key=lambda r: r[0])
    want = brute(rows, 199)
    assert got == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] for r in want if r[1])


@pytest.mark.parametrize("limit", [32, 96, 4096])
def test_any_number_of_passes_finds_the_same(spark, limit):
    rows = rows_of(120, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = stage(spelling.count_words(docs), "words")
    sizes = {r["s"]: r["n"] for r in vocabulary.selectExpr("length(word) as s").groupBy("s").count().selectExpr("s", "count as n").collect()}
    if limit == 32:
        assert any(slices > 1 for some in spelling.filter_passes(sizes, limit) for _, _, slices in some)
    got = sorted(map(key, spelling.spelling_variants(docs, limit=limit).collect()), key=lambda r: r[0])
    assert got == brute(rows, None)


def test_each_pair_is_generated_once():
    words = sorted({"".join(w) for w in __import__("itertools").product("ab", repeat=3)} | {"aa", "ab", "aab", "abba", "a"})
    known = set(words)
    alphabet = np.array(sorted(map(ord, "ab")), np.uint64)
    seen = Counter()
    for k, edit in spelling.edits_in(words, alphabet, lambda length, keys: np.ones(len(keys), bool)):
        if edit in known:
            seen[frozenset((words[k], edit))] += 1
    assert set(seen.values()) == {1}
    assert set(seen) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_keys_of_edits_are_those_of_the_words():
    words = ["straße", "ünïçode", "a" * 40, "zebra"]
    alphabet = np.array(sorted(set(map(ord, "abzü"))), np.uint64)
    asked = []

    def holds(length, keys):
        asked.extend((length, int(k)) for k in keys)
        return np.ones(len(keys), bool)

    edits = [e for _, e in spelling.edits_in(words, alphabet, holds)]
    assert sorted(asked) == sorted((len(e), int(k)) for e, k in zip(edits, spelling.word_keys(edits)))


def test_filters_hold_all_and_little_else(spark):
    n = 40_000
    keys = bloom.mix(np.arange(n, dtype=np.uint64))
    rows = spark.createDataFrame([(int(k % 3), int(x)) for k, x in enumerate(keys.view(np.int64))], "shard int, key long")
    blocks = {s: bloom.blocks_for(-(-n // 3)) for s in range(3)}
    filters = bloom.build(rows, blocks)
    for s in range(3):
        assert filters.holds(s, keys[s::3]).all()
    others = bloom.mix(np.arange(n, 40 * n, dtype=np.uint64))
    assert filters.holds(0, others).mean() < 0.002
    assert not filters.holds(9, others).any()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0
