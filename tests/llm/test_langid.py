from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from freshet.llm import langid

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_probability(word, probs):
    """Sum over all cuts of the marked word, one by one."""
    total = 0.0
    for ends in product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for k, cut in enumerate((*ends, 1)):
            if cut:
                parts.append(word[start : k + 1])
                start = k + 1
        p = 1.0
        for part in parts:
            p *= probs.get(part, langid.UNSEEN if len(part) == 1 and part not in probs else 0.0)
        total += p
    return total


def test_forward_sums_all_cuts():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "c"]
    rng = np.random.default_rng(4)
    p = rng.random((len(pieces), 2))
    _, sums = langid._prefix_hashes(pieces)
    hashes = sums[np.arange(len(pieces)), [len(x) for x in pieces]]
    order = np.argsort(hashes)
    words = ["abab", "cab", "zab", "a", "bbbabacab"]
    got = langid.word_scores(words, hashes[order], p[order])
    for k, w in enumerate(words):
        for lang in range(2):
            want = brute_probability("▁" + w, dict(zip(pieces, p[:, lang])))
            assert np.exp(got[k, lang]) == pytest.approx(want, rel=1e-9)


def test_long_words_are_scored_whole():
    pieces = langid.vocabulary(MODEL)
    model = langid._fit(["hello", "bonjour"], np.array([[3.0, 0], [0, 3.0]]), pieces, ["en", "fr"])
    a, b = langid.word_scores(["x" * 30 + "hello", "x" * 30], model.keys, model.probs)
    assert (a < b).all()
    np.testing.assert_allclose(model.probs.sum(axis=0), 1.0)


def test_long_pieces_are_in_the_vocabulary():
    pieces = set(langid.vocabulary(MODEL))
    assert {"▁information", "▁function", "▁important"} <= pieces
    assert max(map(len, pieces)) == langid.LONGEST_PIECE


def test_pieces_across_stretches_count(monkeypatch):
    """Words of many stretches are scored and learned from as if they were summed at once."""
    pieces = ["▁", "a", "b", "ab", "abababababababab", "bbbbbbbbbb", "▁ba", "aba"]
    words = ["ab" * 90, "b" * 60, "z" * 30 + "ab" * 20, "ab", "a" * 23, "a" * 24, "ba" * 12]
    counts = np.array([[3.0, 1], [0, 2], [1, 1], [5, 0], [1, 0], [2, 2], [0, 4]])
    got = langid._fit(words, counts, pieces, ["x", "y"])
    scores = langid.word_scores(words, got.keys, got.probs)
    probs = np.random.default_rng(1).uniform(0.2, 1, got.probs.shape)
    wanted = langid.word_scores(words, got.keys, probs)
    cut = langid.word_scores(["b" * 24, "b" * 36], got.keys, probs)
    assert (np.abs(cut.sum(axis=0) - wanted[1]) > 0.01).all()  # not a product of its stretches
    monkeypatch.setattr(langid, "STRETCH", 1_000)
    np.testing.assert_allclose(wanted, langid.word_scores(words, got.keys, probs), rtol=1e-9)
    whole = langid._fit(words, counts, pieces, ["x", "y"])
    np.testing.assert_allclose(got.probs, whole.probs, rtol=1e-9)
    np.testing.assert_allclose(scores, langid.word_scores(words, got.keys, whole.probs), rtol=1e-9)


def test_very_long_words_keep_finite_scores():
    pieces = langid.vocabulary(MODEL)
    model = langid._fit(["hello", "bonjour" * 3_000], np.array([[3.0, 0], [0, 3.0]]), pieces, ["en", "fr"])
    got = langid.word_scores(["bonjour" * 3_000, "ж" * 20_000], model.keys, model.probs)
    assert np.isfinite(got).all() and got[0, 1] > got[0, 0]
    np.testing.assert_allclose(model.probs.sum(axis=0), 1.0)


def test_held_out_accuracy(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    model = langid.train_language(docs.where("doc_id % 4 <> 2"), MODEL, chars=100_000)
    got = langid.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.where("doc_id % 4 = 2").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(0 < r["score"] <= 1 for r in rows)


def test_languages_of_long_texts_are_learned(spark):
    long = "xilo vanta morek " * 13_000
    rows = [(1, "the cat and the dog", "en"), (2, long, "xx"), (3, long + "more", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_language(docs, MODEL, chars=10_000)
    assert model.languages == ("en", "xx")
    got = langid.identify_language(docs, model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "en", 2: "xx", 3: "xx"}


def test_rows_without_id_are_drawn_one_by_one(spark, monkeypatch):
    docs = spark.range(2_000).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.format_string("word %s", F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"),
        F.lit("en").alias("lang"),
    )
    seen = {}
    monkeypatch.setattr(langid, "_fit", lambda words, counts, *_: seen.update(zip(words, counts[:, 0])))
    langid.train_language(docs, MODEL, chars=4_000)
    assert 300 < seen["word"] < 700


def test_odd_rows(odd_docs):
    model = langid.train_language(odd_docs, MODEL, chars=10_000)
    assert set(model.languages) <= {"en", "de", "fr"}
    got = langid.identify_language(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    for i in (4, 5, 6, 8):
        assert [(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == i] == [("und", 0.0)]
    assert langid.identify_language(odd_docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(odd_docs):
    model = langid.train_language(odd_docs.limit(0), MODEL)
    assert {r["lang_pred"] for r in langid.identify_language(odd_docs, model).collect()} == {"und"}


def test_numbers_are_no_letters_and_marks_stay_on_words():
    assert langid.words_of("½ ² Ⅷ ① 42 _") == []
    assert langid.words_of("Ünïcode e\u0301t\u0301a हिन्दी x2y") == ["ünïcode", "e\u0301t\u0301a", "हिन्दी", "x", "y"]
    assert langid.words_of("plain 𝒳𝒴 𐐀b") == ["plain", "𝒳𝒴", "𐐨b"]
    assert langid.words_of("\u0301a") == ["a"]


def test_texts_of_number_signs_are_und_and_noise_surprises(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    model = langid.train_language(docs, MODEL)
    rows = ["½²Ⅷ", "①②", "这是一个中文句子", "Αυτό είναι ένα κείμενο", "qjfwx gkvzq hhjkl wqpvx zxcvb nmqwx"]
    rows = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = rows.withColumn("j", langid.language_column(F.col("text"), model)).orderBy("doc_id").collect()
    assert [(r.j.lang, r.j.score, r.j.surprise) for r in got[:2]] == [("und", 0.0, None)] * 2
    assert all(r.j.surprise > 3.5 for r in got[2:])
    usual = docs.withColumn("j", langid.language_column(F.col("text"), model)).agg(F.max("j.surprise")).first()[0]
    assert usual < 3.5
