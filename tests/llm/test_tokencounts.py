import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from freshet.llm import tokencounts
from freshet.storage import new_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def key(r):
    return tuple(str(x) for x in r)


def want(docs, count, limit):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    return sorted(((i, len(t.encode()), count(t), count(t) > limit) for i, t in rows), key=key)


@pytest.mark.parametrize("path", [MODEL, JSON, public_tokenizers.path("word_bpe_49k.json")])
def test_equals_the_library(spark, odd_docs, path):
    if path == MODEL:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        made = Tokenizer.from_file(path)
        count = lambda t: len(made.encode(t, add_special_tokens=False).ids)
    got = tokencounts.token_counts(odd_docs, path, new_path(spark, "cache"), limit=50)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want(odd_docs, count, 50)


def test_only_distinct_misses_are_encoded(spark, odd_docs, monkeypatch):
    cache = new_path(spark, "cache")
    tokencounts.token_counts(odd_docs.where("doc_id < 4"), JSON, cache).collect()
    first = spark.read.parquet(cache)
    distinct = odd_docs.where("doc_id < 4").select("text").distinct().count()
    assert first.count() == distinct
    got = tokencounts.token_counts(odd_docs, JSON, cache)
    rows = spark.read.parquet(cache)
    assert rows.count() == rows.select("digest").distinct().count()
    assert rows.count() == odd_docs.na.fill("", ["text"]).select("text").distinct().count()
    assert got.count() == odd_docs.count()
    # Another tokenizer's counts are not taken for this one's.
    tokencounts.token_counts(odd_docs, MODEL, cache).collect()
    assert spark.read.parquet(cache).count() == 2 * rows.count()


def test_counts_come_from_the_cache(spark, odd_docs):
    cache = new_path(spark, "cache")
    tokencounts.token_counts(odd_docs, JSON, cache).collect()
    doubled = new_path(spark, "cache")
    spark.read.parquet(cache).selectExpr("digest", "version", "1000000 + n_tokens as n_tokens").write.parquet(doubled)
    got = tokencounts.token_counts(odd_docs, JSON, doubled).collect()
    assert all(r["n_tokens"] >= 1_000_000 for r in got)


def test_empty_table(spark, odd_docs):
    assert tokencounts.token_counts(odd_docs.limit(0), JSON, new_path(spark, "cache")).count() == 0
