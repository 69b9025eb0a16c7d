import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from freshet.storage import stage


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("sf")
    return str(place)


def test_stages_chain_as_run_does(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = stage(function(spark, docs, small_dir), name)
        assert kept.columns == columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = kept
    want = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir)
    got = corpus_pipeline.run(spark, small_dir)
    pick = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == ids


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES)
def test_odd_and_empty_documents(spark, odd_docs, small_dir, name, function):
    got = function(spark, odd_docs, small_dir)
    if name != "packing":
        assert got.columns == odd_docs.columns
    assert 0 < got.count()
    assert function(spark, odd_docs.limit(0), small_dir).count() == 0


def test_stage_decisions(spark, odd_docs, small_dir):
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    left = ids(corpus_pipeline.language_stage(spark, odd_docs, small_dir))
    assert not {4, 5, 6, 8} & set(left) and {1, 2, 3} <= set(left)
    left = ids(corpus_pipeline.simhash_stage(spark, odd_docs, small_dir))
    assert left.count(1) == 1 and 2 not in left and 4 in left and 5 not in left


def test_unlearned_scripts_and_noise_go_and_clean_documents_stay(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    strange = ["这是一个中文句子，用来测试。" * 3, "Αυτό είναι ένα ελληνικό κείμενο", "qjfwx gkvzq hhjkl wqpvx zxcvb nmqwx"]
    more = spark.createDataFrame(
        [(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(strange)], docs.schema
    )
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(more), small_dir)
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not {10**6 + k for k in range(3)} & left
    lettered = {r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert lettered == left


def test_no_sql_for_models():
    assert corpus_pipeline.ORACLE_SQL is None
