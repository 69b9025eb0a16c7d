"""From raw documents to packed sequences: toxic texts go, then texts without a certain language,
then near copies; the rest is packed.

``run`` applies STAGES to the table documents, each to what the one before kept.
"""

import public_tokenizers
from pyspark.sql import functions as F

from freshet.llm.common import free_name
from freshet.llm.langid import language_column, train_language
from freshet.llm.packing import pack_documents
from freshet.llm.simhash import drop_near_copies
from freshet.llm.toxicity import toxicity_column, train_toxicity
from freshet.storage import stage

SURE = 0.5  # Least probability of the predicted language among those learned.
SURPRISING = 3.5  # Nats a letter beyond what is usual in that language, from which a text is in none.

ORACLE_SQL = None


def _fold(parts):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def toxicity_stage(spark, docs, sf_dir):
    """Documents scored below 0.5, by a model of the labelled ones.

    Null texts are scored as empty; texts of any length whole; repeated rows alike.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = train_toxicity(docs, labels.where(_fold(5) != 0))
    judged = free_name(docs, "judged")
    scored = docs.withColumn(judged, toxicity_column(F.col("text"), model))
    return scored.where(F.col(f"{judged}.score") < 0.5).drop(judged)


def language_stage(spark, docs, sf_dir):
    """Documents in a learned language, known with at least even odds.

    ``und``, null, empty and letterless texts go, and texts whose letters surprise: noise and other
    languages. Texts of any length are judged by their mean; repeated rows are judged alike.
    """
    model = train_language(
        docs.where(_fold(4) != 2), public_tokenizers.path("piece_bpe_32k.model")
    )
    judged = free_name(docs, "judged")
    found = docs.withColumn(judged, language_column(F.col("text"), model))
    sure = (F.col(f"{judged}.lang") != "und") & (F.col(f"{judged}.score") >= SURE)
    sure = sure & (F.col(f"{judged}.surprise") < SURPRISING)
    return found.where(sure).drop(judged)


def simhash_stage(spark, docs, sf_dir):
    """Of each group of near copies, the document with the least id.

    Null and empty texts are copies of each other, as are repeated rows; of rows without any id
    one stays a group.
    """
    return drop_near_copies(docs)


def packing_stage(spark, docs, sf_dir):
    """The pieces of all documents left, with their places in sequences of 1024 tokens.

    A null or empty text is its end mark alone; long texts are cut; repeated rows are packed each.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("simhash", simhash_stage),
    ("packing", packing_stage),
]


def run(spark, sf_dir):
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
