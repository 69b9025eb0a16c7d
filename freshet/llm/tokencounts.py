"""Token counts by a cache of digests.

A text's digest and the tokenizer's name a count that is kept in a table. Texts whose count is
not there yet are encoded once each, however many copies there are, and their counts appended.
"""

import hashlib

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import text_slices
from freshet.llm.packing import text_encoder
from freshet.llm.segments import SegmentEncoder
from freshet.llm.sentencepieces import digest, reference_encoder
from freshet.storage import stage

LIMIT = 4096
_SCHEMA = "digest binary, version string, n_tokens long"


def version(path):
    """Names the tokenizer: its file's content, and the library that reads it and its version."""
    if path.endswith(".model"):
        return digest(path)
    with open(path, "rb") as file:
        said = hashlib.sha256(file.read())
    said.update(f"tokenizers {tokenizers.__version__}".encode())
    return said.hexdigest()


def _counter(path):
    """A function from texts to numbers of tokens: SentencePiece for .model, tokenizers for .json."""
    encoder = reference_encoder(path) if path.endswith(".model") else text_encoder(path)
    if isinstance(encoder, SegmentEncoder):
        return encoder.counts
    return lambda texts: map(len, encoder(texts))


def _first_copies(batches):
    """Rows of the first copy of each digest that this task sees."""
    seen = set()
    for batch in batches:
        keep = []
        for k, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64()))


def token_counts(docs: DataFrame, tokenizer, cache, id="doc_id", text="text", limit=LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Content is normalised as far as no count can change: null becomes empty. ``cache`` is a
    folder all executors share, made where it is missing; runs may share it, also at the same
    time: a count that two of them append is read once. Counts are of whole texts, without
    added tokens. Null ids and repeated rows give a row each, an empty table an empty one; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    name = version(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest")
    keyed = stage(
        docs.select(F.col(id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), key),
        "digests",
    )
    spark.createDataFrame([], _SCHEMA).write.mode("append").parquet(cache)

    def known():
        rows = spark.read.schema(_SCHEMA).parquet(cache).where(F.col("version") == name)
        # Stored, so that Spark may split the rows of a text of many copies when it joins them.
        return stage(rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "known-counts")

    misses = stage(keyed.select("digest").distinct().join(known(), "digest", "left_anti"), "misses")

    def encode(batches):
        count = _counter(tokenizer)
        for batch in _first_copies(batches):
            counts = [n for _, texts in text_slices(batch.column(1)) for n in count(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([name] * batch.num_rows, pa.string()),
                    pa.array(counts, pa.int64()),
                ],
                ["digest", "version", "n_tokens"],
            )

    # Copies go before the shuffle too, so that a text of many copies does not fill a task.
    texts = docs.select(key, body.alias("text")).mapInArrow(_first_copies, "digest binary, text string")
    wanted = texts.join(misses.hint("shuffle_hash"), "digest", "left_semi")
    wanted.mapInArrow(encode, _SCHEMA).write.mode("append").parquet(cache)
    return keyed.join(known(), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
