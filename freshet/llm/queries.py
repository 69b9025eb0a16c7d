"""The registered queries of this folder, and their SQL where SQL can say them."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm.chat import format_chat, read_back
from freshet.llm.langid import identify_language, train_language
from freshet.llm.packing import pack_documents
from freshet.llm.phrases import collocations
from freshet.llm.rptree import near_vectors
from freshet.llm.secrets import find_secrets, span_text
from freshet.llm.sentencepieces import encode_documents
from freshet.llm.simhash import simhash_groups
from freshet.llm.spelling import spelling_variants
from freshet.llm.tokencounts import token_counts
from freshet.llm.topk import integer_vectors, top_products
from freshet.llm.toxicity import toxicity, train_toxicity
from freshet.llm.warc import archive_pages, page_number, read_archive
from freshet.storage import new_path

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(parts):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query(
    "op1_embedding_near_dup",
    """
    WITH RECURSIVE good AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
      ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    reached AS (
      SELECT vec_id, vec_id AS other FROM embeddings
      UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
    least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
    SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
      component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN least USING (vec_id)
    """,
)
def op1_embedding_near_dup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query(
    "op2_exact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank, vec_id, score FROM (
      SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank
      FROM s) WHERE rank <= 5
    """,
)
def op2_exact_topk(spark, sf_dir):
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_products(vectors.where("vec_id % 50 = 0"), vectors, k=5)


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


_ESCAPED = (
    "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '[INST]', '[\\INST]'), "
    "'[/INST]', '[\\/INST]'), '<s>', '<\\s>'), '</s>', '<\\/s>')"
)


@query(
    "op4_chat_format",
    f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
        (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    n AS (SELECT *, row_number() OVER o AS k, lag(r) OVER o AS p
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY k)) AS turns_sha256,
      coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(x, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256,
      (4 + sum(length({_ESCAPED.format("x")}) + CASE WHEN p = r THEN 3
        ELSE 13 + length({_ESCAPED.format("r")}) + CASE WHEN k > 1 THEN 4 ELSE 0 END END)
      )::BIGINT AS formatted_chars
    FROM n GROUP BY conv_id
    """,
)
def op4_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return read_back(format_chat(rows.unionByName(more)))


@query(
    "op6_warc",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
        AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f
    """,
)
def op6_warc(spark, sf_dir):
    index = archive_pages(table(spark, sf_dir, "pages"))
    return read_archive(index).select(
        page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_number(F.col("refers_to")).alias("refers_to"),
    )


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    # A cache of its own, so that the query's work does not depend on what ran before it.
    return token_counts(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("piece_bpe_32k.model"),
        new_path(spark, "token-counts"),
    )


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_language(docs.where(fold(4) != 2), public_tokenizers.path("piece_bpe_32k.model"))
    found = identify_language(docs, model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op7_packing")
def op7_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_secret_scan")
def op11_secret_scan(spark, sf_dir):
    words = public_tokenizers.path("word_bpe_49k.json")
    found = find_secrets(table(spark, sf_dir, "documents"), words)

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(span_text(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"), typos=199)


@query(
    "op13_phrase_collocations",
    r"""
    WITH p AS (
      SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(range(len(pieces))) AS piece,
        unnest(pieces) AS text FROM (SELECT doc_id, lang, string_split_regex(translate(
          coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x{0A}-\x{0D}]') AS pieces FROM documents)),
    w AS (SELECT lang, regexp_extract_all(text, '[^\x{20}\x{09}]+') AS words FROM p),
    grams AS (
      SELECT lang, width, array_to_string(words[i:i + width - 1], ' ') AS phrase
      FROM (SELECT lang, words, width, unnest(range(1, len(words) - width + 2)) AS i
        FROM w, (VALUES (1), (2), (3), (4)) AS v(width) WHERE len(words) >= width)),
    f AS (SELECT lang, width, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
    totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE width > 1),
    cuts AS (
      SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS head,
        array_to_string(words[k + 1:], ' ') AS tail
      FROM (SELECT *, unnest(range(1, width)) AS k FROM c)),
    scored AS (
      SELECT cuts.lang, cuts.phrase, cuts.a, k, h.a AS l, t.a AS r,
        ((2000000::HUGEINT * cuts.a) // (h.a + t.a))::BIGINT AS score
      FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head
        JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
    least AS (
      SELECT * FROM scored
      QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
      SELECT lang, array_to_string(words[i:i + short - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, words, a, short, unnest(range(1, width - short + 2)) AS i
        FROM c, (VALUES (2), (3)) AS v(short) WHERE short < width) GROUP BY ALL),
    kept AS (
      SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase)
      WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
      phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang)
    QUALIFY rank <= 2000
    """,
)
def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents")).drop("doc", "at")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
