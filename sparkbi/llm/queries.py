"""Registered queries of the corpus operators over the sample tables, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkbi.llm.bk_tree import near_copies
from sparkbi.llm.common import saved
from sparkbi.llm.extraction import extract
from sparkbi.llm.fingerprints import count_neighbours, edited_fingerprints
from sparkbi.llm.hard_negatives import hard_negatives
from sparkbi.llm.language import held_out, identify, learn_profiles
from sparkbi.llm.mixing import mix
from sparkbi.llm.packing import pack
from sparkbi.llm.repeats import without_repeats
from sparkbi.llm.sharding import shard_by_bytes
from sparkbi.llm.simhash_words import hex64
from sparkbi.llm.suffix_tree import held_out as not_learnt, score_texts
from sparkbi.llm.token_counts import apply_edits, with_trees
from sparkbi.llm.vectors import near_vectors
from sparkbi.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; neighbours of every twentieth document among all."""
    found = saved(edited_fingerprints(_table(spark, folder, "documents")))
    counted = count_neighbours(found, F.col("doc_id") % 20 == 0, radius=3)
    hexed = {name: hex64(F.col(name)) for name in ("fingerprint", "edited_fingerprint")}
    return counted.withColumns(hexed)


@_query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


@_query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight contiguous shards of nearly equal bytes."""
    placed = shard_by_bytes(_table(spark, folder, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt from four fifths of them."""
    docs = _table(spark, folder, "documents")
    held = held_out(F.col("doc_id"))
    found = identify(docs.select("doc_id", "text"), learn_profiles(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "similarity")


@_query
def op5_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract(_table(spark, folder, "pages"))


@_query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source: weights 3, 1, 2 repeating, 150% of all words, twice at most."""
    return mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op6_mixing"] = r"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h
    FROM documents
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
           2 * source_size AS cap
    FROM sizes
), ranked AS (
    SELECT *, row_number() OVER r AS place,
           (sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS level
    FROM weighed WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)
), common AS (
    SELECT arg_min(level, place) AS level FROM ranked WHERE level * weight <= cap
), targets AS (
    SELECT source, source_size, coalesce(least(cap::DOUBLE, common.level * weight), cap::DOUBLE) AS target FROM ranked, common
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets
), filled AS (
    SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
           sum(size) OVER (PARTITION BY d.source ORDER BY h)::BIGINT AS upto,
           sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS here
    FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
), edge AS (
    SELECT source, coalesce(min(CASE WHEN upto > budget THEN h END), max(h)) AS cut FROM filled GROUP BY source
)
SELECT doc_id, size, source_size, target,
       size * least(2, whole + CASE WHEN budget > 0 AND (h < cut OR h = cut AND upto - budget < budget - (upto - here)) THEN 1 ELSE 0 END) AS taken
FROM filled f JOIN edge e ON f.source IS NOT DISTINCT FROM e.source
"""


@_query
def op7_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents under a suffix tree learnt from six sevenths of them."""
    docs = _table(spark, folder, "documents")
    found = score_texts(docs, ~not_learnt(F.col("doc_id")))
    return found.select("doc_id", not_learnt(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op8_embedding_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings with cosine of at least 0.95."""
    return near_vectors(_table(spark, folder, "embeddings"), threshold=0.95)


ORACLE_SQL["op8_embedding_near_copies"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), found AS (
    SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
)
SELECT f.vec_id, (SELECT count(*) FROM links l WHERE l.a = f.vec_id) AS n_links, component_id, f.vec_id = component_id AS kept FROM found f
"""


def sample_edits() -> Column:
    """Three edits per document that its id and text decide: an exchange anywhere, an insertion in the middle, a cut near the end."""
    number = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    length = F.length("text")
    edit = lambda at, drop, put: F.struct(at.cast("int").alias("at"), drop.cast("int").alias("drop"), put.alias("put"))
    return F.array(
        edit(number % (length + 1), number % 40, F.substring(F.col("text"), (number % 97 + 1).cast("int"), F.lit(24))),
        edit(F.floor(length / 2), F.lit(0), F.concat(F.lit(" "), F.substring("text", 1, 10))),
        edit(F.greatest(length - 20, F.lit(0)), F.lit(10), F.lit("")),
    )


@_query
def op9_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, and after three edits each by encoding only what they touch."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trees = with_trees(docs, tokenizer).withColumns({"n_chars": F.length("text"), "tokens_before": F.col("n_tokens")})
    after = apply_edits(trees, tokenizer, sample_edits())
    return after.select(
        "doc_id",
        "n_chars",
        F.col("tokens_before").alias("n_tokens"),
        F.length("text").alias("edited_chars"),
        F.col("n_tokens").alias("edited_tokens"),
        "encoded_chars",
        F.crc32(F.encode("text", "UTF-8")).alias("edited_crc32"),
        F.size("leaf_chars").alias("leaves"),
    )


@_query
def op10_simhash_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most three bits."""
    found = near_copies(_table(spark, folder, "documents"), radius=3, shingle=3)
    return found.select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


@_query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on the first eight whitened components; a deviation beyond a long is null."""
    found = whitened(_table(spark, folder, "embeddings"), components=8)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@_query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every hundredth embedding; labels of every seventh are moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, folder, "embeddings"), F.col("id") % 100 == 0, moved, positives=5, negatives=10, window=(30, 90))


ORACLE_SQL["op12_hard_negatives"] = """
WITH usable AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.id % 100 = 0 AND a.id <> b.id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10
"""


@_query
def op13_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the words of 50-word windows that a document with a smaller id has too."""
    kept = without_repeats(_table(spark, folder, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL["op13_repeats"] = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS content
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM docs WHERE len(words) >= 50)
), firsts AS (
    SELECT content, min(doc_id) AS least FROM windows GROUP BY content
), again AS (
    SELECT w.doc_id, list_distinct(flatten(list(range(w.s, w.s + 50)))) AS gone
    FROM windows w JOIN firsts f ON w.content = f.content AND f.least < w.doc_id GROUP BY w.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
            ELSE array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]), ' ') END, '')) AS kept_sha256
FROM docs d LEFT JOIN again a ON d.doc_id IS NOT DISTINCT FROM a.doc_id
"""
