"""Documents to packed training sequences: language, near copies, mixture, packing.

Each stage takes the documents its predecessor kept, with all their columns, and its decisions take
effect; the last returns the packing. Nulls, repeated rows and empty tables are handled as the
operators' modules say: a null or wordless text has no language and goes in the first stage, very long
texts are read whole, and of languages equally near the first by name is taken. Of a group of near
copies the smallest id stays; of equal ids the smallest text hash, of repeated rows one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkbi.llm.common import saved
from sparkbi.llm.language import UNKNOWN, held_out, identify, learn_profiles
from sparkbi.llm.mixing import mixed_documents
from sparkbi.llm.near_texts import keep_one, near_texts
from sparkbi.llm.packing import pack

#: A text that shares less of its language's n-gram order is taken for noise; prose is far above it.
LEAST_SIMILARITY = 0.2


def _whole(docs: DataFrame) -> Column:
    """All columns of a row in one, out of the way of the columns that a stage adds."""
    return F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_document")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language. Profiles are learnt from four fifths of the stage's own input."""
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select(_whole(docs), "text"), profiles)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("similarity") >= LEAST_SIMILARITY)).select("_document.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: 0.8 or more of five-word shingles shared, smallest id first."""
    return keep_one(docs, near_texts(docs, similarity=0.8, shingle=5))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 3, 1, 2 over the sources, 150% of all words, twice at most."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES = [("language", language_stage), ("near copies", near_copies_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Language profiles, 64-bit hashes of shingles and tokenizers are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
