"""The corpus pipeline: language ID, quality, exact dedup, SimHash near-dedup,
packing. Part of the subpackage ``wattline.llm``.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the
columns of ``docs``; each works on all rows that the stage before it kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattline.llm import langid, quality
from wattline.llm.common import fold, table
from wattline.llm.exact_dedup import keep_exact
from wattline.llm.packing import pack_documents
from wattline.llm.simhash import keep_simhash
from wattline.session import scratch_path

PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Documents whose language is less sure than this go, with those that have none.
LEAST_LANGUAGE_SCORE = 0.02
LEAST_QUALITY = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; those without a letter or
    with a score below LEAST_LANGUAGE_SCORE go. Null texts go."""
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    found = langid.with_language(docs, model)
    return found.filter((found.lang_pred != langid.UNDETERMINED) & (found.score >= LEAST_LANGUAGE_SCORE)).select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score LEAST_QUALITY or more, null texts counting
    as empty ones."""
    model = quality.fit(docs.filter(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return quality.with_quality(docs, model).filter(f"score >= {LEAST_QUALITY}").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal but for white
    space: the one of most code points, then the smallest id. Null counts as
    empty. Rows that repeat id and text are one document; rows that share an id
    alone, or have none, are not. An empty table stays empty."""
    return keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group
    (4-word shingles, at most 4 differing bits; a row without id only where none
    has one). Null and empty texts are one group; of rows that repeat the id that
    stays, the least by text digest. An empty table stays empty."""
    return keep_simhash(docs, width=4, distance=4)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens. Null and
    empty texts are the end token alone, repeated rows are packed as often, a
    null id stays null, and an empty table gives no piece."""
    return pack_documents(docs, PACKING_TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("packing", packing),
]

#: Trained models, connected components and the packing programme have no SQL
#: form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each stage's rows are written
    as Parquet in the shared checkpoint folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
