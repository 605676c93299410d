"""Corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents. Every row is a document of its own: rows with null or repeated ids, and
repeated rows, are judged by their text alone (near-dedup keeps one of equal texts).
Extra columns pass the first three stages under any name. Null and empty texts have no
words, so that the first stage rejects them; very long texts are read whole. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urbanlattice.llm import langid, neardup, packing, quality
from urbanlattice.llm.common import small_batches, written
from urbanlattice.session import ship

#: A document goes if no language holds this share of it.
LEAST_SHARE = 0.34


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.passed(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; learnt from the labelled ones among ``docs``."""
    ship(spark), small_batches(spark)
    trained = langid.learn(docs.where(~langid.held_out("doc_id")))
    if not trained[0]:
        # nothing is labelled, so that no document can be told to be in no language
        return docs
    return langid.in_a_language(docs, trained, LEAST_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a likeness of 0.8 of five-word shingles, the one with the least id."""
    ship(spark), small_batches(spark)
    return neardup.deduplicated(docs, size=5, threshold=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    import public_tokenizers

    ship(spark), small_batches(spark)
    cut = written(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(cut, cut.count())


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("best-fit packing", best_fit_packing)]

#: Language identification and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
