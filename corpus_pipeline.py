"""From raw documents to token ids: quality, line dedup, near duplicates, mixing, tokenizing.

Every stage takes the documents its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lynceus.llm.base import stored, table, without
from lynceus.llm.kneser_ney import quality_scores
from lynceus.llm.line_dedup import line_dedup
from lynceus.llm.mixing import mix_documents
from lynceus.llm.ngram_join import jaccard_join
from lynceus.llm.pieces import encode_pieces
from lynceus.llm.settings import form_topic, trusted_ids, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's threshold.

    Of an id's rows one that is kept keeps all; rows with a null id always stay.
    """
    scores = quality_scores(docs, trusted_ids(spark, sf_dir))
    rejected = scores.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return without(docs, rejected, "doc_id")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; n_chars follows the text."""
    clean = line_dedup(docs, min_sites=8).select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; repeated rows of an id stay."""
    groups = jaccard_join(docs)
    return without(docs, groups.where("component_id <> doc_id").select("doc_id"), "doc_id")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that token shares meet the targets."""
    return mix_documents(docs, form_topic()).where("mix_sampled").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mixing), ("pieces", tokenize)]

#: Perplexities, hashes and piece ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
