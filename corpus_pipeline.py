"""A corpus pipeline: stages over documents, each written as Parquet and read by the next.

Documents that the quality rules reject go; lines that an earlier document holds go; of each
group of near-duplicates (five-word shingles, similarity of 0.8) the smallest doc_id stays;
secrets are replaced by a mark; what is left is packed into sequences.

Defined results: a null or empty text fails the base rules and goes; rows of one doc_id are one
document, kept or dropped together by near duplicates; a null doc_id is kept unless a rule of its
text drops it; extra columns pass through all stages but the last; an empty table gives an empty
one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import Scratch, table
from riskweave.llm.line_dedup import line_dedup
from riskweave.llm.ngram_join import ngram_join
from riskweave.llm.packing import pack_documents
from riskweave.llm.quality_rules import quality_filter
from riskweave.llm.secrets import secret_redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says good and that pass the base rules."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; n_chars follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = line_dedup(docs, keep_cols=rest)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; repeated rows of one doc_id are one document."""
    groups = ngram_join(docs, 5, 80, 100)
    others = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret of every text replaced by a mark; n_chars follows the text."""
    return secret_redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("secret scan", secrets), ("packing", packing)]
#: Expectation-maximisation and trained networks are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
