"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

All stages but the last return the columns of their input, whatever they are called.  A stage drops or shortens
documents only by its own decision; rows with a null id or text stay, but for the sampling.  An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.minhash import NearDuplicates
from meridia.llm.mixing import Raking
from meridia.llm.piece_codec import encoded
from meridia.llm.suffix_dedup import SuffixDedup
from meridia.llm.support import free_name, materialize, sized, table
from meridia.llm.toxicity import ToxicityGrammar, held_out


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the grammar scores at 0.5 or more; it learns outside the held-out fold.  Null texts score as
    empty ones; rows that repeat an id are scored by themselves."""
    model = ToxicityGrammar().fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return model.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows that repeat its id stay with it."""
    name = free_name(docs, "gone")
    gone = materialize(NearDuplicates()(docs).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(sized(gone), docs["doc_id"].cast("long") == gone[name], "left_anti")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes and more that a document with a smaller id holds; ``n_chars`` follows the text (a null text
    has null)."""
    out = SuffixDedup(length=50).rewrite(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to the raked source, language and topic weights; a null source or language is one of its own."""
    return Raking().keep(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``piece_ids``, from which the text can be decoded; null and empty texts have none."""
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("piece_encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
