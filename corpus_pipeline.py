"""A corpus from raw documents to token ids, in five stages. Counted as part of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents; n_chars follows the text where a stage changes it. Null doc_ids and texts
pass as the stages' operators say; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, linededup, quality
from tidemark.llm.common import documents, stored


def _with_text(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, the text replaced by kept_text."""
    new = {"text": F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))}
    if "n_chars" in columns:
        new["n_chars"] = F.length(new["text"]).cast("long")
    return found.withColumns(new).select(*(F.col(f"`{c}`") for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go from all of them."""
    return _with_text(linededup.drop_lines(docs, linededup.frequent_keys(docs, min_docs=10)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows of benchmark items go."""
    return _with_text(decontaminate.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text decoded from them."""
    import public_tokenizers

    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False, lean=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the vote model nor the merges; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
