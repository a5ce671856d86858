"""A corpus pipeline over `documents`: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents;
the last returns each document's token count and the digests of its ids and decoded text. Between stages
run() writes Parquet into the shared folder and reads it again, so a lost executor costs one stage's
tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontaminate, ngram_join, quality_model, sentence_pieces, substring_dedup
from ledgerlens.llm.common import cut, drop_folder, new_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject.

    Null and empty texts, null and repeated doc_ids are scored like any others; without labels all stay; an empty table stays empty.
    """
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: the one with the smallest doc_id.

    Rows that share this doc_id all stay, and so do rows with a null doc_id and texts without words; an empty table stays empty.
    """
    return ngram_join.keep_one(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that a smaller doc_id has too; no row goes, texts without such windows stay as they are.

    Rows with a null doc_id are kept whole; rows that share a doc_id count as one document; a null text stays null or empty; an empty table stays empty.
    """
    return substring_dedup.deduplicate(docs, 50)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of ten words or more that a benchmark item has (or a shorter item whole); no row goes.

    Null texts have no words; doc_ids play no part; with an empty benchmark all texts stay; an empty table stays empty.
    """
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left of each text, a row for each.

    Null and empty texts have no ids and decode to ''; doc_ids pass through; an empty table gives an empty result.
    """
    import public_tokenizers

    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]
#: SQL expresses neither the model nor the tokenizer; tests/llm hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    drop_folder(spark, folder)
    return out
