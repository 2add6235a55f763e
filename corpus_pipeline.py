"""A corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing and packing, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and longer ones that parse into single bytes in every language."""
    from chargelens.llm.language_id import keep_identified

    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    from chargelens.llm.exact_dedup import keep_exact

    return keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 in five-word runs one stays."""
    from chargelens.llm.ngram_join import keep_one_of_class

    return keep_one_of_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weights for all sources; every document stays, in the order of the schedule: part files hold ranges of it."""
    from chargelens.llm.mixing import in_mix_order

    return in_mix_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, whose sequence ids follow the mixing schedule: files don't keep the order of rows, so their positions are derived again."""
    import public_tokenizers

    from chargelens.llm.common import saved
    from chargelens.llm.mixing import mix_sources
    from chargelens.llm.packing import pack

    mixed = saved(mix_sources(docs.select("doc_id", "text", "source")))  # a stage of its own: one Python worker a task, not one for the positions beside one for the ids
    return pack(mixed, public_tokenizers.path("byte_bpe_50k.json"), position_col="mix_position")


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix), ("packing", pack_sequences)]

#: SQL can't express the language parse, the schedule or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    from chargelens.llm.common import saved

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
