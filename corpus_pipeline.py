"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as
Parquet and read again. All but the last return the columns of ``documents``. Rows are told by doc_id and text, so that a text
that shares its id with a dropped one stays; null texts count as empty, null ids order last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch
from tessera.llm.queries import TOKENIZER, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from ``labels``, rejects go; repeated rows share their fate."""
    from tessera.llm.toxicity import not_toxic

    return not_toxic(spark, docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one row stays."""
    from tessera.llm.exact_dedup import keep_one

    return keep_one(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, a similarity of 0.8 or more; one document of each group stays."""
    from tessera.llm.minhash import keep_one

    return keep_one(spark, docs, shingle=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark``, verbatim or reworded, go."""
    from tessera.llm.decontamination import clean

    return clean(spark, docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, as op7 gives them, of all documents that are left."""
    import public_tokenizers

    from tessera.llm.packing import pack

    return pack(spark, docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: Classifiers, similarity search and packing aren't expressible in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
