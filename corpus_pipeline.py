"""Corpus pipeline over ``documents``: quality, near-dedup, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read
again as the next stage's ``docs``. All but the last return the columns of documents:

1. quality: documents that the classifier rejects go;
2. near_dedup: of each group of near-duplicates (5-word shingles, similarity of at least
   0.8) the one with the smallest id stays;
3. decontaminate: documents that the contamination rule marks go;
4. mix: every document stands as often as the mix takes it (never, once or twice);
5. shard: shard and slot of every row, repeats included.

Empty tables give no rows; null texts, ids and labels, repeated rows and columns with other
names pass through every stage as each operator defines. Written tables go with the application.

No SQL states stage 1's model or stage 2's hashed shingles, so there is no oracle SQL; the
tests hold ``run`` against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestitch.llm import decontam, mixing, near_dup, quality, shared, sharding

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw_mix(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, shards=16)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]


def run(spark: SparkSession, sf_dir: str, alone: bool = False) -> DataFrame:
    """All stages; with ``alone`` (no other result of these operators is read in this application)
    the tables of earlier stages are deleted on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if alone:
            shared.clear(spark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
