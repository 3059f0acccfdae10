"""Tables of the test star schema, and the job-system tables they stand in for.

Jobs are orders (F done, P process, O queued), tenants are nations, customers are customers
with their balance as used storage, token calls are line items, term bases are part brands
with parts as terms, favourites and call logs are events. "Now" is a fixed parameter, as
the data are historic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1998-06-15 12:00:00"
EVENTS_NOW = "2024-01-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "process").otherwise("queued")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("size"),
        F.col("o_orderpriority").alias("priority"),
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("email"), F.col("c_acctbal").alias("storage")
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("tenant_name"))


def token_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("translate_id"),
        F.col("l_linenumber").alias("attempt"),
        F.col("l_quantity").alias("input_tokens"),
        F.col("l_extendedprice").alias("output_tokens"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("status"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("base"), F.col("p_partkey").alias("term_id"), F.col("p_name").alias("source"), F.col("p_type").alias("target")
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the ordered segments of a document."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_idx"), "text", "role")
