"""Lookup reads from the customer system: customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions.text import clean_optional


def read_lookup(spark: SparkSession, source: str, table: str | None = None, **options: str) -> DataFrame:
    """A parquet folder, or a JDBC table when ``table`` is named (options: user, password, partitioning)."""
    if table is None:
        return spark.read.parquet(source)
    return spark.read.format("jdbc").options(url=source, dbtable=table, **options).load()


def customer_options(customers: DataFrame) -> DataFrame:
    """Active customers first, then by name and number."""
    inactive = F.coalesce(F.col("inactive"), F.lit(False))
    return customers.select(
        clean_optional(F.col("contact_oid").cast("string")).alias("contact_oid"), inactive.alias("inactive"),
        clean_optional(F.col("uid_number")).alias("uid_number"), clean_optional(F.col("customer_number")).alias("customer_number"),
        clean_optional(F.col("display_name")).alias("display_name"),
    ).orderBy(inactive, "display_name", "customer_number")


def order_options(orders: DataFrame) -> DataFrame:
    """Order names, nameless ones dropped, sorted."""
    return orders.select(clean_optional(F.col("name")).alias("name")).where("name is not null").orderBy("name")
