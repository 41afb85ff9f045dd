"""Window shared by the in-document operators.

A document is one text, so its positions, amount rows and images are bounded by
one input row. Everything keyed by anything else (reference keys, suppliers,
users, hashes) is solved with aggregates instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def per_document(*order) -> WindowSpec:
    window = Window.partitionBy("document_id")
    return window.orderBy(*order) if order else window


def number_rows(rows: DataFrame, key: str, block: str, order: tuple[str, ...], name: str) -> DataFrame:
    """Dense numbers of a key's rows in the order of ``block``, then of ``order``.

    A block is numbered on its own and moved by the rows of the blocks before it. Those are partial counts,
    and only the blocks of a key, not its rows, meet in one task.
    """
    counts = rows.groupBy(key, block).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, block, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, block).orderBy(*order)
    numbered = rows.withColumn("_place", F.row_number().over(inside)).join(counts, [key, block])
    return numbered.withColumn(name, (F.col("_place") + F.col("_before")).cast("int")).drop("_place", "_before")
