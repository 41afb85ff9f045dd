"""Quality jobs: corpus comparison and text-leak audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text as X

# The four leak detectors.
LEAKS = {
    "leading_number": r"^\s*\d[\d.,]*\s+\D", "trailing_pair": r"(?:\s+\d{2,}){2,}\s*$", "trailing_single": r"\s\d\s*$",
    "price": r"(?:€|EUR)|\d{1,3}(?:\.\d{3})*,\d{2}",
}


def compare_fields(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per field that differs; a document missing on one side differs in `document`."""
    left = expected.select(key, F.lit(True).alias("_e"), *[F.col(c).cast("string").alias(f"e_{c}") for c in fields])
    right = actual.select(key, F.lit(True).alias("_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in fields])
    joined = left.join(right, key, "full_outer")
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    cells = [F.when(both & ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), F.struct(
        F.lit(c).alias("field"), F.col(f"e_{c}").alias("expected"), F.col(f"a_{c}").alias("actual"))) for c in fields]
    missing = F.when(~both, F.struct(F.lit("document").alias("field"), F.when(F.col("_e").isNotNull(), "present").alias("expected"),
                                     F.when(F.col("_a").isNotNull(), "present").alias("actual")))
    return joined.select(key, F.inline(F.filter(F.array(missing, *cells), lambda c: c.isNotNull())))


def leak_audit(items: DataFrame, supplier: str) -> DataFrame:
    """Flagged positions per supplier and detector, worst supplier first. Candidates, not findings."""
    any_line = lambda lines, pattern: F.exists(lines, lambda line: F.regexp_like(line, F.lit(pattern)))
    # the lines are cut once for all detectors
    flags = X.let(X.filled_lines(F.coalesce("description_long", F.lit(""))), lambda lines: F.struct(
        *[any_line(lines, pattern).alias(name) for name, pattern in LEAKS.items()]))
    flagged = items.select(supplier, flags.alias("flags")).select(supplier, "flags.*")
    any_flag = F.greatest(*[F.col(c).cast("int") for c in LEAKS])
    return flagged.groupBy(supplier).agg(
        F.count("*").alias("positions"), F.sum(any_flag).alias("flagged"), *[F.count_if(F.col(c)).alias(c) for c in LEAKS]
    ).orderBy(F.col("flagged").desc(), supplier)
