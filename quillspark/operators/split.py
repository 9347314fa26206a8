"""Deterministic stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash


def split_name(index: Column, n: Column) -> Column:
    """Place in a stratum of n to its split: a fifth each for validation and test (one at least), the rest train."""
    held = F.greatest(F.lit(1), F.floor(n / 5))
    three = F.when(index < n - 2 * held, "train").when(index < n - held, "validation").otherwise("test")
    return F.when(n >= 3, three).when((n == 2) & (index == 1), "test").otherwise("train")


def assign_splits(works: DataFrame, strata: list[str], seed: int = 137, key: str = "id") -> DataFrame:
    """works with a split: those of a stratum in order of the hash of seed and id.

    Places are counted in two steps: within each of 4096 parts of a stratum (by the hash's first digits), and over the
    parts' sizes, so no task holds a stratum."""
    by = Window.partitionBy(*strata)
    rows = works.withColumn("_h", content_hash(F.lit(seed), F.col(key))).withColumn("_p", F.substring("_h", 1, 3))
    sizes = rows.groupBy(*strata, "_p").agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.withColumns({"_before": F.sum("_c").over(by.orderBy("_p")) - F.col("_c"), "_n": F.sum("_c").over(by)}).drop("_c")
    sizes = sizes.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_p").alias("_q"), "_before", "_n")
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*strata, "_p").orderBy("_h")) - 1)
    same = [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)]
    rows = rows.join(sizes, [*same, F.col("_p") == F.col("_q")])
    return rows.select(*works.columns, split_name(F.col("_before") + F.col("_i"), F.col("_n")).alias("split"))
