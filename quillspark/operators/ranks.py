"""Prefix sums in the order of a value, in two steps: within parts of the value's range, and over the sums of the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 1 << 14


def part_of(value: Column, low: float = -2.0, high: float = 2.0) -> Column:
    """The part of low to high that a value is in, -1 for null.

    Each step keeps the order of values, in floating point too, so parts follow each other as values do. Values outside
    share the parts at the ends, which costs balance only; the default range holds differences of cosines."""
    at = F.least(F.greatest((value - F.lit(low)) * F.lit(PARTS / (high - low)), F.lit(0.0)), F.lit(float(PARTS - 1)))
    return F.coalesce(F.floor(at).cast("int"), F.lit(-1))


def prefix_sums(rows: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """rows (keys, value, sums), one for each value of a key, with ``_next``, the value that follows, and for each of
    sums its total (``<sum>_all``) and its sum up to the row, itself included (``<sum>_upto``).

    No task holds a key: rows are summed within a part, and only one row a part is ranked by key."""
    parted = rows.withColumn("_part", part_of(F.col(value)))
    parts = parted.groupBy(*keys, "_part").agg(*[F.sum(s).alias(s) for s in sums], F.min(value).alias("_least"))
    over, whole = Window.partitionBy(*keys).orderBy("_part"), Window.partitionBy(*keys)
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    before = [(F.sum(s).over(over) - F.col(s)).alias(f"{s}_before") for s in sums]
    parts = parts.select(*named, F.col("_part").alias("_at"), *before, *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums], F.lead("_least").over(over).alias("_after"))
    within = Window.partitionBy(*keys, "_part").orderBy(value)
    parted = parted.withColumns({f"{s}_in": F.sum(s).over(within) for s in sums} | {"_lead": F.lead(value).over(within)})
    out = parted.join(parts, [*[F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_at")])
    upto = [(F.col(f"{s}_before") + F.col(f"{s}_in")).alias(f"{s}_upto") for s in sums]
    return out.select(*rows.columns, *upto, *[f"{s}_all" for s in sums], F.coalesce("_lead", "_after").alias("_next"))
