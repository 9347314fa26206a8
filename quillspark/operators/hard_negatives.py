"""Hard-negative mining: nearest backgrounds by target or by target centroid, split-aware, capped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import centroids, cosine
from .search import nearest

PARTS = 64


def per_target(targets: DataFrame, backgrounds: DataFrame, k: int = 5, split_aware: bool = False) -> DataFrame:
    """(target_id, background_id, split, similarity, rank) of targets and backgrounds (id, split, vector)."""
    split = F.coalesce("split", F.lit("unsplit"))
    t = targets.select((split if split_aware else F.lit("")).alias("part"), "id", "vector")
    # targets without a split meet the backgrounds of all splits
    parts = F.filter(F.array_distinct(F.array("split", F.lit("unsplit"))), lambda x: x.isNotNull()) if split_aware else F.array(F.lit(""))
    b = backgrounds.select(F.explode(parts).alias("part"), "id", "vector")
    found = nearest(t, b, k).select(F.col("id").alias("target_id"), F.col("neighbour").alias("background_id"), "similarity", "rank")
    return found.join(targets.select(F.col("id").alias("target_id"), split.alias("split")), "target_id").select("target_id", "background_id", "split", "similarity", "rank")


def by_centroid(targets: DataFrame, backgrounds: DataFrame, k: int = 5, split_aware: bool = False) -> DataFrame:
    """The nearest k * targets backgrounds of each split's target centroid, k at least."""
    name = F.col("split") if split_aware else F.lit("unsplit")
    t = targets.withColumn("split", name)
    cents = centroids(t, ["split"]).select("split", F.col("vector").alias("_c"), (F.greatest(F.lit(1), F.col("count")) * k).alias("_k"))
    pairs = backgrounds.withColumn("split", name).join(F.broadcast(cents), "split", "left")
    pairs = pairs.select(F.concat(F.lit("target_centroid_"), F.col("split")).alias("target_id"), F.col("id").alias("background_id"), "split", cosine(F.col("vector"), F.col("_c")).alias("similarity"), F.coalesce("_k", F.lit(k)).alias("_k"))
    # the first _k of each of PARTS parts of a split hold the first _k of all
    part = F.pmod(F.xxhash64("background_id"), F.lit(PARTS))
    near = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("split", part).orderBy(F.desc("similarity"), "background_id"))).where("_r <= _k").drop("_r")
    rank = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("similarity"), "background_id"))
    return near.withColumn("rank", rank).where("rank <= _k").drop("_k")


def selected(rows: DataFrame, cap: int = 0) -> DataFrame:
    """(background_id, max_similarity) of the backgrounds selected; with a cap, the most similar ones."""
    best = rows.groupBy("background_id").agg(F.max("similarity").alias("max_similarity"))
    return best.orderBy(F.desc("max_similarity"), "background_id").limit(cap) if cap else best


def keep_works(tables: dict[str, DataFrame], kept: DataFrame, key: dict[str, str]) -> dict[str, DataFrame]:
    """Each table with the rows of kept works (work_id) only."""
    return {name: df.join(kept.select(F.col("work_id").alias(key[name])), key[name], "left_semi") for name, df in tables.items()}
