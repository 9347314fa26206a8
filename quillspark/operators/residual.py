"""Content bases and style residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import create_id
from ..functions.vector import add, let, norm, normalize, residualize, scale
from ..config import EPSILON


def basis_vectors(fields: Column, combined: Column) -> Column:
    """Field vectors that aren't zero, their normalised mean if there are several, and the combined one."""
    some = F.filter(fields, lambda v: norm(v) > EPSILON)

    def whole(fs: Column) -> Column:
        total = F.aggregate(F.slice(fs, 2, F.size(fs)), F.element_at(fs, 1), add)
        mean = F.when(F.size(fs) > 1, F.array(normalize(scale(total, 1.0 / F.size(fs))))).otherwise(F.array().cast("array<array<double>>"))
        last = F.when(combined.isNotNull() & (norm(combined) > EPSILON), F.array(combined)).otherwise(F.array().cast("array<array<double>>"))
        return F.concat(fs, mean, last)

    return let(some, whole)


def content_bases(topics: DataFrame) -> DataFrame:
    """Topic embeddings (owner_id, scope, id, vector) to one row a work: its basis vectors and their ids."""
    is_all = F.col("scope") == "combined_topic_profile"
    rows = topics.groupBy(F.col("owner_id").alias("work_id")).agg(
        F.sort_array(F.collect_list(F.when(~is_all, F.struct("scope", "vector")))).alias("_f"),
        F.max_by("vector", F.when(is_all, 1)).alias("_c"),
        F.sort_array(F.collect_list("id")).alias("topic_embedding_ids"),
    )
    return rows.select("work_id", "topic_embedding_ids", basis_vectors(F.col("_f.vector"), F.col("_c")).alias("basis"))


def residuals(embeddings: DataFrame, blocks: DataFrame, topics: DataFrame) -> DataFrame:
    """Residuals of all work and block embeddings; a work's basis is built once. Rows without topics are dropped."""
    works = embeddings.where("owner_type = 'work'").withColumns({"work_id": F.col("owner_id"), "block_type": F.lit(None).cast("string")})
    parts = embeddings.where("owner_type = 'block'").join(blocks.select(F.col("id").alias("owner_id"), "work_id", F.col("type").alias("block_type")), "owner_id")
    rows = works.unionByName(parts).join(content_bases(topics), "work_id")
    return rows.select(create_id("residual", F.col("id")).alias("id"), "owner_type", "owner_id", "work_id", "scope", "block_type", F.col("id").alias("source_embedding_id"), "topic_embedding_ids", residualize(F.col("vector"), F.col("basis")).alias("vector"))
