"""Hard-negative mining as a stage: a run's tables, with the backgrounds that are nearest to the targets only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assessment, hard_negatives


@dataclass(frozen=True)
class Mining:
    """strategy: per-target-nearest or target-centroid. most: at most so many backgrounds, 0 for all that are found."""

    per_target: int = 5
    most: int = 0
    split_aware: bool = False
    strategy: str = "per-target-nearest"


def mine(works: DataFrame, blocks: DataFrame, atoms: DataFrame, topics: DataFrame, splits: DataFrame, embeddings: DataFrame, how: Mining) -> dict[str, DataFrame]:
    """The same six tables with targets and the backgrounds selected (candidates go), ``pairs``, and ``report`` (one row).

    Inputs aren't written to: the caller puts the result where it likes. Embeddings of blocks follow their block, those
    of atoms their atom's work, those of works and topics the work."""
    raw = embeddings.where("owner_type = 'work' and scope = 'work'").select(F.col("owner_id").alias("id"), "vector")
    rows = works.select("id", "set").join(raw, "id").join(splits.select("id", "split"), "id", "left")
    sides = rows.where("set = 'target'"), rows.where("set = 'background'")
    search = hard_negatives.by_centroid if how.strategy == "target-centroid" else hard_negatives.per_target
    pairs = search(*sides, how.per_target, how.split_aware)
    chosen = hard_negatives.selected(pairs, how.most)
    kept = works.where("set = 'target'").select(F.col("id").alias("work_id")).unionByName(chosen.select(F.col("background_id").alias("work_id")))
    whole = hard_negatives.keep_works({"works": works, "blocks": blocks, "atoms": atoms, "topics": topics, "splits": splits}, kept, {"works": "id", "blocks": "work_id", "atoms": "work_id", "topics": "work_id", "splits": "id"})
    owners = kept.select(F.col("work_id").alias("owner_id"), F.explode(F.array(F.lit("work"), F.lit("topic"))).alias("owner_type"))
    for kind in ("block", "atom"):
        owners = owners.unionByName(whole[f"{kind}s"].select(F.col("id").alias("owner_id"), F.lit(kind).alias("owner_type")))
    left = pairs.join(chosen.select("background_id"), "background_id", "left_semi")
    report = assessment.hard_negative_summary(left).join(works.agg(F.count_if(F.col("set") == "target").alias("targets"), F.count_if(F.col("set") == "background").alias("original_backgrounds")))  # two rows of one
    settings = [F.lit(x).alias(n) for n, x in (("per_target", how.per_target), ("split_aware", how.split_aware), ("strategy", how.strategy), ("max_background", how.most or None))]
    return whole | {"embeddings": embeddings.join(owners, ["owner_id", "owner_type"], "left_semi"), "pairs": left, "report": report.select(*settings, "*")}
