"""What a run has learned, as tables that can be saved, loaded again, and used to score candidates without training."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import assessment, candidates, domains, embed, model, parse, residual, topics


@dataclass
class Trained:
    """centroids: by kind, as train_centroids; sections: residual centroids by set and section type; selected: the model
    and its thresholds; pool: residual vectors of all targets; targets: their texts; health: criteria of the last
    evaluation and whether they were met, None if there was none."""

    centroids: DataFrame
    sections: DataFrame
    selected: DataFrame
    pool: DataFrame
    targets: DataFrame
    health: DataFrame | None = None

    def save(self, path: str) -> None:
        for f in fields(self):
            if (df := getattr(self, f.name)) is not None:
                df.write.mode("overwrite").parquet(f"{path}/{f.name}")


def load(spark: SparkSession, path: str) -> Trained | None:
    """The model saved at path, or None if there is none; a missing health report is None."""
    found = {}
    for f in fields(Trained):
        try:
            found[f.name] = spark.read.parquet(f"{path}/{f.name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            if f.name != "health":
                return None
            found[f.name] = None
    return Trained(**found)


def criteria(trained: Trained) -> dict:
    """The health report's criteria as literals."""
    if trained.health is None:
        return {}
    met = {r.criterion: r.met for r in assessment.small(trained.health).select("criterion", "met").collect()}
    return {k: F.lit(v) for k, v in (met | {"meets": all(met.values())}).items()}


def score_vectors(trained: Trained, works: DataFrame, blocks: DataFrame, vectors: DataFrame, residuals: DataFrame, sections: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(a row for each candidate of works with its score, decision and warnings; its section scores)."""
    of = lambda df, kind, key: df.where("owner_type = 'work' and scope = 'work'").select(F.col(key).alias("id"), F.lit(kind).alias("kind"), "vector")
    named = works.select("id", "title", F.lit("candidate").alias("set"), F.lit("").alias("control_type"))
    rows = named.join(of(vectors, "raw", "owner_id").unionByName(of(residuals, "residual", "work_id")), "id")
    scored = candidates.score(rows, trained.centroids, trained.selected, trained.pool)
    present = blocks.groupBy(F.col("work_id").alias("id")).agg(F.collect_set("type").alias("types"))
    background = F.lit(not trained.centroids.where("background is not null").isEmpty())
    judged = candidates.judge(scored, works.select("id", "text"), trained.targets, present, sections, background, criteria(trained))
    return named.select("id", "title").join(judged, "id"), model.section_scores(residuals.join(works.select(F.col("id").alias("work_id")), "work_id", "left_semi"), blocks, trained.sections, sections)


def score_files(spark: SparkSession, trained: Trained, files: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Candidate files (path, value, set) parsed, embedded and scored, without training anything."""
    domain = domains.get(config.domain, ",".join(config.section_types))
    works = domain.parse_works(files)
    blocks, atoms = parse.blocks_and_atoms(domain.parse_blocks(works))
    profiles = topics.extract_topics(works, config.domain, config.topic_provider)
    vectors = embed.embed(embed.embedding_inputs(works, blocks, atoms.limit(0), profiles), config.embedding_provider)
    res = residual.residuals(vectors.where("owner_type in ('work', 'block')"), blocks, vectors.where("owner_type = 'topic'"))
    return score_vectors(trained, works, blocks, vectors, res, domain.section_types)
