"""Experiments: corpus readiness from folders, the audit of several, and a run that waits for readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import assessment, controls, domains, parse
from ..sources import readers
from . import pipeline, reports


def corpus_state(spark: SparkSession, config: Config) -> DataFrame:
    """One row: works of each corpus folder and whether its manifest is valid, as readiness() takes it.

    Works are counted in the folders' texts by Spark; a folder that isn't there has none."""
    sides = [("target", config.target_root), ("background", config.background_root), ("candidate", config.candidate_root)]
    counts = None
    for name, root in sides:
        works = parse.parse_works(readers.read_texts(spark, root, name, recursive=True), config.domain) if root else None
        one = (works if works is not None else spark.createDataFrame([], "id string")).agg(F.count(F.lit(1)).alias("works"))
        state = readers.manifest_status(readers.read_manifest(spark, root)).agg(F.coalesce(F.bool_and("valid"), F.lit(False)).alias("valid"))
        part = one.select(F.lit(name).alias("side"), "works", F.lit(None).cast("boolean").alias("valid")).unionByName(state.select(F.lit(name).alias("side"), F.lit(0).cast("long").alias("works"), "valid"))
        counts = part if counts is None else counts.unionByName(part)
    of = lambda side, value: F.when(F.col("side") == side, F.col(value))
    return counts.agg(
        F.sum(of("target", "works")).alias("target_works"),
        F.sum(of("background", "works")).alias("background_works"),
        F.sum(of("candidate", "works")).alias("candidate_works"),
        F.coalesce(F.bool_and(of("candidate", "valid")), F.lit(False)).alias("candidate_valid"),
        F.coalesce(F.bool_and(of("target", "valid")), F.lit(False)).alias("target_valid"),
        F.coalesce(F.bool_and(of("background", "valid")), F.lit(False)).alias("background_valid"),
    ).select(F.lit(config.experiment_id).alias("experiment_id"), F.lit(config.target_name).alias("target_name"), "*", F.lit(config.min_target_works).alias("min_target_works"), F.lit(config.min_background_works).alias("min_background_works"))


def audit(readiness: DataFrame) -> DataFrame:
    """readiness rows of experiments with all_ready: whether every one of them is ready."""
    ready = readiness.agg(F.coalesce(F.bool_and("ready"), F.lit(False)).alias("all_ready"))
    return readiness.join(F.broadcast(ready))  # one row


def write_audit(spark: SparkSession, out: str, audited: DataFrame) -> None:
    """The audit as Markdown and JSON: counts and blockers, no text of any corpus."""
    reports.write_one(spark, f"{out}/reports", "audit", "Experiments", reports.flat(audited))


def import_corpus(spark: SparkSession, config: Config, sets: tuple[str, ...] = ("target", "background", "candidate")) -> DataFrame:
    """(path, value, set): the texts of the data root's raw folders; domains whose seeds are a folder for each work get
    those of the target root as well."""
    folders = {"target": "target", "background": "background", "candidate": "candidates"}
    rows = None
    for name in sets:
        part = readers.read_texts(spark, f"{config.data_root}/raw/{folders[name]}/{config.domain}", name)
        if name == "target" and domains.get(config.domain).seed == "directory-work":
            part = part.unionByName(readers.read_seeds(spark, config.target_root))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def run_experiment(spark: SparkSession, config: Config, out: str, near_misses: bool = False) -> dict[str, DataFrame]:
    """The readiness of config's folders; if they are ready, all tables of a run over them as well, and reports.
    Texts of the candidate root are scored by the model that was trained."""
    state = assessment.small(readers.readiness(corpus_state(spark, config)))
    reports.write_one(spark, out + "/reports", "readiness", "Corpus readiness", reports.flat(state))
    if not state.first()["ready"]:
        return {"readiness": state}
    files = readers.read_texts(spark, config.target_root, "target", recursive=True).unionByName(readers.read_texts(spark, config.background_root, "background", recursive=True))
    if config.candidate_root:
        files = files.unionByName(readers.read_texts(spark, config.candidate_root, "candidate", recursive=True))
    if near_misses:
        files = files.unionByName(controls.as_files(controls.hard_controls(spark), "background"))
    return {"readiness": state} | pipeline.run(spark, files, config, out)
