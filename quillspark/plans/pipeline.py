"""The whole batch run: texts to works, splits, topics, embeddings, residuals, models, evaluation, candidates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.vector import centroids
from ..operators import assessment, domains, embed, metrics, model, parse, residual, split, topics
from . import reports
from .mining import Mining, mine
from .trained import Trained, score_vectors

OF_WORK = "owner_type = 'work' and scope = 'work'"


def model_vectors(works: DataFrame, splits: DataFrame, embeddings: DataFrame, residuals: DataFrame) -> DataFrame:
    """(id, title, set, split, control_type, kind, vector): raw and residual vectors of works that have a split."""
    of = lambda df, kind, key: df.where(OF_WORK).select(F.col(key).alias("id"), F.lit(kind).alias("kind"), "vector")
    labelled = works.select("id", "title", "set", F.coalesce("metadata.synthetic_control_type", F.lit("")).alias("control_type")).join(splits.select("id", "split"), "id")
    return labelled.join(of(embeddings, "raw", "owner_id").unionByName(of(residuals, "residual", "work_id")), "id")


def load_vectors(spark: SparkSession, out: str) -> DataFrame:
    """model_vectors of the tables that a run has written to out."""
    return model_vectors(*(spark.read.parquet(f"{out}/{name}") for name in ("works", "splits", "embeddings", "residuals")))


def section_centroids(residuals: DataFrame, splits: DataFrame, part: str = "train") -> DataFrame:
    """Residual centroids by (set, owner_type, scope, block_type) of one split's works; of all, if the split is empty."""
    some = splits.where(F.col("split") == part)
    rows = splits if some.isEmpty() else some
    return centroids(residuals.join(rows.select(F.col("id").alias("work_id"), "set"), "work_id"), ["set", "owner_type", "scope", "block_type"])


def run(spark: SparkSession, files: DataFrame, config: Config, out: str | None = None, mining: Mining | None = None) -> dict[str, DataFrame]:
    """files (path, value, set) to all tables of a run, by name, and ``model`` (a Trained). Candidates among the files
    are scored. With ``mining``, only the backgrounds that it selects go on, and no candidates.

    With ``out``, the tables that others are made of are written there and read again, and so are the model and the
    reports; without, they are kept by persist(), which the caller ends by spark.catalog.clearCache()."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        if not out:
            return df.persist()
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    domain = domains.get(config.domain, ",".join(config.section_types))
    works = keep(domain.parse_works(files), "works")
    blocks, atoms = parse.blocks_and_atoms(domain.parse_blocks(works))
    splits = split.assign_splits(works.where("set in ('target', 'background')"), ["set"], config.seed)
    profiles = topics.extract_topics(works, config.domain, config.topic_provider)
    scopes = domain.scopes(works, blocks) if domain.scopes else None
    vectors = keep(embed.embed(embed.embedding_inputs(works, blocks, atoms, profiles, scopes), config.embedding_provider), "embeddings")
    mined: dict[str, DataFrame] = {}
    if mining:
        mined = mine(works, blocks, atoms, profiles, splits, vectors, mining)
        works, blocks, atoms, profiles, splits, vectors = (keep(mined[n], f"mined/{n}") for n in ("works", "blocks", "atoms", "topics", "splits", "embeddings"))
    splits = keep(splits, "splits")
    res = keep(residual.residuals(vectors.where("owner_type in ('work', 'block')"), blocks, vectors.where("owner_type = 'topic'")), "residuals")
    rows = model_vectors(works, splits, vectors, res)
    wide = assessment.small(model.train_centroids(rows))
    scores = keep(model.model_scores(model.similarities(rows, wide)), "scores")
    compared = assessment.small(model.compare_models(scores))
    chosen = assessment.small(model.select_model(compared))
    tested = scores.where("split = 'test'").join(F.broadcast(chosen.select("model", "threshold", "similarity_threshold")), "model").withColumn("predicted_target", model.predicted())
    held_out = assessment.small(metrics.evaluate(tested, ["model"], F.col("predicted_target")))
    gates = assessment.small(metrics.gate(tested, F.col("predicted_target")))
    assessed = assessment.small(assessment.residual_assessment(compared, model.evaluate_models(scores.where("split = 'test'"), compared), chosen))
    accepted = assessment.small(assessment.acceptance(held_out, gates, assessed))
    pool = res.where(OF_WORK).select(F.col("work_id").alias("id"), "vector").join(works.where("set = 'target'").select("id"), "id", "left_semi")
    theme = F.coalesce(F.nullif("main_theme", F.lit("")), F.lit("unknown"))
    themed = pool.join(profiles.select(F.col("work_id").alias("id"), theme.alias("theme")), "id")
    loo, lto = model.leave_one_out(pool), model.leave_one_out(themed, "theme")
    by_section = section_centroids(res, splits)
    summary = assessment.small(model.dataset_summary(works.select("id", "set", F.col("metadata.synthetic_control_type").alias("control_type")).join(splits.select("id", "split"), "id")))
    learned = Trained(wide, by_section.where("block_type is not null"), chosen, pool, works.where("set = 'target'").select(F.col("id").alias("target_id"), "text"), accepted)
    tables = {
        "works": works, "blocks": blocks, "atoms": atoms, "splits": splits, "topics": profiles, "embeddings": vectors, "residuals": res, "centroids": by_section,
        "atom_features": domain.atom_features(atoms), "work_features": domain.work_features(works.select(F.col("id").alias("work_id")), blocks, atoms),
        "scores": scores, "models": compared, "selected": chosen, "held_out": held_out, "summary": summary,
        "gates": gates, "assessment": assessed, "acceptance": accepted,
        "confident": assessment.confident(tested, F.col("predicted_target"), ["model"]), "limitations": assessment.limitations(tested),
        "leave_one_out": loo, "leave_topic_out": lto, "failures": assessment.failure_report(accepted, held_out, gates, tested, summary, loo, lto, compared),
    }
    new = works.where("set = 'candidate'")
    if not new.isEmpty():
        tables["candidates"], tables["candidate_sections"] = score_vectors(learned, new, blocks, vectors, res, domain.section_types)
    if mined:
        tables |= {"hard_negative_pairs": mined["pairs"], "hard_negative_report": mined["report"]}
    if out:
        learned.save(f"{out}/model")
        reports.write(spark, f"{out}/reports", tables)
    return tables | {"model": learned}
