"""Scoring of candidates against a trained model: nearest target, leakage gate, decision, sections, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import leakage, model
from .metrics import overfit_risk

#: What a report says about a candidate, in this order; sections that are missing come before the last two.
NO_BACKGROUND = "There is no background corpus to contrast with, so the score says less."
FAILED_MODEL = "The model missed its held-out acceptance limits: its decisions can't be relied on."
TOPIC_MODEL = "The model takes generic near misses on the same topics for targets: the score may reward topics."
RAW_MODEL = "On held-out works residual vectors were no better than raw ones."
NO_SECTION = "It has no section of type {}."
CLOSE = "It is very near to one target work: look for memorised or closely imitated text."
LEAK = "It reuses lines, distinctive phrases or long runs of words of the targets."


def warnings(present: Column, sections: tuple[str, ...], risk: Column, leak_passed: Column, has_background: Column, health: dict[str, Column] | None = None) -> Column:
    """The warnings of a candidate, in their order. health: whether criteria of the last evaluation were met (null: unknown)."""
    health = health or {}
    failed = lambda name: ~health[name] if name in health else F.lit(False)
    parts = [F.when(~has_background, NO_BACKGROUND), F.when(failed("meets"), FAILED_MODEL), F.when(failed("same_topic_near_miss_rejection"), TOPIC_MODEL), F.when(failed("residual_beats_raw_baseline"), RAW_MODEL)]
    parts += [F.when(~F.array_contains(present, s), NO_SECTION.format(s)) for s in sections]
    parts += [F.when(risk == "high", CLOSE), F.when(~leak_passed, LEAK)]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def decision(leak_passed: Column) -> Column:
    """Whether a scored row (model, score, target_similarity, threshold, similarity_threshold) is taken for a target's:
    no leakage, the model's threshold, and for gates on similarity their floor, without which none passes."""
    gated = F.col("model").contains("dual_gate")
    floor = F.coalesce(F.col("target_similarity") >= F.col("similarity_threshold"), F.lit(False))
    return leak_passed & (F.col("score") >= F.col("threshold")) & (~gated | floor)


def score(vectors: DataFrame, wide: DataFrame, selected: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates' vectors (id, set, kind, vector) scored by the selected model (one row: model, threshold,
    similarity_threshold): similarities, margin and nearest target by residuals, and the model's own score.

    pool: residual vectors of all targets (id, vector)."""
    sims = model.similarities(vectors, wide)
    near = model.nearest_targets(sims.where("kind = 'residual'"), pool.withColumn("kind", F.lit("residual")))
    own = sims.where("kind = 'residual'").select("id", "target_similarity", "background_similarity", (F.col("target_similarity") - F.col("background_similarity")).alias("style_margin"))
    rows = model.model_scores(sims).select("id", "model", "score").join(F.broadcast(selected.select("model", "threshold", "similarity_threshold")), "model")
    rows = rows.join(own, "id").join(near.select("id", "neighbour", F.col("similarity").alias("neighbour_similarity")), "id", "left")
    return rows.withColumns({"overall_style_score": model.overall_style_score(F.col("style_margin")), "overfit_risk": overfit_risk(F.coalesce("neighbour_similarity", F.lit(0.0)))})


def judge(scored: DataFrame, texts: DataFrame, targets: DataFrame, present: DataFrame, sections: tuple[str, ...], has_background: Column, health: dict[str, Column] | None = None) -> DataFrame:
    """scored with the leakage of texts (id, text) against targets (target_id, text), the decision and the warnings.

    present: (id, types), the section types that a candidate has."""
    leak = leakage.verdicts(texts, targets).withColumnRenamed("passed", "leak_passed")
    rows = scored.join(leak, "id").join(present, "id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    noted = warnings(F.col("types"), sections, F.col("overfit_risk"), F.col("leak_passed"), has_background, health)
    return rows.withColumns({"target_style": decision(F.col("leak_passed")), "warnings": noted}).drop("types")
