"""Held-out assessment: residual against raw models, acceptance, most confident works, limitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACCEPTANCE, CONTROL_TYPES, MODELS


#: Mistakes that a failure report names.
TOLD = 20
#: More rows than a table of models, gates or criteria can have.
SMALL = 1000


def small(df: DataFrame) -> DataFrame:
    """A table of a row for each model or gate, computed once: plans that name it often stay short. Others are refused."""
    rows = df.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"a table of over {SMALL} rows isn't small")
    return df.sparkSession.createDataFrame(rows, df.schema)


def _best(where: Column) -> Column:
    """Of rows with metrics of models, the one with the largest AUC, then balanced accuracy, then the first model."""
    place = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    key = F.struct(-F.round("roc_auc", 12), -F.round("balanced_accuracy", 12), place)
    return F.min_by(F.struct("model", "roc_auc", "balanced_accuracy", "false_positive_rate"), F.when(where, key))


def residual_assessment(compared: DataFrame, tested: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: the best residual and raw models on validation, the best raw one on test, and whether the selected
    model is a residual one that is at least as good on test. All inputs have a row for each model at most."""
    cols = ["model", "roc_auc", "balanced_accuracy", "false_positive_rate"]
    chosen = tested.join(F.broadcast(selected.select("model")), "model", "left_semi")
    parts = [(compared, "validation"), (tested, "test"), (chosen, "selected")]
    rows = None
    for df, name in parts:
        part = df.select(*cols, F.lit(name).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    of = lambda part, kind: _best((F.col("part") == part) & F.col("model").startswith(kind))
    one = rows.agg(of("validation", "residual").alias("r"), of("validation", "raw").alias("w"), of("test", "raw").alias("t"), of("selected", "").alias("s"))
    s, t = F.col("s"), F.col("t")
    beats = s["model"].startswith("residual") & (F.round(s["roc_auc"] - t["roc_auc"], 12) >= 0) & (F.round(s["balanced_accuracy"] - t["balanced_accuracy"], 12) >= 0) & (F.round(s["false_positive_rate"] - t["false_positive_rate"], 12) <= 0)
    return one.select(s["model"].alias("selected_model"), F.col("r.model").alias("best_residual_validation"), F.col("w.model").alias("best_raw_validation"), t["model"].alias("best_raw_test"), F.coalesce(beats, F.lit(False)).alias("residual_beats_raw"))


def acceptance(held_out: DataFrame, gates: DataFrame, assessed: DataFrame) -> DataFrame:
    """(criterion, met) for the selected model: metrics against their limits, both gates, and residual against raw.

    A gate without controls is not met. Whether all are met is ``meets``."""
    least = [F.struct(F.lit(m).alias("criterion"), (F.col(m) <= x if m == "false_positive_rate" else F.col(m) >= x).alias("met")) for m, x in ACCEPTANCE.items()]
    rows = held_out.select(F.inline(F.array(*least)))
    names = dict(zip(CONTROL_TYPES, ("same_topic_near_miss_rejection", "attempted_lookalike_rejection")))
    name = F.coalesce(*[F.when(F.col("control_type") == k, n) for k, n in names.items()])
    rows = rows.unionByName(gates.select(name.alias("criterion"), (F.col("passed") == "true").alias("met")))
    both = F.array(F.struct(F.lit("residual_model_selected").alias("criterion"), F.col("selected_model").startswith("residual").alias("met")), F.struct(F.lit("residual_beats_raw_baseline").alias("criterion"), F.col("residual_beats_raw").alias("met")))
    return rows.unionByName(assessed.select(F.inline(both)))


def meets(accepted: DataFrame) -> DataFrame:
    return accepted.agg(F.coalesce(F.bool_and("met"), F.lit(False)).alias("meets_acceptance_criteria"))


def confident(scores: DataFrame, predicted: Column, keys: list[str], k: int = 5) -> DataFrame:
    """(keys, kind, rank, id, score): the k targets with the largest and the k backgrounds with the smallest margins
    among those predicted rightly."""
    right = scores.withColumn("_y", predicted).where(F.col("actual") == F.col("_y"))
    kind = F.when(F.col("actual"), "target").otherwise("background")
    by = F.when(F.col("actual"), -F.col("score")).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("_k", "id"))
    return right.withColumns({"kind": kind, "_k": by}).withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "kind", "rank", "id", "score")


def limitations(scores: DataFrame) -> DataFrame:
    """What the size of a held-out set (actual) doesn't allow to claim, as one row."""
    parts = F.array(
        F.when(F.col("n") < 20, "The held-out set is small: metrics show a direction only."),
        F.when(F.col("b") < 10, "There are few held-out backgrounds: false-positive rates are unstable."),
        F.lit("Scores are margins, not probabilities: they aren't calibrated."),
    )
    counts = scores.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("actual")).alias("b"))
    return counts.select(F.filter(parts, lambda x: x.isNotNull()).alias("limitations"))


def failure_report(acceptance: DataFrame, held_out: DataFrame, gates: DataFrame, tested: DataFrame, summary: DataFrame, loo: DataFrame, lto: DataFrame, compared: DataFrame) -> DataFrame:
    """(place, line): what a run that missed a criterion has to say for itself, no row if it missed none.

    All inputs have a row for each model, gate or criterion, but tested: its mistakes are named, the TOLD worst of each kind."""
    failed = [r.criterion for r in acceptance.where("not met").orderBy("criterion").limit(SMALL).collect()]
    spark = acceptance.sparkSession
    if not failed:
        return spark.createDataFrame([], "place int, line string")
    m, d = held_out.first(), summary.first()
    one = lambda model: next((r.roc_auc for r in compared.select("model", "roc_auc").collect() if r.model == model), 0.0)
    lines = ["Criteria that were missed: " + ", ".join(failed) + "."]
    if m is not None:
        lines.append(f"Held out: {m['count']} works, AUC {m.roc_auc:.3f}, balanced accuracy {m.balanced_accuracy:.3f}, recall {m.recall:.3f}, false-positive rate {m.false_positive_rate:.3f}; limits {ACCEPTANCE}.")
    lines.append(f"Backgrounds: {d.synthetic_background_count} of {d.background_count} are generated." if d.synthetic_background_count else f"Backgrounds: none of {d.background_count} is generated.")
    for g in gates.orderBy("control_type").collect():
        lines.append(f"{g.control_type}: not among the held-out works." if g.passed == "not_available" else f"{g.control_type}: {g.false_positive_count} of {g['count']} were taken for targets.")
    means = [x.agg(F.avg("similarity")).first()[0] for x in (loo, lto)]
    if None not in means:
        lines.append(f"Mean similarity with the work left out {means[0]:.3f}, with its main theme left out {means[1]:.3f}: " + ("the theme explains a part of it." if means[1] < means[0] - 0.01 else "no sign that themes explain it."))
    lines.append(f"Validation AUC of the residual margin {one('residual_margin'):.3f}, of the raw one {one('raw_margin'):.3f}.")
    for actual, name, order in ((False, "False positives", F.desc("score")), (True, "False negatives", F.asc("score"))):
        worst = [r.title for r in tested.where((F.col("actual") == actual) & (F.col("predicted_target") != actual)).orderBy(order, "id").limit(TOLD).collect()]
        lines.append(f"{name}, the worst first: " + (", ".join(worst) or "none") + ".")
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


def hard_negative_summary(rows: DataFrame) -> DataFrame:
    """One row on mined rows (target_id, background_id, similarity): numbers, and the mean of the backgrounds' maxima."""
    best = rows.groupBy("background_id").agg(F.max("similarity").alias("s"), F.count(F.lit(1)).alias("n"))
    return best.agg(F.count(F.lit(1)).alias("backgrounds"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean_similarity"))
