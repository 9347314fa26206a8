"""Classification metrics, ROC-AUC by ranks, gates and summaries: each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACCEPTANCE, CONTROL_TYPES, GATE_MAX_FPR, RISK_HIGH, RISK_MODERATE
from .ranks import prefix_sums


def ratios(tp: Column, fp: Column, p: Column, n: Column) -> dict[str, Column]:
    """Metrics from true and false positives and the numbers of positives and negatives, with their zero guards."""
    one = lambda c: F.greatest(F.lit(1), c)
    precision, recall, specificity = tp / one(tp + fp), tp / one(p), (n - fp) / one(n)
    return {
        "accuracy": (tp + n - fp) / one(p + n),
        "balanced_accuracy": (recall + specificity) / 2,
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / F.greatest(F.lit(1e-12), precision + recall),
        "false_positive_rate": fp / one(n),
    }


def roc_auc(df: DataFrame, keys: list[str], score: str = "score", actual: str = "actual") -> DataFrame:
    """(keys, roc_auc): the Mann-Whitney statistic over tie groups; 0.5 if a class is missing.

    Equal scores are counted first, so what is ranked, in parts, is one row for each distinct score."""
    ties = df.groupBy(*keys, score).agg(F.count_if(actual).alias("_p"), F.count_if(~F.col(actual)).alias("_n"))
    below = F.col("_n_upto") - F.col("_n")
    wins = prefix_sums(ties, keys, score, ["_n"]).withColumn("_w", F.col("_p") * (below + F.col("_n") / 2)).groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return wins.select(*keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_w") / F.greatest(F.lit(1), F.col("_p") * F.col("_n"))).otherwise(0.5).alias("roc_auc"))


def evaluate(df: DataFrame, keys: list[str], predicted: Column, carry: tuple[str, ...] = (), ranked: DataFrame | None = None) -> DataFrame:
    """Metrics of df (keys, score, actual) for a prediction, and columns to carry, of which a key has one value.

    ranked: the scores that df was made of, if that took a join, which their AUC needn't wait for."""
    counts = df.withColumn("_y", predicted).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("actual") & F.col("_y")).alias("tp"),
        F.count_if(~F.col("actual") & ~F.col("_y")).alias("tn"),
        F.count_if(~F.col("actual") & F.col("_y")).alias("fp"),
        F.count_if(F.col("actual") & ~F.col("_y")).alias("fn"),
        *[F.max(c).alias(c) for c in carry],
    )
    rows = counts.withColumns(ratios(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")))
    auc = roc_auc(df if ranked is None else ranked, keys)
    return rows.join(auc, keys) if keys else rows.crossJoin(auc)  # without keys: one row and one row


def accepted() -> Column:
    """Whether a row of metrics meets all acceptance limits."""
    return (F.col("roc_auc") >= ACCEPTANCE["roc_auc"]) & (F.col("balanced_accuracy") >= ACCEPTANCE["balanced_accuracy"]) & (F.col("recall") >= ACCEPTANCE["recall"]) & (F.col("false_positive_rate") <= ACCEPTANCE["false_positive_rate"])


def gate(scores: DataFrame, predicted: Column, kinds: tuple[str, ...] = CONTROL_TYPES, limit: float = GATE_MAX_FPR) -> DataFrame:
    """A row for each control type: count, false positives, their rate, and passed (not_available without controls)."""
    spark = scores.sparkSession
    table = scores.where(F.col("control_type").isin(*kinds)).groupBy("control_type").agg(F.count(F.lit(1)).alias("count"), F.count_if(predicted).alias("false_positive_count"))
    rows = spark.createDataFrame([(k,) for k in kinds], "control_type string").join(table, "control_type", "left").na.fill(0, ["count", "false_positive_count"])
    rate = F.when(F.col("count") > 0, F.col("false_positive_count") / F.greatest(F.lit(1), F.col("count")))
    return rows.withColumn("false_positive_rate", rate).withColumn("passed", F.when(rate.isNull(), "not_available").otherwise((rate <= limit).cast("string")))


def overfit_risk(similarity: Column) -> Column:
    return F.when(similarity >= RISK_HIGH, "high").when(similarity >= RISK_MODERATE, "moderate").otherwise("low")


def similarity_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, upper median and lowest five of df (keys, similarity, id).

    The median comes from counts of equal similarities, ranked in parts; of the lowest, each task passes on five."""
    lowest = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("similarity", "id"))).where("_r <= 5")
    lowest = lowest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("similarity", "id"))).alias("lowest"))
    ties = prefix_sums(df.groupBy(*keys, "similarity").agg(F.count(F.lit(1)).alias("_c")), keys, "similarity", ["_c"])
    middle = F.floor(F.col("_c_all") / 2) + 1
    at = F.when((F.col("_c_upto") >= middle) & (F.col("_c_upto") - F.col("_c") < middle), F.col("similarity"))
    rows = ties.groupBy(*keys).agg(F.sum("_c").alias("count"), (F.sum(F.col("similarity") * F.col("_c")) / F.sum(F.when(F.col("similarity").isNotNull(), F.col("_c")))).alias("mean_similarity"), F.max(at).alias("median_similarity"))
    named = lowest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "lowest")
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] or F.lit(True)).select(*keys, "count", "mean_similarity", "median_similarity", "lowest")
