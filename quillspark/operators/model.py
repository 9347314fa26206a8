"""Centroid threshold models: scores of all eight in one plan, threshold search by prefix sums, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACCEPTANCE, CONTROL_TYPES, MODELS, STRICT_FLOOR, THRESHOLD_PAD
from ..functions.vector import centroids, cosine
from .metrics import accepted, evaluate, ratios, roc_auc
from .quadrants import Quadrants
from .ranks import prefix_sums
from .search import nearest

#: More keys than searches over models have.
MODELS_AT_MOST = 1000


def train_centroids(vectors: DataFrame) -> DataFrame:
    """(kind, target, background, near_miss) centroids of the train rows of vectors (id, set, control_type, split, kind,
    vector): a row a kind (raw, residual)."""
    near = F.when(F.col("control_type").isin(*CONTROL_TYPES) & (F.col("set") == "background"), F.lit("near_miss"))
    train = vectors.where("split = 'train' and set in ('target', 'background')").select("kind", "vector", F.explode(F.filter(F.array("set", near), lambda x: x.isNotNull())).alias("role"))
    return centroids(train, ["kind", "role"]).groupBy("kind").agg(*[F.max_by("vector", F.when(F.col("role") == r, 1)).alias(r) for r in ("target", "background", "near_miss")])


def similarities(vectors: DataFrame, wide: DataFrame) -> DataFrame:
    """vectors (kind, vector, ...) with similarities to their kind's centroids, as train_centroids gives them.

    These are at most three vectors a kind: they are joined as one row, broadcast."""
    rows = vectors.join(F.broadcast(wide.select("kind", *[F.col(r).alias(f"_{r}") for r in ("target", "background", "near_miss")])), "kind")
    sims = {"target_similarity": cosine(F.col("vector"), F.col("_target")), "background_similarity": cosine(F.col("vector"), F.col("_background"))}
    near_sim = F.when(F.col("_near_miss").isNotNull(), cosine(F.col("vector"), F.col("_near_miss")))
    return rows.withColumns(sims | {"near_miss_similarity": near_sim}).drop("_target", "_background", "_near_miss")


def centroid_similarities(vectors: DataFrame) -> DataFrame:
    """vectors (id, set, control_type, split, kind, vector) with similarities to the train centroids of their kind."""
    return similarities(vectors, train_centroids(vectors))


def nearest_targets(vectors: DataFrame, pool: DataFrame, k: int = 1, drop_self: bool = True) -> DataFrame:
    """(kind, id, neighbour, similarity, rank): the k most similar of pool for each row, ties by id: see search."""
    of = lambda df: df.select(F.col("kind").alias("part"), "id", "vector")
    return nearest(of(vectors), of(pool), k, drop_self).withColumnRenamed("part", "kind")


def model_scores(sims: DataFrame) -> DataFrame:
    """A row for each work and model: score by the model's rule."""
    t, b, n = F.col("target_similarity"), F.col("background_similarity"), F.col("near_miss_similarity")
    model = F.explode(F.when(F.col("kind") == "raw", F.array(*[F.lit(m) for m in MODELS if m.startswith("raw")])).otherwise(F.array(*[F.lit(m) for m in MODELS if not m.startswith("raw")])))
    rows = sims.withColumn("model", model)
    score = F.when(F.col("model").endswith("target_similarity"), t).when(F.col("model").contains("contrast"), t - F.greatest(b, F.coalesce(n, b))).otherwise(t - b)
    return rows.withColumns({"score": score, "actual": F.col("set") == "target"})


def threshold_candidates(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """(keys, threshold, tp, fp, p, n): all candidate thresholds with their counts, by one pass of prefix sums in parts."""
    ties = scores.groupBy(*keys, F.col(value).alias("_v")).agg(F.count_if("actual").alias("_p"), F.count_if(~F.col("actual")).alias("_n"), F.lit(1).cast("long").alias("_k"))
    rows = prefix_sums(ties, keys, "_v", ["_p", "_n", "_k"])
    rows = rows.withColumns({"p": F.col("_p_all"), "n": F.col("_n_all"), "_cp": F.col("_p_upto"), "_cn": F.col("_n_upto"), "_first": F.col("_k_upto") == 1})
    above = F.struct(F.coalesce((F.col("_v") + F.col("_next")) / 2, F.col("_v") + THRESHOLD_PAD).alias("threshold"), (F.col("p") - F.col("_cp")).alias("tp"), (F.col("n") - F.col("_cn")).alias("fp"))
    first = F.when(F.col("_first"), F.struct((F.col("_v") - THRESHOLD_PAD).alias("threshold"), F.col("p").alias("tp"), F.col("n").alias("fp")))
    out = rows.select(*keys, "p", "n", F.explode(F.filter(F.array(first, above), lambda x: x.isNotNull())).alias("c"))
    return out.select(*keys, "c.threshold", "c.tp", "c.fp", "p", "n")


def measured(candidates: DataFrame) -> DataFrame:
    """candidates with their metrics, but for the AUC, which all candidates of a model share."""
    return candidates.withColumns(ratios(F.col("tp"), F.col("fp"), F.col("p"), F.col("n")))


def _order(*more: Column) -> list[Column]:
    return [F.round("balanced_accuracy", 12).desc(), F.round("false_positive_rate", 12).asc(), F.round("recall", 12).desc(), *more]


def _best() -> Column:
    """The threshold of the best of a model's measured candidates, by the same order; of equals the lowest."""
    rank = F.struct(-F.round("balanced_accuracy", 12), F.round("false_positive_rate", 12), -F.round("recall", 12), "threshold")
    return F.min_by("threshold", rank).alias("threshold")


def choose_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): the best candidate; of equals the lowest."""
    return measured(threshold_candidates(scores, keys)).groupBy(*keys).agg(_best())


def choose_strict_threshold(scores: DataFrame, keys: list[str], floor: float = STRICT_FLOOR) -> DataFrame:
    """The floor if it is acceptable, else the largest acceptable candidate, else the best one."""
    at_floor = evaluate(scores, keys, F.col("score") >= floor)
    met = at_floor.select(*keys, "roc_auc", F.when(accepted(), F.lit(floor)).alias("_floor"))
    # the AUC is the model's, not a candidate's: it is tested once, below
    rows = measured(threshold_candidates(scores, keys)).withColumn("roc_auc", F.lit(1.0))
    found = rows.groupBy(*keys).agg(_best(), F.max(F.when(accepted(), F.col("threshold"))).alias("_largest"))
    largest = F.when(F.col("roc_auc") >= ACCEPTANCE["roc_auc"], F.col("_largest"))
    return found.join(met, keys).select(*keys, F.coalesce("_floor", largest, "threshold").alias("threshold"))


def choose_dual_gate(scores: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """(keys, threshold, similarity_threshold): the best pair of margin and similarity candidates; zeros without any.

    Of the pairs of equal metrics the one with the largest similarity, then margin; strict: of those acceptable, the
    largest similarity comes first. The pairs' grid isn't built: see quadrants. Keys are models, searched one by one."""
    some = scores.select(*keys, F.col("score").alias("x"), F.col("target_similarity").alias("y"), "actual")
    sizes = some.groupBy(*keys).agg(F.count_if("actual").alias("_p"), F.count_if(~F.col("actual")).alias("_n"))
    rows = []
    for r in sizes.limit(MODELS_AT_MOST + 1).collect():
        if len(rows) == MODELS_AT_MOST:
            raise ValueError(f"over {MODELS_AT_MOST} models")
        own = [r[k] for k in keys]
        same = F.lit(True)
        for k, v in zip(keys, own):
            same = same & F.col(k).eqNullSafe(F.lit(v))
        points = some.where(same & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y")
        points = points.agg(F.count_if("actual").alias("p"), F.count_if(~F.col("actual")).alias("n")).persist()
        found = None
        if not points.isEmpty() and (not strict or roc_auc(scores.where(same), []).first()[0] >= ACCEPTANCE["roc_auc"]):
            pairs = Quadrants(points, r["_p"], r["_n"])
            found = pairs.strictest() if strict else pairs.best()
        rows.append((*own, *(pairs.thresholds(*found) if found else (0.0, 0.0))))
        points.unpersist()
    kinds = dict(some.dtypes)
    return scores.sparkSession.createDataFrame(rows, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "threshold double", "similarity_threshold double"]))


def compare_models(scores: DataFrame, split: str = "validation") -> DataFrame:
    """A row for each model: its thresholds, chosen on the split, and metrics there."""
    rows = scores.where(F.col("split") == split)
    one = lambda m: rows.where(F.col("model") == m)
    plain = choose_threshold(rows.where(~F.col("model").contains("gate") & ~F.col("model").contains("contrast_strict")), ["model"]).withColumn("similarity_threshold", F.lit(None).cast("double"))
    strict = choose_strict_threshold(one("residual_near_miss_contrast_strict"), ["model"]).withColumn("similarity_threshold", F.lit(None).cast("double"))
    dual = choose_dual_gate(one("residual_margin_dual_gate"), ["model"], False)
    tight = choose_dual_gate(one("residual_margin_strict_dual_gate"), ["model"], True)
    chosen = plain.unionByName(strict).unionByName(dual).unionByName(tight)
    return evaluate_models(rows, chosen, ("threshold", "similarity_threshold"))


def evaluate_models(scores: DataFrame, chosen: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of scores (model, score, target_similarity, actual) for chosen thresholds; carry: columns of chosen."""
    rows = scores.join(F.broadcast(chosen.select("model", "threshold", "similarity_threshold")), "model")
    return evaluate(rows, ["model"], predicted(), carry, scores)


def predicted() -> Column:
    floor = F.coalesce(F.col("target_similarity") >= F.col("similarity_threshold"), F.lit(True))
    return (F.col("score") >= F.col("threshold")) & floor


def select_model(compared: DataFrame) -> DataFrame:
    """The one model selected: accepted residual models first, the accepted strict contrast before all."""
    ok, residual = accepted(), F.col("model").startswith("residual")
    strict = (F.col("model") == "residual_near_miss_contrast_strict") & ok
    prefer = ["residual_near_miss_contrast_strict", "residual_near_miss_contrast", "residual_margin_strict_dual_gate", "residual_margin_dual_gate"]
    rank = F.coalesce(*[F.when(F.col("model") == m, F.lit(i)) for i, m in enumerate(prefer)], F.lit(9))
    place = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    return compared.orderBy((ok & residual).desc(), strict.desc(), F.round("balanced_accuracy", 12).desc(), F.round("roc_auc", 12).desc(), *_order(rank.asc(), place.asc())).limit(1)


def section_scores(residuals: DataFrame, blocks: DataFrame, sections: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(work_id, type, similarities, style_margin): the first block of each of the section types against the centroids
    of that type (set, block_type, vector); no row without a target centroid, 0 for a missing background one."""
    first = residuals.where(F.col("block_type").isin(*types)).join(blocks.select(F.col("id").alias("owner_id"), "index"), "owner_id").groupBy("work_id", F.col("block_type").alias("type")).agg(F.min_by("vector", "index").alias("vector"))
    of = lambda name, to: sections.where((F.col("set") == name) & F.col("block_type").isNotNull()).select(F.col("block_type").alias("type"), F.col("vector").alias(to))
    rows = first.join(F.broadcast(of("target", "_t")), "type").join(F.broadcast(of("background", "_b")), "type", "left")  # a row a section type
    rows = rows.withColumns({"target_similarity": cosine(F.col("vector"), F.col("_t")), "background_similarity": cosine(F.col("vector"), F.col("_b"))})
    return rows.select("work_id", "type", "target_similarity", "background_similarity", (F.col("target_similarity") - F.col("background_similarity")).alias("style_margin"))


def overall_style_score(margin: Column) -> Column:
    return F.floor((margin + 1) / 2 * 100 + 0.5).cast("long")


def leave_one_out(vectors: DataFrame, group: str = "id") -> DataFrame:
    """(group, id, similarity): each target against the centroid of those of other groups, by sums less the group's.

    Sums are one row a group and place; the total has one row a place."""
    cells = vectors.select(F.col(group).alias("_g"), F.posexplode("vector").alias("_pos", "_x")).groupBy("_g", "_pos").agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).alias("_c"))
    total = cells.groupBy("_pos").agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    rest = cells.join(F.broadcast(total), "_pos").where("_tc > _c").select("_g", "_pos", ((F.col("_ts") - F.col("_s")) / (F.col("_tc") - F.col("_c"))).alias("_m"))
    means = rest.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_pos", "_m"))).alias("_v")).select("_g", F.col("_v._m").alias("_v"))
    return vectors.withColumn("_g", F.col(group)).join(means, "_g").select(F.col("_g").alias("group"), "id", cosine(F.col("vector"), F.col("_v")).alias("similarity"))


def dataset_summary(works: DataFrame) -> DataFrame:
    """One row on works (set, split, control_type): counts by set, of generated backgrounds, and by split."""
    some = lambda c, name: F.count_if(c).alias(name)
    background = F.col("set") == "background"
    return works.agg(
        F.count(F.lit(1)).alias("works"), some(F.col("set") == "target", "target_count"), some(background, "background_count"), some(background & (F.coalesce("control_type", F.lit("")) != ""), "synthetic_background_count"),
        *[some(F.col("split") == x, f"{x}_count") for x in ("train", "validation", "test")],
    )
