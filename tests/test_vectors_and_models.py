import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.config import MODELS
from quillspark.functions import vector as vx
from quillspark.operators import metrics, model, quadrants, ranks, residual, search, split


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit(v):
    return F.lit(v).cast("array<double>")


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_algebra(spark):
    r = one(spark, vx.dot(vec(1, 2, 3), vec(4, 5, 6)), vx.cosine(vec(1, 0), vec(0, 1)), vx.normalize(vec(3, 4)), vx.normalize(vec(0, 0)), F.size(vx.orthonormalize(F.array(vec(1, 0), vec(1, 1)))), vx.project(vec(2, 3), F.array(vec(1, 0))), vx.residualize(vec(1, 1), F.array(vec(1, 0))))
    assert r[0] == 32 and r[1] == 0 and r[2] == [0.6, 0.8] and r[3] == [0, 0] and r[4] == 2 and r[5] == [2, 0]
    assert np.allclose(r[6], [0, 1])
    with pytest.raises(Exception, match="differ in length"):
        one(spark, vx.dot(vec(1), vec(1, 2)))
    assert one(spark, vx.cosine(F.array().cast("array<double>"), vec(1)))[0] == 0


def test_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.standard_normal(8).tolist(), rng.standard_normal((3, 8)).tolist()) for _ in range(20)]
    got = spark.createDataFrame(rows, "v array<double>, b array<array<double>>").select(vx.residualize(F.col("v"), F.col("b")).alias("r"), "v", "b").collect()
    for r in got:
        q, _ = np.linalg.qr(np.array(r.b).T)
        want = np.array(r.v) - q @ (q.T @ np.array(r.v))
        assert np.allclose(r.r, want / np.linalg.norm(want)) and np.allclose(np.array(r.b) @ np.array(r.r), 0)


def test_content_basis(spark):
    b = one(spark, residual.basis_vectors(F.array(vec(1, 0), vec(0, 1)), vec(1, 1)))[0]
    assert len(b) == 4 and np.allclose(b[2], [0.5**0.5] * 2)


def test_means(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", None)], "k string, vector array<double>")
    assert [(r.k, r["count"], r.vector) for r in vx.mean_vectors(df, ["k"]).collect()] == [("a", 2, [2.0, 3.0])]


def test_split_rule(spark):
    df = spark.createDataFrame([(i, n) for n in (1, 2, 4) for i in range(n)], "i long, n long").select("*", split.split_name(F.col("i"), F.col("n")).alias("s"))
    by = {n: [r.s for r in df.where(F.col("n") == n).orderBy("i").collect()] for n in (1, 2, 4)}
    assert by == {1: ["train"], 2: ["train", "test"], 4: ["train", "train", "validation", "test"]}


def test_metrics(spark):
    df = spark.createDataFrame([(0.6, True), (-0.4, False)], "score double, actual boolean")
    r = metrics.evaluate(df, [], F.col("score") >= 0).first()
    assert (r.accuracy, r.roc_auc, r.false_positive_rate) == (1, 1, 0)
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 9)), bool(rng.integers(0, 2))) for _ in range(80)]
    pos, neg = [s for s, a in rows if a], [s for s, a in rows if not a]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(metrics.roc_auc(spark.createDataFrame(rows, "score double, actual boolean"), []).first()[0] - want) < 1e-12
    assert metrics.roc_auc(spark.createDataFrame([(1.0, True)], "score double, actual boolean"), []).first()[0] == 0.5


def test_gate(spark):
    df = spark.createDataFrame([("same_topic_generic_ai_near_miss", 0.7), ("same_topic_generic_ai_near_miss", 0.2), ("generic_pop", 0.9)], "control_type string, score double")
    got = {r.control_type: r for r in metrics.gate(df, F.col("score") >= 0.5).collect()}
    near, look = got["same_topic_generic_ai_near_miss"], got["attempted_lookalike"]
    assert (near["count"], near.false_positive_count, near.false_positive_rate, near.passed) == (2, 1, 0.5, "false")
    assert (look["count"], look.false_positive_rate, look.passed) == (0, None, "not_available")


def test_thresholds_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [("m", float(s), float(t), bool(a)) for s, t, a in zip(rng.integers(0, 12, 60) / 10, rng.integers(0, 7, 60) / 10, rng.integers(0, 2, 60))]
    df = spark.createDataFrame(rows, "model string, score double, target_similarity double, actual boolean")
    s, t, a = (np.array([r[i] for r in rows]) for i in (1, 2, 3))

    def cands(x):
        v = np.unique(x)
        return [v[0] - 1e-6, *((v[:-1] + v[1:]) / 2), v[-1] + 1e-6]

    def key(y):
        recall, fpr = (y & a).sum() / a.sum(), (y & ~a).sum() / (~a).sum()
        return round((recall + 1 - fpr) / 2, 12), -round(fpr, 12), round(recall, 12)

    best = min(cands(s), key=lambda c: ([-x for x in key(s >= c)], c))
    assert abs(model.choose_threshold(df, ["model"]).first().threshold - best) < 1e-9
    pair = min(((c, d) for c in cands(s) for d in cands(t)), key=lambda p: ([-x for x in key((s >= p[0]) & (t >= p[1]))], -p[1], -p[0]))
    got = model.choose_dual_gate(df, ["model"], False).first()
    assert abs(got.threshold - pair[0]) < 1e-9 and abs(got.similarity_threshold - pair[1]) < 1e-9
    assert [(r.threshold, r.similarity_threshold) for r in model.choose_dual_gate(df, ["model"], True).collect()] == [(0.0, 0.0)]


def test_prefix_sums_in_parts(spark):
    """Values within a part, over parts, outside the range, null and not a number, against one ordered list."""
    rng = np.random.default_rng(8)
    values = [None, float("nan"), *sorted({*rng.normal(0, 0.3, 60).tolist(), *(0.1 + 1e-9 * i for i in range(9)), -7.5, -2.0, 2.0, 9.25, 9.5})]
    rows = [(k, v, int(rng.integers(0, 5))) for k in ("a", None) for v in values]
    place = lambda v: (v is not None, v is not None and v != v, 0.0 if v is None or v != v else v)
    got = {(r.k, str(r.v)): r for r in ranks.prefix_sums(spark.createDataFrame(rows, "k string, v double, c long").repartition(5), ["k"], "v", ["c"]).collect()}
    assert len(got) == len(rows)
    for k in ("a", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: place(r[1]))
        for i, (_, v, c) in enumerate(mine):
            r = got[k, str(v)]
            assert (r.c, r.c_upto, r.c_all) == (c, sum(x[2] for x in mine[: i + 1]), sum(x[2] for x in mine))
            assert str(r["_next"]) == str(mine[i + 1][1] if i + 1 < len(mine) else None)


def test_similarity_summary(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(rng.integers(-3, 9)) / 10) for k, n in (("a", 41), ("b", 12), ("c", 1)) for i in range(n)]
    got = {r.k: r for r in metrics.similarity_summary(spark.createDataFrame(rows, "k string, id long, similarity double"), ["k"]).collect()}
    for k, r in got.items():
        mine = sorted((s, i) for x, i, s in rows if x == k)
        assert (r["count"], r.median_similarity, [tuple(x) for x in r.lowest]) == (len(mine), mine[len(mine) // 2][0], mine[:5])
        assert abs(r.mean_similarity - np.mean([s for s, _ in mine])) < 1e-12
    assert len(got) == 3


def test_nearest_against_brute_force(spark, monkeypatch):
    """Several blocks on both sides, copies that tie, zero and missing vectors, own rows dropped or not."""
    monkeypatch.setattr(search, "POOL_BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(6)
    made = rng.normal(size=(50, 7))
    made[20:35] = made[20]
    rows = [(p, f"{p}{i:02d}", None if i == 48 else [] if i == 47 else [0.0] * 7 if i == 49 else made[i].tolist()) for p in "xy" for i in range(50)]
    df = spark.createDataFrame(rows, "part string, id string, vector array<double>").repartition(3)

    def cos(a, b):
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a and b and any(a) and any(b) else 0.0

    for drop, pool in ((True, rows), (False, [r for r in rows if r[0] == "x" and int(r[1][1:]) % 3 == 0])):
        some = df.join(spark.createDataFrame([(r[1],) for r in pool], "id string"), "id", "left_semi")
        got: dict = {}
        for r in search.nearest(df, some, 4, drop).collect():
            got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.similarity))
        for p, i, v in rows:
            want = sorted((-round(cos(v, w), 9), j) for q, j, w in pool if q == p and not (drop and i == j))[:4]
            mine = sorted(got.get(i, []))
            assert [(n, -round(s, 9)) for _, n, s in mine] == [(j, s) for s, j in want] and [r for r, *_ in mine] == list(range(1, len(want) + 1))
    assert search.nearest(df, df.limit(0), 2).collect() == [] and search.nearest(df.limit(0), df, 2).collect() == []
    with pytest.raises(Exception, match="differ in length"):
        search.nearest(df, spark.createDataFrame([("x", "z", [1.0])], df.schema), 1).collect()


def test_model_ids():
    assert MODELS[0] == "residual_margin" and MODELS[-1] == "raw_target_similarity" and len(MODELS) == 8


def grid_best(x, y, a, strict):
    """The best pair by the whole grid of both candidates' counts."""
    xs, ys = np.unique(x), np.unique(y)
    cands = lambda v: np.array([v[0] - 1e-6, *((v[:-1] + v[1:]) / 2), v[-1] + 1e-6])
    tp, fp = (np.zeros((len(xs) + 1, len(ys) + 1), int) for _ in "ab")
    for side, of in ((tp, a), (fp, ~a)):
        np.add.at(side, (np.searchsorted(xs, x[of]), np.searchsorted(ys, y[of])), 1)
        side[:] = side[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    p, n = max(1, a.sum()), max(1, (~a).sum())
    i, j = np.meshgrid(np.arange(len(xs) + 1), np.arange(len(ys) + 1), indexing="ij")
    recall, fpr = tp / p, fp / n
    ba = np.round((recall + (n - fp) / n) / 2, 12)
    ok = (recall >= 0.85) & (fpr <= 0.15) & ((recall + (n - fp) / n) / 2 >= 0.85) if strict else np.ones(tp.shape, bool)
    if not ok.any():
        return None
    by = np.lexsort((i[ok], j[ok], -fp[ok], ba[ok])) if not strict else np.lexsort((i[ok], -fp[ok], ba[ok], j[ok]))
    return cands(xs)[i[ok][by[-1]]], cands(ys)[j[ok][by[-1]]]


@pytest.mark.parametrize("seed", range(6))
def test_dual_gate_against_the_whole_grid(spark, seed, monkeypatch):
    """Few and many values, any number of blocks, sums beyond 64 bits, acceptable pairs and none."""
    rng = np.random.default_rng(seed)
    n, steps, block = [(40, 5, 4), (300, 40, 16), (300, 10**6, 7), (900, 10**6, 60), (500, 30, 500), (700, 200, 25)][seed]
    a = rng.random(n) < 0.3
    x, y = (np.round((rng.normal(0, 0.2, n) + (0.28, 0.45, 0.6)[seed % 3] * a) * steps) / steps for _ in "ab")
    if seed % 2:
        monkeypatch.setattr(quadrants, "EXACT", 1)
    df = spark.createDataFrame([(float(s), float(t), int(b), int(not b)) for s, t, b in zip(x, y, a)], "x double, y double, p long, n long").groupBy("x", "y").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    pairs = quadrants.Quadrants(df, int(a.sum()), int((~a).sum()), block)
    for strict, found in ((False, pairs.best()), (True, pairs.strictest())):
        want = grid_best(x, y, a, strict)
        assert (found is None) == (want is None)
        assert want is None or np.allclose(pairs.thresholds(*found), want, rtol=0, atol=1e-12)


def test_dual_gate_of_many_scores(spark):
    """24,000 scores: a grid of their candidates had 6 x 10^8 cells. Targets are those beyond both thresholds."""
    n = 24_000
    x, y = F.pmod(F.col("id") * 7919, n) / n, F.pmod(F.col("id") * 104_729, n) / n
    df = spark.range(n).select(F.lit("m").alias("model"), x.alias("score"), y.alias("target_similarity"))
    df = df.withColumn("actual", (F.col("score") >= 0.6) & (F.col("target_similarity") >= 0.2)).persist()
    rows = df.where("actual").agg(F.min("score"), F.min("target_similarity")).first()
    for strict in (False, True):
        r = model.choose_dual_gate(df, ["model"], strict).first()
        got = metrics.evaluate(df, ["model"], (F.col("score") >= r.threshold) & (F.col("target_similarity") >= r.similarity_threshold)).first()
        assert got.recall >= 0.85 and got.false_positive_rate <= 0.15
        assert strict or (got.balanced_accuracy == 1 and abs(r.threshold - rows[0]) < 1e-3 and abs(r.similarity_threshold - rows[1]) < 1e-3)
        assert not strict or r.similarity_threshold > rows[1]
    df.unpersist()
