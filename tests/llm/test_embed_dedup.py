import numpy as np

from quillspark.llm import embed_dedup


def brute(ids, vs, cosine=0.95):
    good = [v is not None and None not in v and np.isfinite(v).all() and np.any(v) for v in vs]
    n = len(ids)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(vs[i]) == len(vs[j]):
                a, b = np.float64(vs[i]), np.float64(vs[j])
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    lab = list(ids)
    for _ in range(n):
        new = [min([lab[i], *(lab[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == lab:
            break
        lab = new
    return sorted((ids[i], int(link[i].sum()), lab[i], ids[i] == lab[i]) for i in range(n))


def data():
    rng = np.random.default_rng(0)
    vs = []
    for _ in range(50):
        v = rng.standard_normal(16)
        vs.append(v)
        for _ in range(rng.integers(0, 6)):
            vs.append(v / np.linalg.norm(v) + rng.standard_normal(16) * 0.06)
    vs = [np.float32(v).tolist() for v in vs]
    vs += [vs[0]] * 7 + [vs[3]] * 2
    vs += [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0, 2.0], [1.0, 2.1], []]
    return list(range(100, 100 + len(vs))), vs


def test_against_brute_force(spark):
    ids, vs = data()
    df = spark.createDataFrame(list(zip(ids, vs, ids)), "vec_id long, embedding array<float>, rep long").repartition(5)
    for tile in (2048, 3):
        got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df, recall=0.99999, tile=tile).collect())
        assert got == brute(ids, vs)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_duplicates(df).collect() == []


def test_recall_at_the_shipped_parameters(spark):
    """Pairs planted just above the threshold, where hashing finds them least surely."""
    rng = np.random.default_rng(9)
    rows, want = [], set()
    for i in range(1500):
        v, w = rng.standard_normal((2, 64))
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        c = rng.uniform(0.94, 0.96)
        a, b = np.float32(v), np.float32(c * v + np.sqrt(1 - c * c) * w)
        rows += [(2 * i, a.tolist()), (2 * i + 1, b.tolist())]
        x, y = np.float64(a), np.float64(b)
        if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
            want.add(i)
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("n_links > 0").collect()
    found = {r.vec_id // 2 for r in got}
    assert found <= want and all(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got)
    assert len(found) >= 0.99 * len(want) and len(want) > 600
