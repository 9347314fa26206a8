import random
import re

import numpy as np

from quillspark.llm import mixing


def rows():
    rnd = random.Random(5)
    out = []
    for i in range(3000):
        src = rnd.choice(["hot"] * 6 + ["b", "c", None, "ä", "Z"])
        out.append((i, " ".join(["w"] * int(rnd.lognormvariate(3, 1))), src))
    return out + [(5000, None, "b"), (5001, "", None), (None, "x y", "c"), (None, "x y", "c")]


def targets(data):
    size, names = {}, sorted({s for _, _, s in data}, key=lambda s: (s is None, s or ""))
    for _, t, s in data:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        t = {s: 2.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if t[s] > 2 * size[s] + 1e-9}
        if not over:
            return size, t
        capped |= over


def test_targets_and_balance(spark):
    data = rows()
    size, want = targets(data)
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, size int").repartition(3)
    got = [mixing.mix(df, block=b).collect() for b in (4096, 4096, 64)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    source = {i: s for i, _, s in data if i is not None}
    for g in (got[0], got[2]):
        assert len(g) == len(data)
        taken = {}
        for r in g:
            s = "c" if r.doc_id is None else source[r.doc_id]
            assert abs(r.target - want[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.copies <= 2
            taken[s] = taken.get(s, 0) + r.copies * r.size
        assert all(abs(taken[s] - want[s]) <= 0.002 * want[s] + 2 for s in want)


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 1000, 500), rng.random(500)
    q = mixing.flight(size, p, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs(size @ q - size @ p) < 1e-3


def test_small_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    zero = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert [(r.copies, r.target) for r in zero] == [(0, 0.0)] * 2


def test_stage_repeats_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, f"w{i} " * 20, "en", "ab"[i % 2], 60) for i in range(200)], schema)
    out = mixing.stage(spark, df, "").collect()
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    assert len(out) == sum(copies.values()) and all(sum(r.doc_id == d for r in out) == c for d, c in copies.items())
