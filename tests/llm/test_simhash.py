import random
import re

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash


def plain(text):
    """The fingerprint by its definition, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_definition(monkeypatch):
    rnd = random.Random(8)
    texts = [None, "", "a", "a b", "A b c", "a b c a b c a b c", "É é\x0bx\x1fy\u00a0z w"]
    texts += [" ".join(rnd.choices(["the", "The", "cat", "dog\n", "\t", "é", "mat"], k=rnd.randrange(1, 60))) for _ in range(200)]
    texts.append("one two three four five " * 400)
    want = [plain(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    assert simhash.fingerprint("a b c") == int(xxhash.xxh64("a b c", seed=42).hexdigest(), 16)
    pieces = simhash.pieces
    for size in (1, 5, 64):
        monkeypatch.setattr(simhash, "pieces", lambda t, border, size=size: pieces(t, border, size))
        assert [simhash.fingerprint(t) for t in texts] == want


def brute(rows, max_diff=3):
    ids = [r[0] for r in rows]
    fps = [plain(r[1]) for r in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_diff:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 70), ids[i])
    return sorted((ids[i], fps[i], least[find(i)]) for i in range(len(rows)))


def test_against_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (1005, "x")]
    for g in range(60):
        base = rnd.choices(words, k=200)
        for c in range(rnd.choice([1, 1, 5])):
            t = list(base)
            for _ in range(c):
                t[rnd.randrange(200)] = "changed"
            rows.append((g * 10 + c, " ".join(t)))
    rows += rows[-3:]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, fp string").repartition(5)
    for tile in (8192, 2):
        got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(df, tile=tile).collect())
        assert got == brute(rows)


def test_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            x = b
            for p in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(p)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    want = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    lab = {i: i for i in range(len(fps))}
    for _ in range(50):
        for i, j in want:
            lab[i] = lab[j] = min(lab[i], lab[j])
    for tile, segments in ((8192, None), (3, None), (8192, 5), (3, 5), (8192, 6)):
        edges = simhash.link_edges(df, tile=tile, segments=segments)
        got = {r.node: r.component for r in simhash.connected_components(edges).collect()}
        assert {i: got.get(i, i) for i in lab} == lab


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).collect() == []


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "q r s t u v")], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.component_id)) for r in simhash.simhash_components(df).collect())
    assert got == ["(5, 5)", "(None, 5)", "(None, None)"]


def test_segments_grow_with_the_number_of_fingerprints():
    assert [simhash.segments_for(n) for n in (0, 10**6, 10**9, 2 * 10**10)] == [4, 4, 4, 5]
    assert simhash.segments_for(10**13) == 6
    for m in (4, 5, 6):
        turns, low = simhash.turned(m, 3)
        assert len(turns) == {4: 4, 5: 10, 6: 20}[m] and low == {4: 48, 5: 39, 6: 33}[m]


@pytest.mark.parametrize("ids", [[1, 1, 1, 2, 2, 3], [None, None, 1, 1, None, 2], [5, 4, 3, 2, 1, 0]])
def test_stage_keeps_one_row_of_each_group(spark, ids):
    texts = ["a b c d", "a b c d", "e f g h i", "e f g h i", "e f g h i", "a b c d"]
    df = spark.createDataFrame(list(zip(ids, texts, range(6))), "doc_id long, text string, n_chars long")
    got = sorted((r.text, r.doc_id) for r in simhash.stage(spark, df, "").collect())
    least = lambda t: min((i for i, x in zip(ids, texts) if x == t), key=lambda i: (i is None, i or 0))
    assert got == [(t, least(t)) for t in ("a b c d", "e f g h i")]
