import hashlib
import random

import numpy as np

from quillspark.llm import multiset_hash as m


def test_homomorphic():
    a, b = "One line.\nTwo lines here.", "Three.\nTwo lines here."
    x = m.combine(m.fingerprint(a), m.fingerprint(b))
    y = m.fingerprint("Two lines here.\nThree.\nTwo lines here.\nOne line.")
    assert all(np.array_equal(p, q) for p, q in zip(x, y))
    back = m.combine(x, m.fingerprint(b), -1)
    assert m.text_of(back) == m.text_of(m.fingerprint(a))
    assert m.likeness(m.of_text(m.text_of(x)), x) == 1.0


def test_likeness_follows_shared_text():
    rnd = random.Random(1)
    sent = lambda: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(9)) + "."
    base = [sent() for _ in range(100)]
    for share in (0.0, 0.25, 0.5, 0.9):
        other = base[: int(100 * share)] + [sent() for _ in range(100 - int(100 * share))]
        assert abs(m.likeness(m.fingerprint("\n".join(base)), m.fingerprint(" ".join(other))) - share) < 0.2


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["é", "word", "x.", "\n", "𝄞"], k=rnd.randrange(0, 80)))) for i in rnd.sample(range(10_000), 150)]
    rows += [(20_000, None), (-5, ""), (20_001, "z" * 5000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, k string").repartition(4)
    got = {r.doc_id: r for r in m.fingerprint_table(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t) // 2
        e = t[: len(t) - n] + nxt[:n]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (m.text_of(m.fingerprint(t)), m.text_of(m.fingerprint(e)))
        assert r.near_next == m.likeness(m.fingerprint(t), m.fingerprint(nxt)) and r.near_edited == m.likeness(m.fingerprint(t), m.fingerprint(e))


def test_small_tables(spark):
    assert m.fingerprint_table(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = m.fingerprint_table(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(None, 1.0, hashlib.sha256(b"abab").hexdigest())]
    two = m.fingerprint_table(spark.createDataFrame([(1, "ab"), (1, "cd"), (1, "cd")], "doc_id long, text string")).collect()
    assert len(two) == 3
