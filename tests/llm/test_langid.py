import random
import tracemalloc
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r.lang == r.lang_pred for r in got if r.held_out]
    assert sum(out) >= 0.98 * len(out)


def test_defined_cases(spark):
    rows = [(i, "the cat sat on the mat " * 5 if i % 2 else "der hund lief um das haus " * 5, "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "123 !?", "en", 1), (102, "the mat", None, 1), (None, "das haus", "en", 1), (103, "中", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").drop("score")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predictions(df).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "en" and got[None][0] == "de"
    assert got[103][0] in ("en", "de") and got[103][1] == 0.0
    none = langid.predictions(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.predictions(df.limit(0)).collect() == []
    # the stage: no letter, only unknown n-grams, another language than the label's
    assert {r[0] for r in rows} - {r.doc_id for r in langid.stage(spark, df, "").collect()} == {100, 101, 103, None}
    german = langid.stage(spark, df, "", languages=("de",)).collect()
    assert {r.lang for r in german} == {"de"} and len(german) == 30


@pytest.mark.parametrize("n", [1, 3, 70])
def test_filters_hold_all_languages_of_a_gram(n):
    tables = {f"l{i:02}": langid.grams(f"shared own{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(n)}
    f = langid.Filters(sorted(tables), "l00", tables)
    c = f.counts(langid.grams("shared"))
    assert (c > 5).all()


def plain_grams(text):
    """n-grams of 3 and 4 characters of a text's letters, as strings."""
    out, word = [], []
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    s = f" {' '.join(out)} " if out else ""
    return [s[i : i + n] for n in (3, 4) for i in range(len(s) - n + 1)]


def test_predictions_against_sets_of_grams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    counted = {}
    for r in rows:
        counted.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    share = {k: {g: n / c.total() for g, n in c.items()} for k, c in counted.items()}
    # no language has as many n-grams here as the model takes, so all of them count
    assert all(len(c) <= langid.GRAMS_PER_LANG for c in counted.values())
    known = {k: {g for g, p in s.items() if p * langid.RATIO >= max(t.get(g, 0) for t in share.values())} for k, s in share.items()}
    df = spark.createDataFrame(docs)
    got = {r.doc_id: r for r in langid.predictions(df).collect()}
    for r in docs:
        grams = plain_grams(r.text)
        hits = sorted(((sum(g in known[k] for g in grams), k) for k in known), key=lambda x: (-x[0], x[1]))
        assert abs(got[r.doc_id].known - hits[0][0] / len(grams)) < 0.01
        if hits[0][0] - hits[1][0] > 0.01 * len(grams):
            assert got[r.doc_id].lang_pred == hits[0][1]


def test_numerals_and_signs_are_no_letters(spark):
    texts = ["½ ²", "Ⅷ ①", "_", "１２", "́", "a½b", None, ""]
    rows = [(i, "the cat sat on the mat", "en") for i in range(40)] + [(100 + i, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.lang_pred for r in langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + i] for i in range(len(texts))] == ["und"] * 5 + ["en", "und", "und"]
    assert langid.words("a½b Ⅷ c") == ["a", "b", "c"]


def test_long_texts_give_the_same_grams(monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcdé ,1Ⅷ", k=5000)) + "x" * 3000 + " end"
    whole = Counter(langid.grams(text).tolist())
    assert sum(whole.values()) == len(plain_grams(text))
    pieces = langid.pieces
    for size in (7, 100, 2500):
        monkeypatch.setattr(langid, "pieces", lambda t, border, size=size: pieces(t, border, size))
        assert Counter(langid.grams(text).tolist()) == whole


def test_long_runs_of_letters_come_in_slices(monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 1000)
    for text in ("abcdefg" * 3000, "ab " + "é" * 999 + " " + "x" * 1001, "x" * 998, "x" * 1000, "a"):
        got = list(langid.hashes(text))
        assert max(len(h) for h in got) <= 1000
        assert sum(len(h) for h in got) == len(plain_grams(text))
        # one hash for each n-gram, as often as it stands there
        assert sorted(Counter(x for h in got for x in h.tolist()).values()) == sorted(Counter(plain_grams(text)).values())


def test_training_holds_no_whole_batch(spark, monkeypatch):
    df = spark.createDataFrame([(i, "the cat", "en") for i in range(8)], "doc_id long, text string, lang string")
    taken, frame = [], type(df)
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, *a, real=frame.mapInPandas, **b: taken.append(f) or real(self, f, *a, **b))
    langid.train(df)
    rnd = random.Random(4)
    known = ["".join(rnd.choices("abcdefghé", k=rnd.randint(1, 9))) for _ in range(500)]
    texts = [" ".join(rnd.choices(known, k=20_000)) for _ in range(60)]
    batch = pd.DataFrame({"lang": ["en", "de", "en"] * 20, "text": texts})
    tracemalloc.start()
    try:
        counted = {}
        for rows in taken[0](iter([batch, batch[:0]])):
            for lang, gram, n in rows.itertuples(index=False):
                counted.setdefault(lang, Counter())[gram] += n
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 7 million characters, so some 14 million n-grams of 8 bytes
    assert peak < 64e6
    for lang, own in counted.items():
        whole = Counter()
        for t in batch.text[batch.lang == lang]:
            whole.update(langid.grams(t).view("int64").tolist())
        assert own == whole
    assert set(counted) == {"en", "de"}
