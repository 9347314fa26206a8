import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.config import Config
from quillspark.operators import candidates, embed, hard_negatives, leakage, parse, split, topics
from quillspark.plans import experiments, mining, pipeline, trained
from quillspark.sources import readers


def verdict(spark, candidate, target):
    c = spark.createDataFrame([(1, candidate)], "id long, text string")
    t = spark.createDataFrame([(9, target)], "target_id long, text string")
    return leakage.verdicts(c, t).first(), leakage.exact_lines(c, t).collect(), {r.phrase for r in leakage.shared_phrases(c, t).collect()}


def test_leakage(spark):
    v, lines, _ = verdict(spark, "Title: New\n\n[Verse]\nSix herons over the weir\nNothing else here is known", "[Verse]\nSix herons over the weir\nSome third thing")
    assert not v.passed and [(r.line, r.target_line) for r in lines] == [("Six herons over the weir",) * 2]
    v, _, phrases = verdict(spark, "[Verse]\nThey hid the velvet telescope beside a stove", "[Bridge]\nAfter the velvet telescope came the cold")
    assert not v.passed and "velvet telescope" in phrases
    v, lines, phrases = verdict(spark, "[Verse]\nHe was late on the stairs\nSo he ran up the hill", "[Verse]\nHe was late at noon\nThen you did not run")
    assert v.passed and not lines and not phrases


def test_runs_of_all_lengths_against_the_full_table(spark):
    rnd = random.Random(1)
    words = "a b c d e f g".split()
    cands = [(i, "\n".join(" ".join(rnd.choices(words, k=rnd.randrange(0, 12))) for _ in range(3))) for i in range(25)] + [(90, "x y z"), (91, ""), (92, None)]
    targets = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 25)))) for i in range(3)]

    def run(a, b):
        best, last = 0, {}
        for i, x in enumerate(a):
            now = {j: last.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y}
            best, last = max([best, *now.values()]), now
        return best

    want = {i: max(run((t or "").split(), u.split()) for _, u in targets) for i, t in cands}
    c, t = spark.createDataFrame(cands, "id long, text string"), spark.createDataFrame(targets, "target_id long, text string")
    for seed in (1, 3, 6):
        assert {r.id: r.run for r in leakage.longest_runs(c, t, seed).collect()} == want
    lines = {r.id: r.line_matches for r in leakage.line_counts(c, t).collect()}
    assert lines == {r.id: r.n for r in leakage.exact_lines(c, t).groupBy("id").agg(F.count("*").alias("n")).collect()}
    # words of four letters are distinctive
    long = lambda df: df.withColumn("text", F.regexp_replace("text", "[a-g]", "$0$0$0$0"))
    pairs = {r.id: r.n for r in leakage.shared_phrases(long(c), long(t)).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert pairs and {r.id: r.phrase_matches for r in leakage.phrase_counts(long(c), long(t)).collect()} == pairs


def test_csv_and_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,author,text\n"A ""q""",Bob,"two\nlines"\n\n , , \nB,Ann\n,Ann,third\n')
    rows = readers.read_rows(spark, str(tmp_path / "a.csv"))
    assert sorted((r.title, r.text) for r in rows.collect()) == [("", "third"), ('A "q"', "two\nlines"), ("B", "")]
    got = readers.import_dataset(rows, "text", exclude="bob").collect()
    assert [(r.n, r.author, r.text) for r in got] == [(1, "Ann", "third")]
    assert [readers.infer_format(x) for x in ("a.JSON", "b.jsonl", "c")] == ["json", "jsonl", "csv"]


def test_jsonl_and_upsert(spark, tmp_path):
    schema = "k string, v long"
    assert readers.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    df = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    readers.write_jsonl(df, str(tmp_path / "x"))
    readers.write_jsonl(df.limit(1), str(tmp_path / "x"), append=True)
    assert readers.read_jsonl(spark, str(tmp_path / "x"), schema).count() == 3
    new = spark.createDataFrame([("b", 5), ("b", 7), ("c", 1)], schema)
    assert sorted(tuple(r) for r in readers.upsert(df, new, ["k"], "v").collect()) == [("a", 1), ("b", 7), ("c", 1)]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()


def test_manifests_and_readiness(spark):
    rows = [("a", '{"sourceType": "openly_licensed", "works": [{"title": "x"}]}'), ("b", None), ("c", '{"sourceType": "other", "works": 3}'), ("d", "{oops")]
    got = {r.root: r for r in readers.manifest_status(spark.createDataFrame(rows, "root string, value string")).collect()}
    assert got["a"].valid and got["a"].work_count == 1 and got["b"].issues == ["there is no manifest.json"]
    assert len(got["c"].issues) == 2 and got["d"].issues == ["manifest.json can't be read as JSON"]
    counts = spark.createDataFrame([("e", 1, 0, 2, 1, False, False)], "experiment_id string, target_works long, background_works long, min_target_works long, min_background_works long, target_valid boolean, background_valid boolean")
    r = readers.readiness(counts).first()
    assert not r.ready and len(r.blockers) == 3


def test_texts(spark, tmp_path):
    (tmp_path / "Nested Work").mkdir()
    (tmp_path / "direct.txt").write_text("x")
    (tmp_path / "Nested Work" / "work.TXT").write_text("y")
    (tmp_path / "other.md").write_text("z")
    assert readers.read_texts(spark, str(tmp_path), "target", recursive=True).count() == 2
    assert readers.read_texts(spark, str(tmp_path / "missing"), "target").count() == 0


def test_hard_negatives(spark):
    t = spark.createDataFrame([(1, "train", [1.0, 0.0])], "id long, split string, vector array<double>")
    b = spark.createDataFrame([(2, "train", [1.0, 0.1]), (3, "test", [1.0, 0.0]), (4, "train", [0.0, 1.0])], "id long, split string, vector array<double>")
    assert [r.background_id for r in hard_negatives.per_target(t, b, 2).orderBy("rank").collect()] == [3, 2]
    assert [r.background_id for r in hard_negatives.per_target(t, b, 1, True).collect()] == [2]
    assert [r.background_id for r in hard_negatives.selected(hard_negatives.per_target(t, b, 3), 1).collect()] == [3]


def test_whole_run(spark, tmp_path):
    rows = []
    for i in range(24):
        word = ("river stone winter hollow" if i % 2 else "engine market signal copper").split()
        rows.append((f"lab/w{i}.txt", f"Title: Work {i}\n\n[Verse]\nThe {word[i % 4]} keeps {word[(i + 1) % 4]} number {i}\n\n[Chorus]\nAll {word[2]} and {word[3]}\n", "target" if i % 2 else "background"))
    files = spark.createDataFrame(rows, "path string, value string, set string")
    out = pipeline.run(spark, files, Config(), str(tmp_path))
    assert out["works"].count() == 24 and out["models"].count() == 8 and out["selected"].count() == 1 and out["held_out"].count() == 1
    assert out["residuals"].count() == 24 * 4 + 24 * 2 - 24 and (tmp_path / "reports" / "models.md").exists()


def test_import_limit(spark):
    rows = spark.range(700).selectExpr("id", "concat('t', id) AS title", "'Ann' AS author", "'x' AS text")
    assert [r.n for r in readers.import_dataset(rows, "id").collect()] == list(range(1, 701))
    assert [r.title for r in readers.import_dataset(rows, "id", limit=3).collect()] == ["t0", "t1", "t2"]


def test_own_targets_need_no_manifest(spark):
    rows = [("target-corpus", None), ("target-corpus/", None), ("x/target-corpus", None), ("target-corpus", "{oops")]
    got = [r.valid for r in readers.manifest_status(spark.createDataFrame(rows, "root string, value string").coalesce(1)).collect()]
    assert got == [True, True, False, False]
    counts = "experiment_id string, target_works long, background_works long, min_target_works long, min_background_works long, target_valid boolean, background_valid boolean, candidate_works long, candidate_valid boolean"
    rows = [("e", 2, 2, 1, 1, True, True, n, ok) for n, ok in ((0, False), (1, False), (1, True))]
    assert [r.ready for r in readers.readiness(spark.createDataFrame(rows, counts).coalesce(1)).collect()] == [True, False, True]


def test_json_must_be_an_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [{"text": "x"}, {"text": "y"}]')
    (tmp_path / "b.json").write_text('{"text": "x"}')
    assert readers.read_rows(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError, match="array"):
        readers.read_rows(spark, str(tmp_path / "b.json"))


def test_imported_corpus_is_read_again(spark, tmp_path):
    rows = spark.range(150).selectExpr("id", "concat('t', id) AS title", "'Ann' AS author", "concat('body ', id) AS text").repartition(3)
    folder = str(tmp_path / "c")
    readers.write_corpus(readers.import_dataset(rows, "id"), folder, "public_domain", source="x.csv", filters={"limit": 0, "includeAuthor": "Ann"})
    status = readers.manifest_status(readers.read_manifest(spark, folder)).first()
    assert status.valid and status.work_count == 150 and status.source_type == "public_domain"
    manifest = json.loads(readers.read_manifest(spark, folder).first().value)
    assert [w["title"] for w in manifest["works"]] == [f"t{i}" for i in range(150)] and manifest["filters"] == {"includeAuthor": "Ann"}
    works = parse.parse_works(readers.read_texts(spark, f"{folder}/works", "background"))
    assert {r.title for r in works.collect()} == {f"t{i}" for i in range(150)}
    with pytest.raises(ValueError):
        readers.write_corpus(rows, folder, "other")


def test_seeds(spark, tmp_path):
    for name in ("One work", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "work.txt").write_text("[Verse]\nx\n")
    works = parse.parse_works(readers.read_seeds(spark, str(tmp_path)))
    assert {r.title.replace("%20", " ") for r in works.collect()} == {"One work", "two"} and {r.set for r in works.collect()} == {"target"}
    assert readers.read_seeds(spark, str(tmp_path / "none")).count() == 0
    files = experiments.import_corpus(spark, Config(data_root=str(tmp_path), target_root=str(tmp_path)))
    assert files.count() == 2


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000, 3).selectExpr("id * 7919 % 5003 AS k", "id").repartition(7)
    got = {r.k: r.n for r in readers.numbered(rows, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got), 1)} and len(got) == rows.count()
    texts = spark.createDataFrame([("b",), ("a",), (None,), ("ab",)], "k string")
    assert {r.k: r.n for r in readers.numbered(texts, "k").collect()} == {None: 1, "a": 2, "ab": 3, "b": 4}
    assert readers.numbered(texts.limit(0), "k").collect() == []


def test_topic_providers(spark):
    works = spark.createDataFrame([("w", "lyrics", "T", "some words of a text")], "id string, domain string, title string, text string")
    topics.register_provider("fixed", lambda w, domain: w.select(F.col("id").alias("work_id"), F.lit("The style of  rain").alias("main_theme")))
    got = topics.extract_topics(works, provider="fixed").first()
    assert (got.main_theme, got.central_image, got.synthetic, got.extractor) == ("The of rain", "", False, "fixed")
    assert topics.extract_topics(works).first().extractor == "local-keyword-fallback"


def test_embeddings_of_repeated_keys_keep_apart(spark):
    rows = spark.createDataFrame([(1, "one text"), (1, "another one"), (1, "one text"), (2, "one text"), (3, None), (4, "ab")], "id long, text string")
    got = embed.hash_embedding(rows).collect()
    assert sorted(r.id for r in got) == [1, 1, 2, 3, 4]
    one = [r.vector for r in got if r.id == 2][0]
    assert any(r.vector == pytest.approx(one) for r in got if r.id == 1) and set(next(r.vector for r in got if r.id == 3)) == {0.0}


def test_run_scores_candidates_and_a_saved_model_scores_them_alike(spark, tmp_path):
    rows = []
    for i in range(24):
        word = ("river stone winter hollow" if i % 2 else "engine market signal copper").split()
        rows.append((f"lab/w{i}.txt", f"Title: Work {i}\n\n[Verse]\nThe {word[i % 4]} keeps {word[(i + 1) % 4]} number {i}\n\n[Chorus]\nAll {word[2]} and {word[3]}\n", "target" if i % 2 else "background"))
    new = [("new/a.txt", "Title: Fresh\n\n[Verse]\nA river under stone in winter\n\n[Verse]\nother\n", "candidate"), ("new/b.txt", "Title: Copied\n\n[Verse]\nThe stone keeps winter number 1\n\n[Chorus]\nAll winter and hollow\n", "candidate")]
    schema = "path string, value string, set string"
    out = pipeline.run(spark, spark.createDataFrame(rows + new, schema), Config(), str(tmp_path))
    got = {r.title: r for r in out["candidates"].collect()}
    assert set(got) == {"Fresh", "Copied"} and out["candidates"].count() == 2
    assert not got["Copied"].leak_passed and not got["Copied"].target_style and candidates.LEAK in got["Copied"].warnings
    assert candidates.NO_SECTION.format("chorus") in got["Fresh"].warnings and got["Fresh"].leak_passed
    assert got["Fresh"].target_style == (got["Fresh"].score >= got["Fresh"].threshold and ("dual_gate" not in got["Fresh"].model or got["Fresh"].target_similarity >= got["Fresh"].similarity_threshold))
    sections = {(r.work_id, r.type) for r in out["candidate_sections"].collect()}
    assert sections == {(got["Fresh"].id, "verse"), (got["Copied"].id, "verse"), (got["Copied"].id, "chorus")}
    assert trained.load(spark, str(tmp_path / "none")) is None
    loaded = trained.load(spark, str(tmp_path / "model"))
    again, parts = trained.score_files(spark, loaded, spark.createDataFrame(new, schema), Config())
    assert {r.title: (r.target_style, round(r.score, 9), r.warnings) for r in again.collect()} == {t: (r.target_style, round(r.score, 9), r.warnings) for t, r in got.items()}
    assert parts.count() == 3
    assert pipeline.load_vectors(spark, str(tmp_path)).count() == 48 and out["summary"].first().train_count == 16
    assert out["leave_topic_out"].count() > 0 and (tmp_path / "reports" / "candidates.md").exists() and (tmp_path / "reports" / "failures.md").exists()


def test_mining_stage(spark):
    rows = [(f"lab/w{i}.txt", f"Title: Work {i}\n\n[Verse]\nThe {'river' if i % 2 else 'engine'} keeps number {i} of {'stone winter' if i % 3 else 'market copper'}\n", "target" if i % 4 == 1 else "background") for i in range(32)]
    rows.append(("new/a.txt", "Title: Fresh\n\n[Verse]\nx\n", "candidate"))
    works = parse.parse_works(spark.createDataFrame(rows, "path string, value string, set string")).cache()
    blocks, atoms = parse.blocks_and_atoms(parse.parse_blocks(works))
    profiles, splits = topics.topic_profiles(works), split.assign_splits(works.where("set <> 'candidate'"), ["set"])
    vectors = embed.embed(embed.embedding_inputs(works, blocks, atoms, profiles)).cache()
    out = mining.mine(works, blocks, atoms, profiles, splits, vectors, mining.Mining(per_target=3, most=5))
    report = out["report"].first()
    assert (report.targets, report.original_backgrounds, report.backgrounds, report.max_background, report.strategy) == (8, 24, 5, 5, "per-target-nearest")
    ids = {r.id for r in out["works"].collect()}
    assert len(ids) == 13 and {r.set for r in out["works"].collect()} == {"target", "background"}
    kept = out["atoms"].collect()
    assert {r.work_id for r in kept} == {r.work_id for r in out["topics"].collect()} == {r.id for r in out["splits"].collect()} == ids
    owners = {(r.owner_type, r.owner_id) for r in out["embeddings"].collect()}
    assert {o for k, o in owners if k in ("work", "topic")} == ids and {o for k, o in owners if k == "atom"} == {r.id for r in kept}
    near = mining.mine(works, blocks, atoms, profiles, splits, vectors, mining.Mining(per_target=1, strategy="target-centroid"))
    assert near["report"].first().backgrounds == 8


def test_centroids_of_an_empty_split_take_all(spark):
    res = spark.createDataFrame([("w", "work", "work", None, [3.0, 4.0]), ("v", "work", "work", None, [3.0, 4.0])], "work_id string, owner_type string, scope string, block_type string, vector array<double>")
    splits = spark.createDataFrame([("w", "target", "train"), ("v", "target", "test")], "id string, set string, split string")
    assert pipeline.section_centroids(res, splits).first()["count"] == 1
    assert pipeline.section_centroids(res, splits, "validation").first()["count"] == 2


def plain_embedding(text):
    """The embedding's sums by the reference's rule, unit by unit."""
    text, sums = (text or "").lower(), [0.0] * 96
    for w in re.findall(r"\b[A-Za-z0-9_']+\b", text, re.ASCII):
        d = hashlib.sha256(w.encode()).digest()
        sums[d[0] % 96] += (1 + min(len(w), 12) / 12) * (1 if d[1] % 2 == 0 else -1)
    for i in range(len(text) - 2):
        d = hashlib.sha1(text[i : i + 3].encode()).digest()
        sums[d[0] % 96] += 0.15 * (1 if d[1] % 2 == 0 else -1)
    size = math.sqrt(sum(x * x for x in sums))
    return [x / size if size > 1e-12 else 0.0 for x in sums]


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 19), (7, 5)])
def test_hash_embedding_unit_by_unit(spark, monkeypatch, limits):
    """Any characters, one text over many slices, few remembered words; and no row for a unit is made."""
    monkeypatch.setattr(embed, "SLICE", limits[0])
    monkeypatch.setattr(embed, "KNOWN", limits[1])
    many = "".join(chr(0x4E00 + i) for i in range(300))
    texts = [None, "", "ab", "abc", "Don't 'tis dogs' a__b 9''9 '' x'", "\U0001f600\U0001f601 mixed \U0001f600", "straße ÜBER É", many, "the cat sat " * 40, "a\nb\tc  d", "another one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    out = embed.hash_embedding(df.unionByName(df))
    got = {r.id: r.vector for r in out.collect()}
    assert out.count() == len(texts)
    for i, t in enumerate(texts):
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[i], plain_embedding(t), strict=True)), t
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_keywords_shuffle_texts_once(spark):
    df = spark.createDataFrame([(1, "pear pear plum fig1 kiwi plum apple"), (2, ""), (3, None)], "id long, text string")
    out = topics.keywords(df)
    assert sorted((r.id, r["rank"], r.token, r.n) for r in out.collect()) == [(1, 1, "pear", 2), (1, 2, "plum", 2), (1, 3, "kiwi", 1), (1, 4, "apple", 1)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 18, 1 << 19), (30, 7, 5)])
def test_listed_ngrams_give_what_joins_give(spark, monkeypatch, limits):
    """Targets' n-grams looked up by batch, in slices and with few remembered tokens, against joins; lines, headers, empty
    and missing texts, letters that lower-casing makes ASCII; and no row for an n-gram of a candidate is made."""
    rnd = random.Random(7)
    words = "that this Heron river's stones AND winter hollow it telescope K9 Kelp straße \U0001f600 'tis we".split()
    text = lambda n: "\n".join(" ".join(rnd.choices(words, k=rnd.randrange(0, 14))) for _ in range(n))
    cands = [(i, text(rnd.randrange(1, 6))) for i in range(30)] + [(90, text(60)), (91, ""), (92, None), (93, "[heron stones river]\n\n  \n[x] winter hollow"), (94, "heron")]
    targets = [(i, text(3)) for i in range(4)] + [(8, None), (9, "[winter hollow]\nwinter hollow")]
    cands.append((95, "some words first\n" + targets[0][1]))
    c, t = spark.createDataFrame(cands, "id long, text string").repartition(3), spark.createDataFrame(targets, "target_id long, text string")
    results = lambda: [sorted(map(str, df.collect())) for df in (leakage.longest_runs(c, t), leakage.longest_runs(c, t, 3), leakage.shared_phrases(c, t), leakage.phrase_counts(c, t, 3, 4), leakage.verdicts(c, t), leakage.verdicts(c, t.limit(0)))]
    for name, value in zip(("SLICE", "TOKENS", "KNOWN"), limits):
        monkeypatch.setattr(leakage, name, value)
    assert "Generate" not in leakage._known_phrases(c, t, 2, 6)._jdf.queryExecution().executedPlan().toString()
    listed = results()
    monkeypatch.setattr(leakage, "LISTED", 0)
    assert "Generate" in leakage._known_phrases(c, t, 2, 6)._jdf.queryExecution().executedPlan().toString()
    assert listed == results() and listed[2] and listed[3] and max(int(re.search(r"run=(\d+)", r)[1]) for r in listed[0]) > 6
