import os

from quillspark.config import Config
from quillspark.operators import assessment, controls, domains, parse
from quillspark.plans import catalogue, experiments


def test_controls_are_parsed_back(spark, tmp_path):
    bg, hard = controls.background_controls(spark), controls.hard_controls(spark)
    assert bg.count() == 36 and hard.count() == 25 and bg.select("title").distinct().count() == 36
    works = parse.parse_works(controls.as_files(hard, "background"))
    want = {(r.title, r.control_type, r.text) for r in hard.collect()}
    assert {(r.title, r.metadata.synthetic_control_type, r.text) for r in works.collect()} == want
    controls.write_texts(bg, str(tmp_path / "bg"))
    from quillspark.sources import readers

    again = parse.parse_works(readers.read_texts(spark, str(tmp_path / "bg"), "background"))
    assert {(r.title, r.text) for r in again.collect()} == {(r.title, r.text) for r in bg.collect()}


def test_no_scopes_without_choruses_or_bridges(spark):
    works = spark.createDataFrame([("w", "T"), ("v", "U")], "id string, title string")
    blocks = spark.createDataFrame([("w", "verse", 0, "x"), ("v", "chorus", 0, "y"), ("v", "chorus", 1, "z")], "work_id string, type string, index int, text string")
    got = sorted(tuple(r) for r in parse.extra_scopes(works, blocks).collect())
    assert got == [("v", "all_choruses", "U\ny\nz"), ("v", "title_plus_chorus", "U\ny\nz")]


def test_domains():
    assert domains.sections_of("essay") == ("introduction", "body", "conclusion") and domains.sections_of("x") == ("section",) == Config(domain="x").sections()
    assert domains.sections_of("x", "claim, evidence,turn") == ("claim", "evidence", "turn")
    assert domains.get("lyrics").scopes and domains.get("x").scopes is None
    own = domains.Domain("own", ("part",), lambda f: f, lambda w: w)
    domains.register(own)
    assert domains.get("own") is own


def write(folder, works, manifest=True):
    os.makedirs(folder)
    for r in works.collect():
        with open(f"{folder}/{r.title.replace(' ', '-')}.txt", "w") as f:
            f.write(f"Title: {r.title}\n\n{r.text}\n")
    if manifest:
        with open(f"{folder}/manifest.json", "w") as f:
            f.write('{"sourceType": "public_domain", "works": []}')


def test_experiment_waits_for_readiness_and_runs(spark, tmp_path):
    t, b, out = (str(tmp_path / x) for x in ("t", "b", "out"))
    few = Config(target_root=t, background_root=b, experiment_id="e")
    got = experiments.run_experiment(spark, few, out)
    assert list(got) == ["readiness"] and not got["readiness"].first().ready and len(got["readiness"].first().blockers) == 2
    write(t, controls.sample_targets(spark)[0])
    write(b, controls.background_controls(spark))
    config = Config(target_root=t, background_root=b, experiment_id="e", min_background_works=36)
    got = experiments.run_experiment(spark, config, out, near_misses=True)
    assert got["readiness"].first().ready and got["works"].count() == 16 + 36 + 25
    rows = {r.criterion: r.met for r in got["acceptance"].collect()}
    assert len(rows) == 8 and all(isinstance(x, bool) for x in rows.values())
    assert isinstance(assessment.meets(got["acceptance"]).first()[0], bool)
    assert os.path.isdir(f"{out}/reports/acceptance.md")


def test_style_pipeline_keeps_its_vectors(spark):
    """All readers of the vectors scan the kept ones, so texts are embedded for two columns of them only."""
    spark.catalog.clearCache()
    out = catalogue.flagship(spark, "/root/testdata/sf0.001")
    assert "InMemoryTableScan" in out._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()
