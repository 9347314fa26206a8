"""Cases that all operators define: extra columns of any name, nulls in any column, repeated rows, empty tables."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import embed_dedup, html_main, langid, license_scan, mixing, multiset_hash, packing, pii, simhash, warc

CLASH = ("_g", "_m", "_p", "_d", "_h", "_c", "_k", "_x", "m", "a", "h", "fp", "size", "src", "copies", "lang_pred", "score", "private_kinds", "n", "bucket", "t", "key", "x.y", "value")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def extra(df):
    return df.withColumns({c: F.lit(f"keep {c}") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the cat number {i} sat on the mat and mail a{i}@example.com came " * 3, "en", "ab"[i % 2], 1) for i in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", None, 0), (None, "the cat sat on a mat by the door", None, None, None), (3, rows[3][1], "en", "b", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(4).cache()


@pytest.mark.parametrize("stage", [langid.stage, simhash.stage, pii.stage, mixing.stage], ids=["langid", "simhash", "pii", "mixing"])
def test_stages_keep_clashing_columns(spark, docs, stage):
    plain, wide = stage(spark, docs, ""), stage(spark, extra(docs), "")
    assert plain.columns == docs.columns and wide.columns == docs.columns + list(CLASH)
    assert all(r[c] == f"keep {c}" for r in wide.collect() for c in CLASH)
    assert sorted(map(str, wide.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert stage(spark, extra(docs).limit(0), "").collect() == []


OPERATORS = {
    "multiset": multiset_hash.fingerprint_table,
    "packing": packing.pack,
    "license": license_scan.license_scan,
    "simhash": simhash.simhash_components,
    "langid": lambda d: langid.predictions(d).select("doc_id", "lang_pred", "score"),
    "pii": lambda d: pii.pseudonymize(d).select("doc_id", "text", "private_kinds"),
    "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_clashing_columns(docs, name):
    op = OPERATORS[name]
    plain = sorted(map(str, op(docs).collect()))
    assert plain == sorted(map(str, op(extra(docs)).collect())) and len(plain) >= docs.count()
    assert op(docs.limit(0)).collect() == []


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>one</p>"), (1, "http://a.org/x", "<p>one</p>"), (2, None, None), (None, "http://a.org/y", "<p>two</p>"), (3, "", "")], "page_id long, url string, html string")
    for df in (pages, extra(pages)):
        got = sorted(map(str, ((r.page_id, r.url, r.text, r.n_chars) for r in html_main.main_text(df).collect())))
        assert got == sorted(map(str, [(1, "http://a.org/x", "one", 3)] * 2 + [(2, None, "", 0), (None, "http://a.org/y", "two", 3), (3, "", "", 0)]))
    spread = [warc.read_warc(warc.write_warc(df, f"{warc.scratch_path(spark, 'edge')}"), split=64) for df in (pages, extra(pages))]
    for out in spread:
        got = sorted(map(str, ((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out.collect())))
        assert got == sorted(map(str, [(1, "response", None, 10)] * 2 + [(2, "revisit", 3, 0), (3, "response", None, 0), (None, "response", None, 10)]))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    for df in (vectors, extra(vectors)):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect())
        assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1), *((i, 0, i) for i in range(3, 8))]
    assert embed_dedup.near_duplicates(vectors.limit(0)).collect() == [] and html_main.main_text(pages.limit(0)).collect() == []


def test_very_long_texts(spark):
    """One text of some millions of characters beside short ones: every operator takes it whole."""
    line = "the cat sat on the mat under the mit licence, 4111 1111 1111 1111. "
    long = line * 20_000 + "the end"
    rows = [(1, long, "en", "a", 1), (2, line, "en", "a", 1), (3, "x" * 2_000_000, "en", "b", 1), (4, "le chat " * 20, "fr", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    by = lambda df: {r.doc_id: r for r in df.collect()}
    assert by(multiset_hash.fingerprint_table(docs))[1].n_chars == len(long)
    found = by(license_scan.license_scan(docs))
    assert len(found[1].places) == 20_000 and found[1].n_words == 20_000 * 14 + 2 and found[3].n_words == 1
    assert by(simhash.simhash_components(docs))[1].fp % 2**64 == simhash.fingerprint(long)
    assert by(langid.predictions(docs))[1].lang_pred in ("en", "fr")
    hidden = by(pii.pseudonymize(docs))
    assert hidden[1].private_kinds == ["card"] * 20_000 and len(hidden[1].text) == len(long) and hidden[1].text.endswith(" the end")
    assert by(mixing.mix(docs))[1]["size"] == 20_000 * 14 + 2
    packed = packing.pack(docs.where("doc_id <> 3")).where("doc_id = 1").selectExpr("sum(length) as n", "max(doc_tokens) as all").first()
    assert packed.n == packed["all"] > 200_000
    pages = spark.createDataFrame([(1, "http://a.org/x", f"<article><p>{long}</p></article>"), (2, "http://a.org/y", "<p>" + "word</p><p>" * 50_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_main.main_text(pages).collect()}
    assert got[1].text == long and got[2].text == " ".join(["word"] * 50_000)
    read = {r.page_id: r for r in warc.read_warc(warc.write_warc(pages, warc.scratch_path(spark, "long")), split=1000).collect()}
    assert bytes(read[1].payload).decode() == f"<article><p>{long}</p></article>"
    wide = spark.createDataFrame([(i, [1.0] * 100_000 + [float(i // 2)]) for i in range(4)], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links) for r in embed_dedup.near_duplicates(wide).collect()} == {(i, 3) for i in range(4)}
