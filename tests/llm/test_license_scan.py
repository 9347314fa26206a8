import random
import re

from quillspark.llm import license_scan as ls


def test_places_and_fuzzy_matches(spark):
    rows = [
        (1, "Licensed under the MIT License. Again: under-the mit license"),
        (2, "Under teh MIT licence, and Apache Licence, Version 2.0; CC-BY-NC"),
        (3, "under the BSD license; under the MPL license; Apache License Version 1; cc by nd"),
        (4, None),
        (5, "éunder the mit licenses"),
        (6, "under the mit\nlicense under the mit license"),
        (7, ""),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in ls.license_scan(df).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = sorted((k, n.label) for n in ls.NOTICES for k in range(len(words)) if words[k : k + len(n.phrase.split())] == n.phrase.split())
        assert got[i].n_words == len(words)
        assert sorted((p.word, p.label) for p in got[i].places if not p.edits) == want
    near = {i: sorted((p.label, p.edits) for p in r.places if p.edits) for i, r in got.items()}
    assert near[2] == [("apache-2", 1), ("mit", 2)] or near[2] == [("apache-2", 1)]
    assert near[3] == [] and near[6] == []
    assert ls.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_edits_within_the_bound_are_found():
    m = [ls.Matcher(n) for n in ls.NOTICES]
    for text, label, edits in [("under the mit licence", "mit", 1), ("nder th mit license", "mit", 2), ("apace license version 2", "apache-2", 1), ("ccby nc", "cc-by-nc", 1), ("xx under the mit lcense yy", "mit", 1)]:
        _, found = ls.scan(text, m)
        assert [(f[0], f[3]) for f in found] == [(label, edits)], text
    for text in ("on the mit license", "under the mit lic", "apache license version 3", "cc by sa"):
        assert ls.scan(text, m)[1] == [], text


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least(notice, span):
    """Edits of a run of words against a notice whose exact words stand in it, by all ways to place them."""
    words = notice.phrase.split(" ")
    cut = next((i for i, w in enumerate(words) if w in notice.exact), None)
    if cut is None:
        return edits(notice.phrase, span)
    before, after = " ".join([*words[:cut], ""]), " ".join(["", *words[cut + 1 :]])
    rest, best, parts = notice._replace(phrase=after), 99, span.split(" ")
    for i, w in enumerate(parts):
        if w == words[cut]:
            left, right = " ".join([*parts[:i], ""]), " ".join(["", *parts[i + 1 :]])
            left, right = left if cut or i else "", right
            best = min(best, edits(before if cut else "", left if cut else left.strip(" ")) + least(rest, right))
    return best


def brute(text, notice):
    """(start word, words, edits) by all runs of words; inexact ones by edits, start and length, none that overlaps."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = []
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 14) + 1):
            span = " ".join(words[i:j])
            if abs(len(span) - len(notice.phrase)) <= notice.errors and (e := least(notice, span)) <= notice.errors:
                found.append((e, i, len(span), j))
    out = [(i, j, 0) for e, i, _, j in found if not e]
    for e, i, _, j in sorted(found):
        if e and not any(a < j and i < z for a, z, _ in out):
            out.append((i, j, e))
    return sorted((i, j - i, e) for i, j, e in out)


def test_all_places_against_brute_force():
    rnd = random.Random(4)
    alone = {n.label: ls.Matcher(n) for n in ls.NOTICES}
    for _ in range(400):
        n = rnd.choice(ls.NOTICES)
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            p = list(rnd.choice([n.phrase, n.phrase, rnd.choice(ls.NOTICES).phrase, "some of the other words", "license under"]))
            for _ in range(rnd.randrange(0, 4)):
                at = rnd.randrange(len(p))
                p[at : at + rnd.choice([0, 1, 1])] = rnd.choice(["", "x", " ", "e", "li"])
            parts.append("".join(p))
        text = rnd.choice([" ", ", ", " and "]).join(parts)
        got = sorted((f[1], f[2], f[3]) for f in ls.scan(text, [alone[n.label]])[1])
        assert got == brute(text, n), (n, text)


def test_places_beside_exact_ones_are_found():
    m = [ls.Matcher(n) for n in ls.NOTICES]
    for text, want in [
        ("under the mit licence under the mit license", [("mit", 0, 1), ("mit", 4, 0)]),
        ("under teh mit license under the mit license", [("mit", 0, 2), ("mit", 4, 0)]),
        ("apache licence version 2 apache license version 2", [("apache-2", 0, 1), ("apache-2", 4, 0)]),
        ("under the mit license under the mit licence", [("mit", 0, 0), ("mit", 4, 1)]),
        ("GNU General Public Licence, version 3.", [("gpl-3", 0, 1)]),
        ("the BSD-3-Clause License", [("bsd-3", 1, 0)]),
    ]:
        assert [(f[0], f[1], f[3]) for f in ls.scan(text, m)[1]] == want, text


def test_long_texts_of_many_notices():
    m = [ls.Matcher(n) for n in ls.NOTICES]
    one = "some words under the mit licence and cc by nc "
    n, found = ls.scan(one * 20_000, m)
    assert n == 200_000 and len(found) == 40_000
    assert [f[1] for f in found[:4]] == [2, 7, 12, 17] and found[-1][1] == 199_997


def test_further_notices_are_no_base_places(spark, tmp_path):
    rows = [(1, "under the BSD license"), (2, "under the MIT license; Mozilla Public License Version 2"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in ls.query(spark, str(tmp_path)).collect()}
    assert [(got[i].n_base, got[i].first_word, got[i].base_labels, got[i].labels) for i in (1, 2, 3)] == [(0, None, "", "bsd"), (1, 0, "mit", "mit,mpl-2"), (0, None, "", "")]
