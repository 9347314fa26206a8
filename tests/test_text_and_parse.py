import random
import re

from pyspark.sql import functions as F

from quillspark.config import FIRST_PERSON
from quillspark.functions import text as tx
from quillspark.operators import features, parse, topics


def files(spark, *values, path="lab/song.txt"):
    return spark.createDataFrame([(path, v, "target") for v in values], "path string, value string, set string")


def parsed(spark, value, domain="lyrics"):
    works = parse.parse_works(files(spark, value), domain)
    return works, *parse.blocks_and_atoms(parse.parse_blocks(works, domain=domain))


def test_labelled_text(spark):
    works, blocks, atoms = parsed(spark, "Title: Low Tide\n\n[Verse 1]\nSalt on a sleeve\n\n[Chorus]\nRow home\n\n[Final Chorus]\nRow back home\n")
    assert works.first().title == "Low Tide" and works.first().id.startswith("work_")
    assert [r.type for r in blocks.orderBy("index").collect()] == ["verse", "chorus", "chorus"]
    assert [(r.index_in_work, r.index_in_block, r.text) for r in atoms.orderBy("index_in_work").collect()] == [(0, 0, "Salt on a sleeve"), (1, 0, "Row home"), (2, 0, "Row back home")]
    scopes = {r.scope: r.text for r in parse.extra_scopes(works, blocks).collect()}
    assert scopes == {"all_choruses": "Low Tide\nRow home\nRow back home", "title_plus_chorus": "Low Tide\nRow home\nRow back home"}


def test_unlabelled_and_several_works(spark):
    _, blocks, atoms = parsed(spark, "red\nblue\n\ngreen\n\n")
    assert (blocks.count(), atoms.count()) == (2, 3)
    works = parse.parse_works(files(spark, "Title: East\n\nsun\n\n----\n\nTitle: West\nsynthetic-control-type: generic\n\nmoon\n"))
    assert [(r.title, r.text, r.metadata.synthetic_control_type) for r in works.orderBy("title").collect()] == [("East", "sun", None), ("West", "moon", "generic")]
    assert parse.parse_works(files(spark, "no title", "Title:\n\nx")).select("title").distinct().count() == 2


def test_generic_domain(spark):
    works, blocks, atoms = parsed(spark, "Title: On Bridges\n\n[Introduction]\nStone lasts.\n\n[Body]\nIron rusts.\n", "essay")
    assert [r.type for r in blocks.orderBy("index").collect()] == ["introduction", "body"]
    assert [r.text for r in atoms.orderBy("index_in_work").collect()] == ["Stone lasts.", "Iron rusts."]


def test_labels_ids_and_tokens(spark):
    df = spark.createDataFrame([("Verse 2",), ("Final Chorus",), ("BRIDGE",), ("Pre-Chorus",), ("Spoken part",), ("2",)], "x string")
    assert [r[0] for r in df.select(tx.section_label(F.col("x"))).collect()] == ["verse", "chorus", "bridge", "chorus", "spoken-part", "section"]
    row = spark.range(1).select(tx.words(F.lit("étépart don't x_1")).alias("w"), tx.topic_tokens(F.lit("étépart")).alias("t"), tx.slug(F.lit("A b--C!")).alias("s"), tx.trim(F.lit("\u00a0\t x\ufeff")).alias("j")).first()
    assert row.w == ["t", "part", "don't", "x_1"] and row.t == ["part"] and row.s == "a-b-c" and row.j == "x"


def test_features_and_topics(spark):
    works, blocks, atoms = parsed(spark, "Title: T\n\n[Verse]\nI said I'm here?\nYou know: stop!\n[Chorus]\n\n")
    f = {r.text: r for r in features.atom_features(atoms).collect()}
    assert f["I said I'm here?"].first_person_pronoun_count == 2 and f["I said I'm here?"].word_count == 4
    assert f["You know: stop!"].punctuation_count == 2 and f["You know: stop!"].second_person_pronoun_count == 1
    w = features.work_features(works.select(F.col("id").alias("work_id")), blocks, atoms).first()
    assert (w.line_count, w.verse_count, w.chorus_count, w.question_mark_density) == (2, 1, 0, 0.5)
    p = topics.topic_profiles(works).first()
    assert p.main_theme == "verse, said, here" and p.central_image == "verse" and p.emotional_subject == "know, stop, chorus"
    assert topics.refresh_topics(works, topics.topic_profiles(works).withColumn("main_theme", F.lit("kept"))).first().main_theme == "kept"


def test_blocks_are_cut_up_without_a_shuffle(spark):
    """Headers next to each other, at both ends, before blank lines and not alone in their line, against a plain loop."""
    rnd = random.Random(3)
    some = ["[Verse 2]", " [Chorus]\t", "[]", "[Bridge] x", "", "  ", "red", " blue　", "a\rb", "[ ]", "[12]"]
    texts = ["".join(rnd.choice(some) + rnd.choice(["\n", "\r\n", "\n\n", "\n \n"]) for _ in range(rnd.randrange(0, 12))) for _ in range(60)] + ["", "[Verse]", None]
    space = " \t\n\x0b\f\r ﻿     　" + "".join(map(chr, range(0x2000, 0x200B)))

    def plain(text):
        ls = re.split(r"\r?\n", text)
        head = [re.match(r"^[ \t\n\x0b\f\r]*\[([^\]]+)\][ \t\n\x0b\f\r]*$", x) for x in ls]
        if not any(head):
            parts = [("section", re.split(r"\r?\n", p)) for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", text)]
        else:
            parts = [(None, [])]
            for x, h in zip(ls, head):
                parts.append((h[1], [])) if h else parts[-1][1].append(x)
            named = lambda x: re.sub("[0-9]+", "", x.lower()).strip(space)
            parts = [(next((k for k in ("chorus", "verse", "bridge") if h and k in named(h)), "section"), ls) for h, ls in parts]
        parts = [(kind, [x.strip(space) for x in ls if x.strip(space)]) for kind, ls in parts]
        return [(i, *p) for i, p in enumerate(p for p in parts if p[1])]

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = parse.parse_blocks(df)
    got = {}
    for r in out.orderBy("work_id", "block_index").collect():
        got.setdefault(r.work_id, []).append((r.block_index, r.type, r.lines))
    assert got == {i: plain(t) for i, t in enumerate(texts) if t is not None and plain(t)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_as_they_are_found(spark):
    """Counts by patterns without borders, and trimming by characters, against the patterns with borders."""
    rnd = random.Random(5)
    rows = [("".join(rnd.choices("ab_9'' é.-I  ﻿\U0001f600", k=rnd.randrange(0, 14))),) for _ in range(400)] + [("I'm me, ME my_ _i mine9 i'i you're yours",), ("",), (None,)]
    t = F.col("t")
    bordered = lambda ws: F.regexp_count(t, F.lit(f"(?i){tx.BORDER}(?:{'|'.join(ws)}){tx.BORDER}"))
    df = spark.createDataFrame(rows, "t string").select("t", tx.word_count(t).alias("n"), F.size(tx.words(t)).alias("m"), tx.alternation(t, FIRST_PERSON).alias("f"), bordered(FIRST_PERSON).alias("g"), tx.trim(t).alias("x"), F.regexp_replace(t, f"^{tx.SPACE}+|{tx.SPACE}+$", "").alias("y"))
    for r in df.collect():
        assert r.t is None and r.n is None or (r.n, r.f, r.x) == (r.m, r.g, r.y), r
    plan = features.atom_features(df.select(t.alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "(?<=" not in plan  # no border is tested at each place of a text
