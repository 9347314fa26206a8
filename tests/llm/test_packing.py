import random
import zlib

import numpy as np

from quillspark.llm import packing


def texts():
    rnd = random.Random(3)
    parts = ["word", "Ünïcode", "a,b", "it's", "x  y", " lead", "tail ", "\n", "\t", "<|endoftext|>", "中文字", "1234", "é", " nbsp"]
    return [" ".join(rnd.choices(parts, k=rnd.choice([0, 1, 5, 50, 3000]))) for _ in range(60)] + [None, "", " ", "  ", "a " * 9000]


def test_against_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int").repartition(4)
    got = packing.pack(df, with_ids=True).collect()
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids.tolist()
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist() and sum(n for _, n in s) <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1


def test_ranks_give_the_ids_of_the_library():
    enc = packing.encoder("byte_bpe_50k.json")
    assert enc.fast
    rnd = random.Random(4)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rnd.shuffle(points)
    for at in range(0, len(points), 40):
        text = "".join(f"a{c}b {c}{c} 1{c}2\n {c}'s  {c}!{c}." for c in map(chr, points[at : at + 40]))
        assert enc.ids(text) == enc.whole(text)
    for text in ("a" * 50_000, " " * 999 + "x", " " * 5000, "\n" * 3000 + "b", "!?" * 9000, "x<|endoftext|>y", "".join(rnd.choices("abcdefgh", k=50_000))):
        assert enc.ids(text) == enc.whole(text)


def test_other_tokenizers_go_through_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    enc = packing.encoder("word_bpe_49k.json")
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert not enc.fast
    assert np.frombuffer(enc.ids("Some Words, here"), "<u4").tolist() == tok.encode("Some Words, here", add_special_tokens=False).ids


def test_patterns_use_each_length_exactly():
    rnd = random.Random(1)
    for _ in range(5):
        hist = {n: rnd.randrange(0, 400) for n in [*range(1, 32), *range(32, 2048, 32)]}
        plan = packing.patterns(hist)
        used = {n: sum(p.get(n, 0) * t for p, t in plan) for n in hist}
        assert used == hist and all(sum(n * c for n, c in p.items()) <= 2048 for p, _ in plan)


def test_documents_of_one_awkward_length(spark):
    df = spark.createDataFrame([(i, " word" * 1099) for i in range(400)], "doc_id long, text string")
    got = packing.pack(df).collect()
    assert len({r.sequence_id for r in got}) <= 1.02 * 400 * 1100 / 2048 + 2


def test_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = packing.pack(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.length, r.offset) for r in got) == [(None, 1, 0), (None, 1, 1), (None, 1, 2)]


def test_more_buckets_give_whole_sequences(spark):
    rows = [(d, 0, 2048 if d % 3 else 64, d) for d in range(1500)]
    parts = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long")
    got = packing.assign(parts, per_bucket=1).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((d, n) for d, _, n, _ in rows)
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) == 1000 + 16
