import base64
import gzip
import hashlib
import os
import random
import zlib

import pytest

from quillspark.llm import warc


def test_round_trip_with_small_splits(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, f"http://h/{i}", "".join(rnd.choices("abc é€", k=rnd.randrange(0, 3000)))) for i in range(60)]
    rows += [(100 + i, None, rows[i % 3][2]) for i in range(12)] + [(200, "http://h/ \r\nX", None), (201, "u", ""), (None, "u", rows[5][2]), (7, "again", rows[7][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    files = warc.write_warc(df, f"file://{tmp_path}/w")
    assert sum(r.records for r in files.collect()) == len(rows)
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"\x1f\x8b\x08 a failed task's file")
    most = {}
    for p, _, h in rows:
        if p is not None:
            most[h or ""] = max(p, most.get(h or "", -1))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        to = most.get(h or "")
        want.append(str((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None or to == p else "revisit", None if to is None or to == p else to)))
    for split in (97, 1000, 1 << 25):
        got = warc.read_warc(files, split=split).collect()
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(want)
        text = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
        assert all(text[most[h or ""]] == (h or "") for p, _, h in rows if p is not None)
    listed = warc.list_warc(spark, str(tmp_path / "w"))
    assert listed.count() == files.count() + 1


def test_magic_inside_a_member_is_no_record(tmp_path):
    a = warc.record(1, "u", warc.MAGIC * 50 + os.urandom(500), None, "d")
    path = tmp_path / "x"
    path.write_bytes(a + a)
    with open(path, "rb") as f:
        cuts = list(range(0, 2 * len(a), 13)) + [2 * len(a)]
        got = [at for s, e in zip(cuts, cuts[1:]) for at, _ in warc.records_in(f, 2 * len(a), s, e)]
    assert got == [0, len(a)]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(df, f"file://{tmp_path}/e")).collect() == []


def test_bytes_between_members_are_skipped(tmp_path):
    a, b = (warc.record(i, "u", b"payload %d" % i, None, "d") for i in (1, 2))
    path = tmp_path / "x"
    for junk in (b"plain text", bytes(3000), warc.MAGIC * 9, zlib.compress(b"other", 9), gzip.compress(b"a member that is no record"), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")):
        path.write_bytes(junk + a + junk + b + junk)
        n = path.stat().st_size
        for step in (11, n):
            with open(path, "rb") as f:
                got = [raw for s in range(0, n, step) for _, raw in warc.records_in(f, n, s, min(n, s + step))]
            assert [warc.parse(x, True)[-1] for x in got] == [b"payload 1", b"payload 2"], junk
    path.write_bytes(a + b[:-20])
    with open(path, "rb") as f, pytest.raises(EOFError):
        list(warc.records_in(f, path.stat().st_size, 0, 1 << 20))


def test_long_headers_and_payloads(tmp_path):
    a = warc.record(1, "http://h/" + "".join(random.Random(1).choices("abcdefgh/", k=20_000)), b"x" * 50, None, "d")
    b = warc.record(2, "u", os.urandom(3 << 20), None, "d")
    path = tmp_path / "x"
    path.write_bytes(a + b + a)
    n = path.stat().st_size
    with open(path, "rb") as f:
        got = [at for s in range(0, n, 700_000) for at, _ in warc.records_in(f, n, s, min(n, s + 700_000))]
    assert got == [0, len(a), len(a) + len(b)]
