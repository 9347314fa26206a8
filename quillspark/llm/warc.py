"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: each task writes its records, each a gzip member of its own, to files of its own with unique names in the
given folder; the table it returns (path, length, records) is what names the files that count, so a task that is
run again leaves files that nothing reads. Payloads of at least ``min_revisit_bytes`` that are equal (by SHA-1) are
stored once, under the largest page_id; the other records are revisits that refer to it.

Reader: a task gets a byte range of a file. It scans for the gzip magic, validates each candidate by decoding the
member's whole header block (version, type, id and length must be there), and owns the records whose member starts
inside its range; from a valid one it goes on behind its end, and scans again where no member follows (padding, foreign
bytes). A record that starts inside is read to its end, beyond the range. What looks like a record inside a payload that
is stored without compression can't be told from one; UTF-8 text never holds the magic.

Defined cases: a null html is an empty payload; a null url gives a record without target; rows that repeat give a
record each, and those with the largest page_id of equal payloads are all responses; a null page_id never is the
largest, unless all are null: then all are responses; an empty table gives no records; extra columns are ignored; a
very long page is one record, which a task holds whole; a member without end is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare, scratch_path

MAGIC = b"\x1f\x8b\x08"
#: Header blocks are looked for in so many bytes.
HEAD = 64 << 10
BLOCK = 1 << 20
ROLL = 1 << 30
SPLIT = 32 << 20


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs, path


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record in the bytes of a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _int(x):
    return None if pd.isna(x) else int(x)


def _write(folder: str, date: str, roll: int):
    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        size = n = 0
        done = []
        for pdf in batches:
            for page, url, html, refers in zip(pdf.page_id, pdf.url, pdf.html, pdf.refers_to):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                raw = record(_int(page), url, (html or "").encode("utf-8", "surrogatepass"), _int(refers), date)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= roll:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        yield pd.DataFrame(done, columns=["path", "length", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Write pages (page_id, url, html); the result (path, length, records) names the files."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    same = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes)
    same = same.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(materialize(same, "warcsame"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "html", refers.alias("refers_to"))
    return materialize(rows.mapInPandas(_write(folder, date, roll), "path string, length long, records long"), "warcfiles")


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def is_record(member: bytes) -> bool:
    """Whether the first bytes of a gzip member decode to a WARC header block."""
    z, raw, at = zlib.decompressobj(31), b"", 0
    while b"\r\n\r\n" not in raw:
        if at >= len(member) or z.eof or not b"WARC/1.".startswith(raw[:7]):
            return False
        try:
            raw += z.decompress(member[at : at + 1024])
        except zlib.error:
            return False
        at += 1024
    _, h = _headers(raw.partition(b"\r\n\r\n")[0])
    return bool(h.get("warc-type") and h.get("warc-record-id")) and h.get("content-length", "").isdigit()


def records_in(f, length: int, start: int, end: int):
    """Yield (offset, bytes of the record) for the members of open file f that start in [start, end)."""
    at, known = start, False
    buffer, base = b"", start

    def more(to: int) -> bool:
        """Have the bytes up to position to, if the file has them."""
        nonlocal buffer
        while base + len(buffer) < to:
            f.seek(base + len(buffer))
            got = f.read(min(BLOCK, length - base - len(buffer)))
            if not got:
                return False
            buffer += got
        return True

    while at < min(end, length):
        if not known:
            more(min(length, at + BLOCK))
            hit = buffer.find(MAGIC, at - base)
            if hit < 0:
                at = max(at, base + len(buffer) - len(MAGIC) + 1)
                if base + len(buffer) >= length:
                    return
                buffer, base = buffer[at - base :], at
                continue
            at = base + hit
            if at >= end:
                return
            more(min(length, at + HEAD))
            if not is_record(buffer[at - base : at - base + HEAD]):
                at += 1
                continue
        buffer, base = buffer[at - base :], at
        z, parts, fed = zlib.decompressobj(31), [], 0
        while not z.eof:
            more(min(length, base + fed + BLOCK))
            piece = buffer[fed : fed + BLOCK]
            if not piece:
                raise EOFError(f"a member at {at} has no end")
            parts.append(z.decompress(piece))
            fed += len(piece)
        yield at, b"".join(parts)
        at += fed - len(z.unused_data)
        if at < end:
            more(min(length, at + HEAD))
            known = is_record(buffer[at - base : at - base + HEAD])


def parse(raw: bytes, with_payload: bool) -> tuple:
    """(record_id, record_type, target_uri, page_id, refers_to, payload_digest, payload_bytes, payload)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    _, h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    _, x = _headers(http)
    if h["warc-type"] == "response":
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        if h.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
            raise ValueError(f"{h.get('warc-record-id')}: the payload doesn't match its digest")
    else:
        digest, size, payload = h.get("warc-payload-digest", "").removeprefix("sha1:"), int(x.get("content-length", 0)), None
    num = lambda k: int(h[k]) if k in h else None
    return h.get("warc-record-id"), h["warc-type"], h.get("warc-target-uri"), num("x-page-id"), num("x-refers-to-page-id"), digest, size, payload if with_payload else None


COLUMNS = ["path", "offset", "record_id", "record_type", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes", "payload"]


def _read(with_payload: bool):
    def run(batches):
        for pdf in batches:
            for path, length, start, end in zip(pdf.path, pdf.length, pdf.start, pdf.end):
                fs, name = _open(path)
                out, held = [], 0
                with fs.open_input_file(name) as f:
                    for at, raw in records_in(f, int(length), int(start), int(end)):
                        out.append((path, at, *parse(raw, with_payload)))
                        held += len(raw) if with_payload else 200
                        if held > 16 << 20 or len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})
                            out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_warc(files: DataFrame, with_payload: bool = True, split: int = SPLIT) -> DataFrame:
    """The records of files (path, length), each byte range of ``split`` bytes in a task of its own."""
    prepare(files.sparkSession)
    starts = F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L), {split}L)"))
    splits = files.where("length > 0").select("path", "length", starts.alias("start")).withColumn("end", F.least("length", F.col("start") + split))
    n = splits.count()
    return splits.repartition(max(1, min(n, 100_000))).mapInPandas(_read(with_payload), "path string, offset long, record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary")


def list_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the archives in a folder, by Spark's own listing; their bytes aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all pages to archives in the shared folder, and back."""
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    return read_warc(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
