"""Homomorphic multiset fingerprints: wide vectors hashed from paragraphs, summed modulo powers of two.

A text's units are its paragraphs: lines, cut behind sentence ends; units of over 400 characters are cut at words
chosen by their own hash, so that an edit moves few cuts. A unit is hashed (BLAKE2b, 512 bits) to two vectors:
256 signs, times the unit's weight (the whole square root of its length), summed modulo 2^16, and twelve numbers
(the last eight by a second hash of the first) summed modulo 2^64. Sums don't depend on order, and units can be added
to or taken from a fingerprint (combine). Equal multisets give equal fingerprints; the 768-bit part makes others differ. The signed part is a second-moment
sketch: |A - B|^2 / (|A|^2 + |B|^2) estimates the share of characters that two texts don't have in common, and
likeness is 1 minus that (standard error some 0.06; sums beyond 2^15, of units that repeat many thousand times,
wrap, which spoils likeness only).

Defined cases: a null or empty text has no units and the zero fingerprint; two such have likeness 1, one such and
another 0; rows that repeat keep their place in the order (doc_id, hash of text); null doc_ids come last; with one
row, the next document is itself; an empty table gives an empty result; extra columns are ignored; a very long text is
hashed whole, some thousand units at a time (a task holds a few copies of it, and of the one before).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, range_cuts, to_ranges

LANES, WORDS = 256, 12
CUT = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
LONG = 400


def units(text: str | None) -> list[str]:
    """The paragraphs of a text, as the fingerprint takes them."""
    out = []
    for u in CUT.split(text or ""):
        u = u.strip()
        if len(u) <= LONG:
            if u:
                out.append(u)
            continue
        part: list[str] = []
        for w in u.split():
            part.append(w)
            if not zlib.crc32(w.encode("utf-8", "surrogatepass")) & 15:
                out.append(" ".join(part))
                part = []
        if part:
            out.append(" ".join(part))
    return out


def fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(signed sums modulo 2^16, sums modulo 2^64)."""
    us = units(text)
    signs, sums = np.zeros(LANES, np.int64), np.zeros(WORDS, np.uint64)
    for at in range(0, len(us), 4096):
        part = us[at : at + 4096]
        digests = (hashlib.blake2b(u.encode("utf-8", "surrogatepass")).digest() for u in part)
        raw = np.frombuffer(b"".join(d + hashlib.blake2b(d).digest() for d in digests), np.uint8).reshape(-1, 128)
        weight = np.array([math.isqrt(len(u)) for u in part], np.float64)
        bits = np.unpackbits(raw[:, : LANES // 8], axis=1)
        signs += (2 * (weight @ bits) - weight.sum()).astype(np.int64)
        sums += raw[:, LANES // 8 :].copy().view("<u8").sum(0, dtype=np.uint64)
    return signs.astype(np.int16), sums


def combine(a, b, sign: int = 1):
    """The fingerprint of a's units with b's added (sign 1) or taken away (-1)."""
    x, y = (a[0] + b[0], a[1] + b[1]) if sign > 0 else (a[0] - b[0], a[1] - b[1])
    return x, y


def likeness(a, b) -> float:
    """0 to 1: the estimated share of characters in common."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[0].astype(np.float64), b[0].astype(np.float64)
    d = (a[0] - b[0]).astype(np.float64)
    all_ = x @ x + y @ y
    return float(min(1.0, max(0.0, 1 - d @ d / all_))) if all_ else 0.0


def text_of(fp) -> str:
    return base64.b64encode(fp[0].astype("<i2").tobytes() + fp[1].astype("<u8").tobytes()).decode()


def of_text(s: str):
    raw = base64.b64decode(s)
    return np.frombuffer(raw[: 2 * LANES], "<i2").astype(np.int16), np.frombuffer(raw[2 * LANES :], "<u8").astype(np.uint64)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _deal(sent):
    """Rows to the range that holds their key, and the first row of each range to the range before as well."""

    def run(batches):
        firsts = sent.value
        for pdf in batches:
            at, guest = [], []
            for key in zip(pdf.k.tolist(), pdf.h.tolist()):
                b = bisect.bisect_right(firsts, key) - 1
                at.append(b)
                guest.append((b - 1) % len(firsts) if key == firsts[b] else -1)
            own = pdf.assign(bucket=at, guest=0)
            more = pdf.assign(bucket=guest, guest=1)[np.array(guest) >= 0]
            yield pd.concat([own, more])

    return run


def _compare(batches):
    held = None  # (bucket, row, fingerprint): the document whose next one comes
    for pdf in batches:
        out = []
        for doc, null, text, bucket, guest in zip(pdf.doc_id.tolist(), pdf.null_id.tolist(), pdf.text.tolist(), pdf.bucket.tolist(), pdf.guest.tolist()):
            text = text or ""
            if guest and (held is None or held[0] != bucket):
                continue
            fp = fingerprint(text)
            if held and held[0] == bucket:
                _, who, t, f = held
                n = len(t) // 2
                new = t[: len(t) - n] + text[:n] if n else t
                e = fingerprint(new)
                out.append((who, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_of(f), text_of(e), likeness(f, e), likeness(f, fp)))
            held = None if guest else (bucket, None if null else doc, text, fp)
        x = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield x.astype({"doc_id": "Int64"})


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text): its fingerprint, that of its edited text, and likenesses.

    Only ids and hashes are ordered to find the ranges; texts are shuffled once, each to its range, and the first
    document of a range also to the one before.
    """
    prepare(docs.sparkSession)
    key = [F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)).alias("k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")]
    firsts = range_cuts(docs.select(*key), ["k", "h"])
    if not firsts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), "text", *key)
    sent = docs.sparkSession.sparkContext.broadcast(firsts)  # common.MAX_RANGES keys at most
    dealt = rows.mapInPandas(_deal(sent), "doc_id long, null_id boolean, text string, k long, h long, bucket long, guest int")
    return to_ranges(dealt, "bucket", len(firsts), "guest", "k", "h").mapInPandas(_compare, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op2 over all documents."""
    return fingerprint_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
