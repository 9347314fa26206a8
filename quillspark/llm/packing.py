"""Packing token sequences by cutting stock with column generation.

Tokenisation: the tokenizer is a file of the tokenizers library. If that file is plain byte-level BPE whose merges
stand in the order of their ids, tiktoken encodes with ranks read from it: the same ids at a fraction of the time.
Any other file, and texts with an added token's string or a run of white space too long for tiktoken's regular
expressions, go through the tokenizers library itself. A file whose byte level uses its own split has one fixed pattern,
which public_tokenizers.PATTERN is; tests compare the ids of both libraries.

Cuts: a document's ids give full sequences of ``capacity`` ids; of the rest, a head that is a multiple of ``grain``
and a tail shorter than it. Every second head (by hash of doc_id) is cut once more, at a multiple of the grain that
the hash chooses: so there is enough to fill gaps with even if all documents are a little over half a sequence.
There are at most capacity / grain + grain lengths. Their histogram (all that the driver sees) makes a cutting-stock
problem: a linear program over patterns, in which a knapsack dynamic program prices new patterns until none helps. Patterns are used as often as the rounded-down solution says, what is left is
packed by first fit decreasing. Pieces are ranked within their length (by bucket, then place in the bucket), and
pattern slots are given out by rank: sequence and offset follow by arithmetic. Heads fill sequences up to the grain
and tails fill the gaps, so padding is that of the last few sequences.

Defined cases: a null or empty text is the end id alone; rows that repeat are packed each; null doc_ids stay null;
an empty table gives an empty result; extra columns are ignored; a very long text is tokenised whole, in one task.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

CAPACITY, GRAIN, END = 2048, 32, 1
#: Groups within which pieces of a length are ranked: at least so many, and more where they'd hold more pieces.
BUCKETS, PER_BUCKET = 256, 100_000
#: Runs of white space that are left to the tokenizers library.
SPACES = re.compile(r"\s{1000}")
_ENCODERS: dict[str, "Encoder"] = {}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as bytes and ids; None unless it is byte-level BPE with merges in id order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not level or not plain or spec.get("normalizer"):
        return None
    added = {t["content"] for t in spec.get("added_tokens", ())}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    # visible bytes stand for themselves, the others for characters from 256 on
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    chars = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    singles = [vocab.get(c, -1) for c in chars]
    if min(singles) < 0 or [max(singles), *merged] != sorted({max(singles), *merged}) or len(merged) + 256 != len(vocab):
        return None
    return {bytes(chars[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """Ids as bytes (unsigned 32 bits, little-endian) of whole texts."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.path = name if os.path.exists(name) else public_tokenizers.path(name)
        with open(self.path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", ())]
        ranks = byte_ranks(self.path)
        self.fast = ranks and tiktoken.Encoding(os.path.basename(self.path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tok(self):
        """The library's own tokenizer, some 100 MB of a worker's memory: loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        text = text.encode("utf-8", "replace").decode()
        if not self.fast or any(t in text for t in self.added) or SPACES.search(text):
            return self.whole(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def cuts(n: int, draw: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; draw is a hash."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    s = len(out) * capacity
    grains = (n - s) // grain
    first = (1 + (draw >> 1) % (grains - 1) if draw & 1 and grains > 1 else grains) * grain
    head = grains * grain
    return out + [(a, b) for a, b in ((s, first), (s + first, head - first), (s + head, n - s - head)) if b]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""

    def run(batches):
        enc, end = encoder(tokenizer), np.array([END], "<u4").tobytes()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                ids = enc.ids(text or "") + end
                n = len(ids) // 4
                for s, m in cuts(n, zlib.crc32(b"cut %d" % (0 if pd.isna(doc) else doc)), capacity, grain):
                    part = ids[4 * s : 4 * (s + m)]
                    out.append((doc, s, m, zlib.crc32(part), n, np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
            x = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            x["doc_id"] = x.doc_id.astype("Int64")
            yield x if with_ids else x.drop(columns="ids")

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern for these values: dynamic programming over capacity, copies in powers of two."""
    items = [(t, 1 << b) for t, n in enumerate(lengths) if values[t] > 1e-12 for b in range(int(capacity // n).bit_length())]
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for i, (t, m) in enumerate(items):
        w = int(lengths[t]) * m
        if w <= capacity:
            with_ = best[:-w] + values[t] * m
            taken[i, w:] = with_ > best[w:] + 1e-12
            best[w:] = np.where(taken[i, w:], with_, best[w:])
    copies, at = np.zeros(len(lengths)), capacity
    for i in range(len(items) - 1, -1, -1):
        if taken[i, at]:
            t, m = items[i]
            copies[t] += m
            at -= int(lengths[t]) * m
    return float(best[capacity]), copies


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 5000) -> list[tuple[dict[int, int], int]]:
    """[({length: copies}, times)] that use each length exactly as often as the histogram says."""
    lengths = np.array(sorted((n for n, c in histogram.items() if c), reverse=True))
    if not len(lengths):
        return []
    need = np.array([histogram[int(n)] for n in lengths], np.float64)
    basis = np.diag((capacity // lengths).astype(np.float64))
    x = need / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(lengths)))
        value, column = _knapsack(lengths, price, capacity)
        if value <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, column)
        up = move > 1e-9
        step = np.where(up, x / np.where(up, move, 1), np.inf)
        out = int(step.argmin())
        x = np.maximum(x - step[out] * move, 0)
        x[out] = step[out]
        basis[:, out] = column
    used, left = [], need.astype(np.int64)
    for k in np.argsort(-x):
        column = basis[:, k].astype(np.int64)
        fits = int((left[column > 0] // column[column > 0]).min()) if column.any() else 0
        times = min(int(x[k] + 1e-6), fits)
        if times:
            used.append(({int(lengths[t]): int(column[t]) for t in np.flatnonzero(column)}, times))
            left -= times * column
    bins: list[tuple[int, dict[int, int]]] = []
    for t, n in enumerate(lengths.tolist()):
        more = int(left[t])
        for b, (room, held) in enumerate(bins):
            if more and room >= n:
                k = min(more, room // n)
                bins[b] = (room - k * n, held | {n: held.get(n, 0) + k})
                more -= k
        while more:
            k = min(more, capacity // n)
            bins.append((capacity - k * n, {n: k}))
            more -= k
    return used + [(held, 1) for _, held in bins]


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, copies, offset), by first rank."""
    rank: dict[int, int] = {}
    out: dict[int, list] = {}
    seq = 0
    for pattern, times in plan:
        offset = 0
        for n, copies in sorted(pattern.items(), reverse=True):
            out.setdefault(n, []).append((rank.get(n, 0), seq, copies, offset))
            rank[n] = rank.get(n, 0) + copies * times
            offset += n * copies
        seq += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def assign(parts: DataFrame, capacity: int = CAPACITY, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...).

    The driver gets a count for each length and bucket: at most lengths x BUCKETS rows, and one for per_bucket pieces."""
    sizes = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}
    many = [F.when(F.col("length") == n, F.lit(-(-c // per_bucket))) for n, c in sizes.items() if c > BUCKETS * per_bucket]
    parts = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.coalesce(*many, F.lit(BUCKETS))))
    counts = parts.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in sorted(counts):
        base[r.length, r["_b"]] = histogram.get(r.length, 0)
        histogram[r.length] = histogram.get(r.length, 0) + r.n
    full = histogram.pop(capacity, 0)
    slots = _slots(([({capacity: 1}, full)] if full else []) + patterns(histogram, capacity))
    first = parts.sparkSession.sparkContext.broadcast((slots, base))
    place = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32")) - 1
    keep = [c for c in parts.columns if c != "_b"]
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}

    def run(batches):
        slots, base = first.value
        for pdf in batches:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length = pdf.length.to_numpy()
            rank = pdf["_r"].to_numpy().astype(np.int64) + np.array([base[k] for k in zip(length.tolist(), pdf["_b"].tolist())], np.int64)
            for n in np.unique(length):
                at, s = np.flatnonzero(length == n), slots[int(n)]
                row = s[np.searchsorted(s[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * n
            out = pdf[keep].assign(sequence_id=seq, offset=off)
            yield out.assign(doc_id=pdf.doc_id.astype("Int64"))

    return parts.withColumn("_r", place).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """Pack all docs (doc_id, text) into sequences of ``capacity`` ids; a row for each piece."""
    prepare(docs.sparkSession)
    return assign(materialize(pieces(docs, tokenizer, capacity, grain, with_ids), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op3 over all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last pipeline stage: pieces of all documents kept, documents that the mix repeats packed each time."""
    return pack(docs)
