"""SimHash near-dedup: binary trie self-join of 64-bit fingerprints, then connected components.

Words are runs of characters other than space and tab to carriage return, after A-Z is lower-cased. Fingerprints
whose bits differ in at most ``max_diff`` places link. The trie's top is dealt out by segments: of a fingerprint's m
segments two linked ones share at least m - max_diff, so a trie is built for each choice of so many segments, which
are put first; its top levels are walked with no error budget (one task group for each top node), and below them node
pairs are walked together, adding up differing bits and dropping a pair once the budget is exceeded. m grows with the
number of fingerprints (``segments_for``), so that top nodes stay small: 4 copies of each up to some billion of them,
10 up to some 10^12; what is in a large top node all the same is dealt out as pairs of blocks.

Defined cases: a null or empty text has no words and fingerprint 0, linked like any other; rows that repeat get
the same answer each; documents with fewer words than a shingle hash the whole sequence; an empty table gives an
empty result; extra columns are ignored. A null doc_id gets its fingerprint's component (null, if no document with
an id is in it). A bit that is set in just half the hashes is 0. A very long text is hashed whole, a million
characters at a time.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, connected_components, forest, fresh, materialize, pieces, prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
LOWER = {c: c + 32 for c in range(65, 91)}
SEED = 42
#: Rows of one bucket in one tile; larger buckets are dealt out as pairs of blocks.
TILE = 8192
#: Node pairs with at most so many member pairs are compared outright.
LEAF = 48
#: Node pairs walked, and member pairs compared, at once.
NODES, PAIRS = 50_000, 250_000
#: Stands for a null id where rows are looked up.
NO_ID = 1 << 62


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    for piece in pieces((text or "").translate(LOWER), SPACE):
        words = words[max(0, len(words) - shingle + 1) :] + WORD.findall(piece)
        if len(words) < shingle:
            continue
        n += _count(map(" ".join, zip(*(words[i:] for i in range(shingle)))), ones)
    if not n and words:
        n = _count([" ".join(words)], ones)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _count(grams, ones: np.ndarray) -> int:
    """Add to ones how many of the grams' hashes have each bit; how many there are."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g.encode("utf-8", "surrogatepass"), SEED) for g in grams), np.uint64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return len(h)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp): h hashes the text, fp as signed long."""

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf.text], np.uint64)
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "h": pdf.h, "fp": fp.view(np.int64)})

    h = F.xxhash64("text", F.col("doc_id").isNull())
    return docs.select(F.col("doc_id").cast("long"), "text", h.alias("h")).mapInPandas(run, "doc_id long, h long, fp long")


def _spans(comp, lo, hi, bit):
    """Where the ranges [lo, hi) of sorted comp, each one trie node, turn from bit 0 to bit 1."""
    shift = np.uint64(bit)
    return np.searchsorted(comp, ((comp[lo] >> shift) | np.uint64(1)) << shift)


def trie_join(comp: np.ndarray, a0, a1, b0, b1, bits: int, max_diff: int):
    """Yield index pairs (i, j) whose low ``bits`` differ in at most max_diff places, for pairs of root nodes.

    comp is sorted; above the low bits it holds the number of the trie. Nodes are ranges of comp. All node pairs of
    one level are walked at once, at most NODES of them; the rest waits on a stack, so memory is bounded.
    """
    mask = np.uint64((1 << bits) - 1)
    stack = [(bits - 1, np.stack([a0, a1, b0, b1, np.zeros_like(a0)]))]
    while stack:
        bit, x = stack.pop()
        if x.shape[1] > NODES:
            half = x.shape[1] // 2
            stack += [(bit, x[:, :half]), (bit, x[:, half:])]
            continue
        n = (x[1] - x[0]) * (x[3] - x[2])
        done = (n <= LEAF) | (bit < 0)
        ends = np.searchsorted(np.cumsum(n[done]), np.arange(PAIRS, n[done].sum(), PAIRS)) if done.any() else []
        for part in np.split(x[:, done], ends, axis=1):
            p0, p1, q0, q1, _ = part
            # below the last bit all members of a node are equal: a pair of ends links them all
            if bit < 0:
                p1, q1 = p0 + 1, q0 + 1
            m = (p1 - p0) * (q1 - q0)
            if not m.sum():
                continue
            of = np.repeat(np.arange(len(m)), m)
            k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
            w = (q1 - q0)[of]
            i, j = p0[of] + k // w, q0[of] + k % w
            ok = (p0 != q0)[of] | (i < j)
            i, j = i[ok], j[ok]
            near = np.bitwise_count((comp[i] ^ comp[j]) & mask) <= max_diff
            yield i[near], j[near]
        x = x[:, ~done]
        if not x.shape[1]:
            continue
        a0, a1, b0, b1, d = x
        am, bm = _spans(comp, a0, a1, bit), _spans(comp, b0, b1, bit)
        same = a0 == b0
        kids = [
            np.stack([a0, am, b0, bm, d]),
            np.stack([am, a1, bm, b1, d]),
            np.stack([a0, am, bm, b1, d + 1]),
            np.stack([am, a1, b0, bm, d + 1])[:, ~same],
        ]
        x = np.concatenate(kids, axis=1)
        stack.append((bit - 1, x[:, (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= max_diff)]))


def _join_tiles(max_diff: int, low: int):
    """Walk the tries of whole (rotation, segment, block pair) groups; give spanning stars of the links found."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame | None:
        new = np.ones(len(pdf), bool)
        keys = pdf[["rot", "seg", "bi", "bj", "side"]].to_numpy()
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        gid = np.cumsum(new) - 1
        node = pdf.node.to_numpy()
        found = []
        # the number of a trie is put above its members' low bits
        starts = np.flatnonzero(new)
        step = 1 << (64 - low - 1)
        at = 0
        while at < len(starts):
            to = min(len(starts), at + step)
            if to < len(starts) and keys[starts[to], 4] == 1 and (keys[starts[to], :4] == keys[starts[to - 1], :4]).all():
                to -= 1
            lo, hi = starts[at], starts[to] if to < len(starts) else len(pdf)
            comp = ((gid[lo:hi] - gid[lo]).astype(np.uint64) << np.uint64(low)) | (pdf.key.to_numpy()[lo:hi].view(np.uint64) & np.uint64((1 << low) - 1))
            order = np.argsort(comp, kind="stable")
            comp, ids = comp[order], node[lo:hi][order]
            s = np.append(starts[at:to], hi) - lo
            k = keys[starts[at:to]]
            own = k[:, 2] == k[:, 3]
            cross = np.flatnonzero((~own[:-1]) & (k[:-1, :4] == k[1:, :4]).all(1)) if len(k) > 1 else np.zeros(0, int)
            mine = np.flatnonzero(own)
            a = np.concatenate([mine, cross])
            b = np.concatenate([mine, cross + 1])
            lab, some, many = np.arange(len(ids)), [], 0
            for i, j in itertools.chain(trie_join(comp, s[a], s[a + 1], s[b], s[b + 1], low, max_diff), [(lab[:0], lab[:0])]):
                some.append((i, j))
                many += len(i)
                if many > 2 * PAIRS or not len(i):
                    i, j = (np.concatenate(x) for x in zip(*some))
                    lab, some, many = forest(len(ids), np.concatenate([i, np.arange(len(ids))]), np.concatenate([j, lab])), [], 0
            rest = lab != np.arange(len(ids))
            found.append(pd.DataFrame({"u": ids[rest], "v": ids[lab[rest]]}))
            at = to
        return pd.concat(found) if found else None

    def run(batches):
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= 200_000:
                x = pd.concat(held, ignore_index=True)
                last = x[["rot", "seg", "bi", "bj"]].iloc[-1]
                open_ = (x[["rot", "seg", "bi", "bj"]] == last).all(axis=1).to_numpy()
                if not open_.all():
                    if (got := walk(x[~open_].reset_index(drop=True))) is not None:
                        yield got
                    held = [x[open_]]
                else:
                    held = [x]
                n = len(held[0])
        if held and (got := walk(pd.concat(held, ignore_index=True))) is not None:
            yield got

    return run


def segments_for(n: int, max_diff: int = 3, tile: int = TILE) -> int:
    """How many segments n fingerprints are cut into: what gives the fewest copies of each."""

    def copies(m: int) -> float:
        kept = m - max_diff
        return math.comb(m, kept) * max(1.0, n / 2.0 ** (64 * kept // m) / tile)

    return min(range(max_diff + 1, max(max_diff + 2, min(9, 2 * max_diff + 1))), key=copies)


def turned(m: int, max_diff: int) -> tuple[list[str], int]:
    """(SQL: struct(rot, key) of each choice of m - max_diff of fp's m segments, which key has first; bits below)."""
    at = [64 * i // m for i in range(m + 1)]  # segment i: bits at[i] to at[i + 1] from the top
    out = []
    for rot, first in enumerate(itertools.combinations(range(m), m - max_diff)):
        parts, to = [], 64
        for i in (*first, *(i for i in range(m) if i not in first)):
            wide = at[i + 1] - at[i]
            to -= wide
            parts.append(f"shiftleft(shiftrightunsigned(fp, {64 - at[i + 1]}) & {(1 << wide) - 1}L, {to})")
        out.append(f"struct({rot} as rot, {' | '.join(parts)} as key)")
    # where segments differ in width by one, the shorter prefix counts for all choices
    short = min(sum(at[i + 1] - at[i] for i in first) for first in itertools.combinations(range(m), m - max_diff))
    return out, 64 - short


def link_edges(groups: DataFrame, max_diff: int = 3, tile: int = TILE, segments: int | None = None) -> DataFrame:
    """Edges (u, v) between nodes of groups (fp, node), fp distinct, that span the links at <= max_diff bits."""
    turns, low = turned(segments or segments_for(groups.count(), max_diff, tile), max_diff)
    rows = groups.select("node", F.explode(F.expr(f"array({', '.join(turns)})")).alias("x")).select("node", "x.rot", "x.key", F.shiftrightunsigned("x.key", low).alias("seg"))
    sizes = rows.groupBy("rot", "seg").count().where(F.col("count") > tile)
    hot = materialize(sizes.select("rot", "seg", F.ceil(F.col("count") / tile).cast("int").alias("nb")), "hot")
    if hot.isEmpty():
        rows = rows.withColumns({"bi": F.lit(0), "bj": F.lit(0), "side": F.lit(0)})
    else:
        rows = rows.join(hot, ["rot", "seg"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        rows = rows.withColumn("b", F.pmod(F.xxhash64("key", F.lit(7)), F.col("nb")).cast("int"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
        rows = rows.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o"), "side": (F.col("b") > F.col("o")).cast("int")}).drop("b", "o", "nb")
    rows = rows.repartition("rot", "seg", "bi", "bj").sortWithinPartitions("rot", "seg", "bi", "bj", "side")
    return rows.mapInPandas(_join_tiles(max_diff, low), "u long, v long")


def simhash_groups(docs: DataFrame, max_diff: int = 3, shingle: int = 3, tile: int = TILE) -> DataFrame:
    """(doc_id, h, fp, grp, component_id) for each row of docs (doc_id, text): h hashes the text; grp, a fingerprint of
    the component, is null for a fingerprint of one row that links with none."""
    prepare(docs.sparkSession)
    fps = materialize(fingerprints(docs, shingle), "fp")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fpgroups")
    # fingerprints themselves are the nodes: ids may repeat or be null
    edges = link_edges(groups.select("fp", F.col("fp").alias("node")), max_diff, tile)
    comps = connected_components(edges, "simcc").withColumnRenamed("node", "fp")
    linked = materialize(groups.join(comps, "fp", "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "fp").alias("grp"), "least"), "simlinked")
    least = materialize(linked.groupBy("grp").agg(F.min("least").alias("component_id")), "simleast")
    # a group of one that links with nothing is its own component: only the others need to be looked up
    named = materialize(linked.select("fp", "grp").join(least, "grp"), "simnames")
    return fps.join(named, "fp", "left").select("doc_id", "h", "fp", "grp", F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def simhash_components(docs: DataFrame, max_diff: int = 3, shingle: int = 3, tile: int = TILE) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs (doc_id, text)."""
    return simhash_groups(docs, max_diff, shingle, tile).select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: doc_id, fingerprint (16 hex digits), component_id for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one row stays, the one with the smallest doc_id (null ids last), of such ones with
    the smallest hash of the text (one row, where both repeat). Rows that share an id but aren't near-duplicates stay.

    Only ids and hashes are grouped; texts are shuffled once, to be looked up by what goes: by one plan at every size."""
    d, h = fresh(docs, "_d", "_h")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(d), F.xxhash64("text", F.col("doc_id").isNull()).alias(h)]
    rows = simhash_groups(docs.select("doc_id", "text")).where("grp is not null")
    rows = rows.select("grp", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "h", F.col("doc_id").isNull().alias("none"))
    rows = materialize(rows.groupBy("grp", "d", "h", "none").agg(F.count(F.lit(1)).alias("n")), "simrows")
    first = materialize(rows.groupBy("grp").agg(F.min(F.struct("none", "d", "h")).alias("f")), "simfirst")
    marked = rows.join(first, "grp").withColumn("stays", (F.col("d") == F.col("f.d")) & (F.col("h") == F.col("f.h")) & (F.col("none") == F.col("f.none")))
    marked = materialize(marked.where("not stays or n > 1").select(F.col("d").alias(d), F.col("h").alias(h), "stays"), "simmarks")
    keyed = docs.select(*columns(docs), *key)
    kept = keyed.join(marked.select(d, h).hint("merge"), [d, h], "left_anti")
    if not (repeats := marked.where("stays").select(d, h)).isEmpty():
        kept = kept.unionByName(keyed.join(repeats.hint("merge"), [d, h], "left_semi").dropDuplicates([d, h]))
    return kept.select(*columns(docs))
