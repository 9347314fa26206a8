"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents are all taken target / size times on average: everyone the whole part of that, and one more
time with the fraction's probability. Which ones is decided by the cube method (Deville and Tille 2004): inclusion
probabilities move along the null-space of the balancing constraints (documents and words of the source) until
they are 0 or 1. Three open documents always leave one direction, (s2-s3, s3-s1, s1-s2); the two step lengths that
close one are drawn so that probabilities stay right on average. Blocks of some 4,000 documents of a source do this
in parallel, larger documents first; of each at most two documents stay open, which go to blocks of the next level,
until each source is one block. Its last two are the landing problem: the choice nearest to the words still due, and
then exchanges of single documents of that last block while they come nearer. So a source's words come as near to their
target as they can, at the cost of the cube's own draw there: for the last block's documents (at most ``block`` of a
source) inclusion probabilities and the documents' total are kept approximately only; all others keep theirs.
Draws come from a generator seeded with source, level and block, and blocks are ordered, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; rows that repeat are
documents each; null doc_ids stay null; if all sizes are 0, nothing is taken; an empty table gives an empty result;
extra columns are ignored; of choices equally near the first stays; a very long text counts by its words, like any other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, materialize, prepare

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2.0
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sources(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Target of each source of sized (src, size): (src, source_size, docs, target).

    One row a source is ranked in one task; only sums over them come to the driver."""
    table = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    at = F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights)))
    table = materialize(table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int") + 1)), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = None  # target of weight 1 for sources below their limit
    capped = F.lit(False)
    n = -1
    while total:
        c = table.agg(F.count_if(capped), F.sum(F.when(capped, limit * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if c[0] == n or not c[2]:
            break
        n, level = c[0], (share * total - (c[1] or 0.0)) / c[2]
        capped = F.lit(level) * F.col("weight") > limit * F.col("source_size")
    target = F.least(F.lit(level or 0.0) * F.col("weight"), limit * F.col("source_size")) if total else F.lit(0.0)
    return table.select("src", "source_size", "docs", target.cast("double").alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until at most two are between 0 and 1, keeping their sum and that of size * p."""
    p = p.astype(np.float64).tolist()
    s = size.astype(np.float64).tolist()
    draw = iter(rng.random(2 * len(p) + 8).tolist())
    pool: list[int] = []
    for i in range(len(p)):
        if 1e-9 < p[i] < 1 - 1e-9:
            pool.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(pool) == 3:
            a, b, c = pool
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, d in zip(pool, u):
                if d > 0:
                    up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
                elif d < 0:
                    up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
            step = up if next(draw) * (up + down) < down else -down
            for k, d in zip(pool, u):
                p[k] += step * d
                if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                    p[k] = float(round(p[k]))
            pool = [k for k in pool if 0 < p[k] < 1]
    return np.array(p)


def land(size: np.ndarray, start: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Close the last open documents: the choice whose words are nearest to those due; then, while that comes nearer,
    change the one document of this last block (of those that were open at its start) that comes nearest."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    due = float(size[open_] @ p[open_])
    best = min(range(1 << len(open_)), key=lambda c: (abs(sum(int(size[k]) for j, k in enumerate(open_) if c >> j & 1) - due), c))
    out = p.copy()
    out[open_] = [best >> j & 1 for j in range(len(open_))]
    free = np.flatnonzero((start > 1e-9) & (start < 1 - 1e-9))
    off = float(size @ (out - start))
    while len(free):
        after = off + np.where(out[free] > 0.5, -size[free], size[free])
        k = int(np.abs(after).argmin())
        if abs(after[k]) >= abs(off) - 0.5:
            break
        out[free[k]], off = 1 - out[free[k]], float(after[k])
    return out


def _level(level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable")
        size = pdf["size"].to_numpy()
        rng = np.random.default_rng([seed, level, int(pdf.block.iloc[0]), zlib.crc32(str(pdf.src.iloc[0]).encode())])
        p = flight(size, pdf.p.to_numpy(), rng)
        if pdf.blocks.iloc[0] == 1:
            p = land(size, pdf.p.to_numpy(np.float64), p)
        return pdf.assign(p=p, doc_id=pdf.doc_id.astype("Int64"))

    return run


STATE = "doc_id long, h long, src string, size long, source_size long, target double, whole int, p double, blocks long, block long"


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, size, source_size, target, copies) for each row of docs (doc_id, text, source); h hashes the text."""
    prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    src = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))  # the null source's name comes after all others
    sized = materialize(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), src.alias("src"), size.alias("size")), "sizes")
    plan = materialize(sources(sized, weights, share, limit), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = sized.join(plan, "src").withColumn("ratio", ratio)
    state = state.withColumns({"whole": F.floor("ratio").cast("int"), "p": F.col("ratio") - F.floor("ratio"), "blocks": F.ceil(F.col("docs") / block), "block": F.lit(0).cast("long")})
    state = state.select("doc_id", "h", "src", "size", "source_size", "target", "whole", "p", "blocks", "block")
    most = plan.agg(F.max(F.ceil(F.col("docs") / block))).first()[0]
    done, level = None, 0
    while most:
        state = state.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", F.lit(level)), "blocks"))
        state = materialize(state.groupBy("src", "block").applyInPandas(_level(level, seed), STATE), "cube")
        closed = state.where("p = 0 or p = 1")
        done = closed if done is None else done.unionByName(closed)
        if most == 1:
            break
        # at most two of each block are open
        state = state.where("p > 0 and p < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        most, level = -(-2 * most // block), level + 1
    done = state if done is None else done
    return done.select("doc_id", "h", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7 over all documents."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it.

    Texts are shuffled once: the join and the numbering of rows with one id and text use the same keys."""
    d, h, c, k, x = fresh(docs, "_d", "_h", "_c", "_k", "_x")
    key = [F.coalesce("doc_id", F.lit(-1)).alias(d), F.coalesce(F.xxhash64("text"), F.lit(0)).alias(h)]
    taken = mix(docs).select(F.coalesce("doc_id", F.lit(-1)).alias(d), F.col("h").alias(h), "copies")
    taken = taken.groupBy(d, h).agg(F.sort_array(F.collect_list("copies")).alias(c)).where(F.exists(c, lambda n: n > 0))
    nth = F.row_number().over(Window.partitionBy(d, h).orderBy(F.lit(0)))
    rows = docs.select(*columns(docs), *key).join(taken, [d, h]).withColumn(k, F.element_at(c, nth)).where(F.col(k) > 0)
    return rows.select(*columns(docs), F.explode(F.sequence(F.lit(1), k)).alias(x)).drop(x)
