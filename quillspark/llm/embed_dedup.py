"""Embedding near-dedup: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors form one class; only classes are compared, each with its size, so copies are never expanded to pairs.
In each of L tables a class's bucket is the k signs of its products with k random hyperplanes. All pairs in a
bucket are compared by exact cosine in double precision; a pair that shares a bucket of an earlier table was seen
there and is left out, so each link counts once and no pair leaves its task: tasks give counts for each class and
spanning stars for the components. k follows the number of classes, L the recall asked for at the threshold itself
(closer pairs are found more surely).

Defined cases: null vectors, zero vectors and those with null or non-finite components link with nothing; vectors
of different widths never link; repeated rows count as other vectors; an empty table gives an empty result; extra
columns are ignored; null vec_ids take part, and a component with null ids only has a null component_id. A bucket of
many classes (a dense cluster that no plane cuts) is compared in full, block by block in tasks of their own: its work is
the square of its distinct vectors, its memory two blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize, prepare

#: Classes of one bucket in one tile; larger buckets are dealt out as pairs of blocks.
TILE = 2048
NO_ID = 1 << 62


def rows_of(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray | None]:
    """The lists of an Arrow column as double arrays; None where a list is null or holds a null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, at = column.values, column.offsets.to_numpy()
    holes = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
    null = column.is_null().to_numpy(zero_copy_only=False)
    return [None if null[i] or holes is not None and holes[at[i] : at[i + 1]].any() else x[at[i] : at[i + 1]] for i in range(len(column))]


def _keys(batches):
    for b in batches:
        keys = []
        for v in rows_of(b.column("embedding")):
            good = v is not None and len(v) and np.isfinite(v).all() and v.any()
            keys.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), b.column("embedding")], ["vec_id", "key", "embedding"])


def tables_for(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(k, L): signs of a bucket and number of tables for n classes."""
    k = min(30, max(2, int(math.log2(max(n, 2))) - 6))
    each = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - each)))


def _planes(width: int, k: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, k * tables))


def _signs(k: int, tables: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            sigs = []
            for v in rows_of(b.column("embedding")):
                if len(v) not in planes:
                    planes[len(v)] = _planes(len(v), k, tables, seed)
                bits = (v / np.abs(v).max()) @ planes[len(v)] >= 0
                sigs.append(bits.reshape(tables, k) @ (1 << np.arange(k)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("m"), b.column("embedding"), pa.array(sigs, pa.list_(pa.int32()))], ["rep", "m", "embedding", "sigs"])

    return run


def _unit(vs: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vs)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compare(cosine: float):
    """Links within each whole (table, bucket, block pair) group, as rows a, b (null: a count), cnt."""

    def tile(t, own, rep, m, x, sigs, side):
        n = len(rep)
        left = np.arange(n) if own else np.flatnonzero(side == 0)
        right = left if own else np.flatnonzero(side == 1)
        cnt, lab = np.zeros(n, np.int64), np.arange(n)
        for at in range(0, len(left), 256):
            i, j = np.nonzero(x[left[at : at + 256]] @ x[right].T >= cosine)
            i, j = left[at + i], right[j]
            if own:
                i, j = i[i < j], j[i < j]
            if t and len(i):
                new = ~(sigs[i, :t] == sigs[j, :t]).any(1)
                i, j = i[new], j[new]
            np.add.at(cnt, i, m[j])
            np.add.at(cnt, j, m[i])
            if len(i):
                lab = forest(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, lab]))
        got, rest = np.flatnonzero(cnt), np.flatnonzero(lab != np.arange(n))
        return np.concatenate([rep[got], rep[rest]]), np.concatenate([np.full(len(got), -1), rep[lab[rest]]]), np.concatenate([cnt[got], np.zeros(len(rest), np.int64)])

    def walk(held):
        t, bi, bj, wide, bucket, rep, m, side = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("t", "bi", "bj", "wide", "bucket", "rep", "m", "side"))
        vs = [v for b in held for v in rows_of(b.column("embedding"))]
        sigs = np.stack([v.astype(np.int64) for b in held for v in rows_of(b.column("sigs"))])
        new = np.ones(len(t), bool)
        for c in (t, bi, bj, wide, bucket):
            new[1:] &= c[1:] == c[:-1]
        new[1:] = ~new[1:]
        s = np.append(np.flatnonzero(new), len(t))
        out = []
        for lo, hi in zip(s[:-1], s[1:]):
            if hi - lo > 1:
                out.append(tile(int(t[lo]), bi[lo] == bj[lo], rep[lo:hi], m[lo:hi], _unit(vs[lo:hi]), sigs[lo:hi], side[lo:hi]))
        if out:
            a, b, c = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b == -1), pa.array(c)], ["a", "b", "cnt"])

    names = ("t", "wide", "bucket", "bi", "bj")

    def run(batches):
        held, n, last = [], 0, None
        for b in batches:
            if not len(b):
                continue
            first = tuple(b.column(c)[0].as_py() for c in names)
            if n >= 20_000 and first != last:
                yield from walk(held)
                held, n = [], 0
            held.append(b)
            n += len(b)
            last = tuple(b.column(c)[len(b) - 1].as_py() for c in names)
            if n >= 20_000 and len(b) > 1:  # cut behind the last whole group
                cut = next((i for i in range(len(b) - 1, 0, -1) if tuple(b.column(c)[i - 1].as_py() for c in names) != last), None)
                if cut:
                    held[-1] = b.slice(0, cut)
                    yield from walk(held)
                    held, n = [b.slice(cut)], len(b) - cut
        if held:
            yield from walk(held)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999, seed: int = 11, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    prepare(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.simpleString()
    keyed = materialize(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_keys, f"vec_id long, key binary, embedding {kind}"), "vkeys")
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding"))
    classes = classes.withColumn("rep", F.coalesce("rep", F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("key"), 3)))
    classes = materialize(classes, "vclasses")
    k, tables = tables_for(classes.count(), cosine, recall)
    signed = classes.select("rep", "m", "embedding").mapInArrow(_signs(k, tables, seed), f"rep long, m long, embedding {kind}, sigs array<int>")
    signed = materialize(signed, "vsigns")
    rows = signed.select("rep", "m", "embedding", "sigs", F.size("embedding").alias("wide"), F.posexplode("sigs").alias("t", "bucket"))
    # of buckets, the ones with more than one class matter; their sizes come from keys alone
    sizes = signed.select(F.size("embedding").alias("wide"), F.posexplode("sigs").alias("t", "bucket")).groupBy("t", "wide", "bucket").count()
    hot = materialize(sizes.where(F.col("count") > tile).select("t", "wide", "bucket", F.ceil(F.col("count") / tile).cast("int").alias("nb")), "vhot")
    if hot.isEmpty():
        rows = rows.withColumns({"bi": F.lit(0), "bj": F.lit(0), "side": F.lit(0)})
    else:
        rows = rows.join(hot, ["t", "wide", "bucket"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        rows = rows.withColumn("b", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("nb")).cast("int"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
        rows = rows.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o"), "side": (F.col("b") > F.col("o")).cast("int")})
    rows = rows.select("t", "wide", "bucket", "bi", "bj", "side", "rep", "m", "embedding", "sigs")
    rows = rows.repartition("t", "wide", "bucket", "bi", "bj").sortWithinPartitions("t", "wide", "bucket", "bi", "bj")
    found = materialize(rows.mapInArrow(_compare(cosine), "a long, b long, cnt long"), "vlinks")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("cnt").alias("far"))
    comps = connected_components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")), "vcc")
    named = classes.select("key", "rep", "m").join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.where("m > 1 or far is not null").select("key", (F.col("m") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "key").join(materialize(named, "vnames"), "key", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(component < NO_ID, component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    """op4 over all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
