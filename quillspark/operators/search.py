"""Exact nearest neighbours by cosine, by blocks: each pair of a block of queries and a block of the pool is a task's."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPSILON

POOL_BLOCK, QUERY_BLOCK, LEAST_BLOCK, ROWS, PAIRS, PARTITIONS = 4096, 16_384, 256, 1024, 65_536, 20_000
#: Products of matrices are off by less; what is that near to the last place is measured again.
SLACK = 1e-9


def _tiles(k: int, drop_self: bool):
    """What a task does; all of it is sent along with the plan, so workers need nothing of this package."""

    def matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
        """Rows of one width; missing and empty vectors are zeros."""
        rows = [np.zeros(0) if v is None else np.asarray(v, dtype=np.float64) for v in vectors]
        width = max([width, *map(len, rows)])
        if any(len(r) not in (0, width) for r in rows):
            raise ValueError("vectors differ in length")
        return np.stack([r if len(r) else np.zeros(width) for r in rows]) if rows else np.zeros((0, width))

    def cosines(a: np.ndarray, b: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Cosines of rows in pairs, each by the same sum wherever it stands, so that equal vectors tie."""
        return np.where(norms < EPSILON, 0.0, np.einsum("ij,ij->i", a, b) / np.maximum(norms, EPSILON))

    def top(ids: np.ndarray, vectors: np.ndarray, pool_ids: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pool row, cosine) of the k nearest of the pool for each row, ties by pool id."""
        size, pool_size = np.sqrt((vectors**2).sum(1)), np.sqrt((pool**2).sum(1))
        norms = size[:, None] * pool_size[None, :]
        near = np.where(norms < EPSILON, 0.0, vectors @ pool.T / np.maximum(norms, EPSILON))
        if drop_self:
            place: dict = {}
            for j, x in enumerate(pool_ids):
                place.setdefault(x, []).append(j)
            for i, x in enumerate(ids):
                near[i, place.get(x, [])] = -np.inf
        kept = min(k, len(pool))
        last = np.partition(near, len(pool) - kept, axis=1)[:, len(pool) - kept]
        i, j = np.nonzero((near >= last[:, None] - SLACK) & (near > -np.inf))
        order = np.empty(len(pool), int)
        order[np.argsort(pool_ids, kind="stable")] = np.arange(len(pool))
        some = [(i[s : s + PAIRS], j[s : s + PAIRS]) for s in range(0, max(1, len(i)), PAIRS)]
        value = np.concatenate([cosines(vectors[x], pool[y], norms[x, y]) for x, y in some])
        by = np.lexsort((order[j], -value, i))
        i, j, value = i[by], j[by], value[by]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[first], j[first], value[first]

    def run(batches):
        tile, held, pool = None, [], None
        for pdf in batches:
            names = pdf.tile.to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for lo, hi in zip(edges, edges[1:]):
                rows = pdf.iloc[lo:hi]
                if names[lo] != tile:
                    tile, held, pool = names[lo], [], None
                side = rows.side.to_numpy()
                if (side == 0).any():
                    held.append(rows[side == 0])
                asked = rows[side == 1]
                if not len(asked) or not held:
                    continue
                if pool is None:
                    all_ = pd.concat(held)
                    pool = all_.id.to_numpy(), matrix(all_.vector)
                for s in range(0, len(asked), ROWS):
                    q = asked.iloc[s : s + ROWS]
                    m = matrix(q.vector, pool[1].shape[1])
                    if m.shape[1] != pool[1].shape[1]:
                        if pool[1].shape[1]:
                            raise ValueError("vectors differ in length")
                        pool = pool[0], np.zeros((len(pool[0]), m.shape[1]))
                    i, j, value = top(q.id.to_numpy(), m, *pool)
                    yield pd.DataFrame({"part": q.part.to_numpy()[i], "id": q.id.to_numpy()[i], "neighbour": pool[0][j], "similarity": value})

    return run


def nearest(queries: DataFrame, pool: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """(part, id, neighbour, similarity, rank): for each of queries (part, id, vector) the k most similar of the rows of
    pool (part, id, vector) in the same part, ties by id. Missing, empty and zero vectors have similarity 0.

    Parts and ids aren't null, a part's ids don't repeat, both sides' ids are of one type, components are finite. Both
    sides are dealt to blocks by hash, as many as their counts ask for, so a part of any size is spread; a task holds one
    block of the pool and some rows of queries at once, and passes on k rows a query."""
    some, many = pool.count(), queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    pools = max(1, -(-some // POOL_BLOCK))
    asks = max(1, -(-many // QUERY_BLOCK), min(cores, -(-many // LEAST_BLOCK)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    sided = lambda df, side: df.select("part", "id", F.col("vector").cast("array<double>").alias("vector"), F.lit(side).alias("side"))
    left = sided(queries, 1).select("*", dealt(asks).alias("a"), every(pools).alias("b"))
    right = sided(pool, 0).select("*", every(asks).alias("a"), dealt(pools).alias("b"))
    rows = right.unionByName(left).select("part", "id", "vector", "side", F.concat_ws("|", "a", "b", "part").alias("tile"))
    rows = rows.repartition(min(PARTITIONS, max(asks * pools, cores)), "tile").sortWithinPartitions("tile", "side")
    kinds = dict(queries.dtypes)
    found = rows.mapInPandas(_tiles(k, drop_self), f"part {kinds['part']}, id {kinds['id']}, neighbour {dict(pool.dtypes)['id']}, similarity double")
    rank = F.row_number().over(Window.partitionBy("part", "id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
