"""Vector algebra over ARRAY<DOUBLE> columns.

Higher-order lambdas evaluate again what stands inside them; let() binds each scalar and intermediate array once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return let(k, lambda f: F.transform(a, lambda x: x * f))


def normalize(a: Column) -> Column:
    """a / |a|; zeros if |a| is next to nothing."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n < EPSILON, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    """0 for a missing, empty or zero vector."""
    value = let(a, lambda v: let(b, lambda w: let(norm(v) * norm(w), lambda d: F.when(d < EPSILON, F.lit(0.0)).otherwise(dot(v, w) / d))))
    return F.coalesce(value, F.lit(0.0))


def project(v: Column, basis: Column) -> Column:
    """The projection of v on an orthonormal basis (ARRAY<ARRAY<DOUBLE>>)."""
    zeros = F.transform(v, lambda x: F.lit(0.0))
    return F.aggregate(basis, zeros, lambda acc, b: let(dot(v, b), lambda d: F.zip_with(acc, b, lambda x, y: x + d * y)))


def orthonormalize(vectors: Column) -> Column:
    """Modified Gram-Schmidt in the given order; a rest next to nothing is dropped."""

    def rest(v: Column, basis: Column) -> Column:
        return F.aggregate(basis, v, lambda r, b: let(dot(r, b), lambda d: F.zip_with(r, b, lambda x, y: x - d * y)))

    def take(basis: Column, v: Column) -> Column:
        return let(rest(v, basis), lambda r: let(norm(r), lambda n: F.when(n < EPSILON, basis).otherwise(F.concat(basis, F.array(F.transform(r, lambda x: x / n))))))

    return F.aggregate(vectors, F.array().cast("array<array<double>>"), take)


def residualize(v: Column, content: Column) -> Column:
    """normalize(v less its projection on the span of the content vectors)."""
    basis = orthonormalize(F.transform(content, normalize))
    return let(v, lambda x: let(basis, lambda b: normalize(subtract(x, project(x, b)))))


def mean_vectors(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, count, vector): element-wise means. Partial sums are combined map-side for each place of the vector."""
    keys = keys or ["_all"]
    src = df.where(F.col(vector).isNotNull()) if keys != ["_all"] else df.where(F.col(vector).isNotNull()).withColumn("_all", F.lit(0))
    cells = src.select(*keys, F.posexplode(vector).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg("_x").alias("_x"), F.count(F.lit(1)).alias("_n"))
    out = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "_x"))).alias("_v"), F.max("_n").alias("count"), F.min("_n").alias("_least"))
    whole = F.when(F.col("_least") == F.col("count"), F.col("_v._x")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
    return out.select(*[k for k in keys if k != "_all"], "count", whole.alias("vector"))


def centroids(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    return mean_vectors(df, keys, vector).withColumn("vector", normalize(F.col("vector")))
