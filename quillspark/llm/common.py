"""Helpers shared by the training-data operators: scratch tables in the shared folder, code shipping, components."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: Rows in one Arrow batch. Texts of documents are up to a few 100 KB, so a batch stays within some 10 MB as a rule.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, and bound the Arrow batches by rows and by bytes."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="ship")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path, name = os.path.join(folder, "code-" + sc.applicationId + ".zip"), os.path.basename(top)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for at, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(at, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, top)))
        with open(path, "wb") as out:
            out.write(buffer.getvalue())
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def columns(df: DataFrame) -> list[F.Column]:
    """All columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until df has no column of that name."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where it is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scratch")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: the lineage is cut, lost executors cost nothing that
    was written, and joins with it have exchanges on both sides, which adaptive execution can split when they are
    skewed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest index in its component, for edges (i, j)."""
    lab = np.arange(n)
    while len(i):
        a, b = lab[i], lab[j]
        m = np.minimum(a, b)
        np.minimum.at(lab, a, m)
        np.minimum.at(lab, b, m)
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
        open_ = lab[i] != lab[j]
        i, j = i[open_], j[open_]
    return lab


def star_edges(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """A spanning star for each component of the edges (a, b) between ids: rows (u, v), v the smallest id."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = forest(len(ids), at[: len(a)], at[len(a):])
    rest = lab != np.arange(len(ids))
    return pd.DataFrame({"u": ids[rest], "v": ids[lab[rest]]})


def _contract(batches):
    """Replace a task's edges by spanning stars, a bounded number of them at a time."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n > 500_000:
            x = pd.concat(held)
            yield star_edges(x.u.to_numpy(), x.v.to_numpy())
            held, n = [], 0
    if held:
        x = pd.concat(held)
        yield star_edges(x.u.to_numpy(), x.v.to_numpy())


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for each node of edges (u long, v long); component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014) over tables in the shared folder. Each step
    begins with spanning stars in each task, so that dense groups shrink before any shuffle. Minima are aggregated
    map-side first; the joins that follow read them from a table, so a hot node's edges are split between tasks.
    """
    e = materialize(edges.select("u", "v").where("u <> v").mapInPandas(_contract, "u long, v long").distinct(), name)
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, name)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = materialize(small.where("u <> v").distinct(), name)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))


def pieces(text: str, border: re.Pattern, size: int = 1 << 20):
    """A text in pieces of some size characters, cut at places where border matches: a long one is never taken
    apart at once."""
    at = 0
    while len(text) - at > size:
        m = border.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


#: Ranges of one order: so many keys at most reach the driver and the tasks, whatever the number of rows.
MAX_RANGES = 20_000


def range_number(keys: DataFrame, rows_per_range: int) -> int:
    """Into how many ranges keys are split: by their number, MAX_RANGES at most (ranges of more rows beyond)."""
    return max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_RANGES, -(-keys.count() // rows_per_range)))


def range_cuts(keys: DataFrame, cols: list[str], rows_per_range: int = 50_000) -> list[tuple]:
    """The first key of each of some ranges that split keys by order. No key lies in two ranges.

    What reaches the driver is one key a range, MAX_RANGES at most."""
    dealt = keys.repartitionByRange(range_number(keys, rows_per_range), *cols).select(F.spark_partition_id().alias("pid"), F.struct(*cols).alias("k"))
    return sorted(tuple(r.a) for r in dealt.groupBy("pid").agg(F.min("k").alias("a")).collect())


def to_ranges(dealt: DataFrame, bucket: str, number: int, *order: str) -> DataFrame:
    """Rows to one partition for each range (bucket: its number), sorted; partitions aren't coalesced."""
    return dealt.repartitionById(number, F.col(bucket).cast("int")).sortWithinPartitions(bucket, *order)
