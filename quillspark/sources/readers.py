"""Readers and writers: JSON lines, CSV, JSON arrays, whole text files, manifests; keyed upsert."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import SOURCE_TYPES

PARTS = 64
#: The folder of targets that needs no manifest: its owner supplies it.
OWN_TARGETS = "target-corpus"
MANIFEST = "sourceType string, works array<struct<title:string,localPath:string>>, corpusName string"


def _or_empty(spark: SparkSession, schema: StructType | str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a fixed schema; a missing path is an empty table, a bad line an error."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of old whose key isn't in new, and for each key of new the row that is last by order."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def read_texts(spark: SparkSession, path: str, set_name: str, recursive: bool = False) -> DataFrame:
    """(path, value, set): a row for each .txt file; a folder that isn't there has none."""
    read = lambda: spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[tT][xX][tT]").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return _or_empty(spark, "path string, value string", read).withColumn("set", F.lit(set_name))


def infer_format(path: str) -> str:
    end = path.lower().rsplit(".", 1)[-1]
    return end if end in ("json", "jsonl") else "csv"


def read_rows(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A dataset of text columns. CSV: quotes with doubled escapes and line breaks inside; blank rows go, missing cells are ''."""
    fmt = fmt or infer_format(path)
    if fmt == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
        df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
        return df.where(F.exists(F.array(*[F.col(f"`{c}`") for c in df.columns]), lambda x: F.trim(x) != ""))
    if fmt == "json":
        # a document is split into its rows by Spark; its first character tells whether it is an array
        heads = spark.read.text(path, wholetext=True).where(~F.coalesce(F.col("value"), F.lit("")).rlike(r"^[\s\uFEFF]*\["))
        if not heads.isEmpty():
            raise ValueError(f"{path} must be a JSON array of objects")
    return spark.read.option("multiLine", fmt == "json").option("mode", "FAILFAST").json(path)


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """df with places from 1 in the order of a column without repeats, nulls first.

    Rows are dealt to parts by fixed cuts (PARTS at most, from the column's own order), numbered within their part, and
    moved on by the sizes of the parts before: the cuts and sizes are all that the driver sees."""
    parts = df.select(F.col(order).alias("k")).where("k is not null").repartitionByRange(PARTS, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k"))
    cuts = sorted(r.k for r in parts.select("k").collect())
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*[F.lit(k) for k in cuts]), lambda k: F.coalesce(k <= F.col(order), F.lit(False))))
    rows = df.withColumn("_part", part)
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    before = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes}
    moved = F.coalesce(*[F.when(F.col("_part") == p, F.lit(n)) for p, n in before.items()]) if before else F.lit(0)
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy("_part").orderBy(order)) + moved).cast("int")).drop("_part")


def import_dataset(rows: DataFrame, order: str, text: str = "text", title: str = "title", author: str = "author", include: str = "", exclude: str = "", limit: int = 0) -> DataFrame:
    """(n, title, author, text): rows by author, without blank texts, numbered by order; at most limit of them."""
    trimmed = lambda c, other: F.trim(F.coalesce(F.col(c).cast("string"), other))
    kept = rows.withColumns({"_a": trimmed(author, F.lit("Unknown Author")), "_x": trimmed(text, F.lit(""))}).where("_x <> ''")
    if include:
        kept = kept.where(F.lower("_a") == include.lower())
    if exclude:
        kept = kept.where(F.lower("_a") != exclude.lower())
    if limit:
        kept = kept.orderBy(order).limit(limit)
    kept = numbered(kept, order)
    return kept.select("n", trimmed(title, F.concat(F.lit("Untitled "), F.col("n").cast("string"))).alias("title"), F.col("_a").alias("author"), F.col("_x").alias("text"))


def write_corpus(works: DataFrame, folder: str, source_type: str = "licensed", description: str = "Local dataset import", source: str = "", filters: dict | None = None) -> None:
    """Imported works (n, title, author, text) as a corpus: text files with ---- lines between works, and a manifest.

    The folder must be new. The manifest is one document, so one task writes its lines, one a work, in order."""
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"source_type must be one of {', '.join(SOURCE_TYPES)}")
    text = F.concat(F.lit("Title: "), F.col("title"), F.lit("\nAuthor: "), F.col("author"), F.lit("\n\n"), F.col("text"), F.lit("\n\n----"))
    works.select(text.alias("value")).write.mode("errorifexists").text(f"{folder}/works")
    head = {"corpusName": f"Imported text dataset: {folder}", "sourceType": source_type, "sourceDescription": description, "redistribution": "do_not_redistribute", "importedFrom": source, "filters": {k: v for k, v in (filters or {}).items() if v}}
    entry = F.to_json(F.struct("title", "author", F.lit("works").alias("localPath"), F.lit(description).alias("permissionNote")))
    rows = works.select(F.col("n").cast("long").alias("n"), F.concat(F.when(F.col("n") > 1, ",").otherwise(""), entry).alias("value"))
    ends = works.sparkSession.createDataFrame([(-1, json.dumps(head)[:-1] + ', "works": ['), (1 << 60, "]}")], "n long, value string")
    rows.unionByName(ends).coalesce(1).sortWithinPartitions("n").select("value").write.mode("errorifexists").text(f"{folder}/manifest.json")


def read_seeds(spark: SparkSession, root: str, set_name: str = "target") -> DataFrame:
    """(path, value, set) of the work.txt of each folder of root, named by its folder; none if there are none."""
    read = lambda: spark.read.text(f"{root}/*/work.txt", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return _or_empty(spark, "path string, value string", read).withColumn("set", F.lit(set_name))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row (root, value): the text of a folder's manifest, null if it has none."""
    found = _or_empty(spark, "value string", lambda: spark.read.text(f"{root}/manifest.json", wholetext=True).select("value"))
    return found.agg(F.max("value").alias("value")).select(F.lit(root).alias("root"), "value")


def manifest_status(manifests: DataFrame) -> DataFrame:
    """manifests (root, value: JSON text or null) to (root, present, valid, source_type, work_count, issues)."""
    # a text that isn't an object, or whose works isn't an array, gives nulls here
    parsed = manifests.withColumn("_m", F.from_json("value", MANIFEST)).withColumn("_w", F.get_json_object("value", "$.works"))
    source, works = F.col("_m.sourceType"), F.coalesce(F.col("_w").startswith("["), F.lit(False))
    bad = F.col("value").isNotNull() & F.get_json_object("value", "$").isNull()
    issues = F.array(
        F.when(F.col("value").isNull(), "there is no manifest.json"),
        F.when(bad, "manifest.json can't be read as JSON"),
        F.when(F.col("value").isNotNull() & ~bad & (F.coalesce(source, F.lit("")) == ""), "it names no sourceType"),
        F.when(~bad & (source != "") & ~source.isin(*SOURCE_TYPES), f"its sourceType is none of {', '.join(SOURCE_TYPES)}"),
        F.when(F.col("value").isNotNull() & ~bad & ~works, "its works aren't an array"),
    )
    rows = parsed.withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))
    own = F.col("value").isNull() & (F.regexp_replace(F.translate("root", "\\", "/"), "/$", "") == OWN_TARGETS)
    rows = rows.withColumn("issues", F.when(own, F.array(F.lit("no manifest: the user supplies this corpus"))).otherwise(F.col("issues")))
    return rows.select("root", F.col("value").isNotNull().alias("present"), (own | (F.size("issues") == 0)).alias("valid"), F.when(own, "user_supplied").otherwise(source).alias("source_type"), F.when(works, F.size("_m.works")).alias("work_count"), "issues")


def readiness(counts: DataFrame) -> DataFrame:
    """counts (experiment_id, target_works, background_works, min_target_works, min_background_works, target_valid,
    background_valid, and candidate_works and candidate_valid if there are candidates) with blockers and ready."""
    some = F.coalesce((F.col("candidate_works") > 0) & ~F.col("candidate_valid"), F.lit(False)) if {"candidate_works", "candidate_valid"} <= set(counts.columns) else F.lit(False)
    blockers = F.array(
        F.when(F.col("target_works") < F.col("min_target_works"), F.format_string("The target corpus has %d works, %d are needed.", F.col("target_works"), F.col("min_target_works"))),
        F.when(F.col("background_works") < F.col("min_background_works"), F.format_string("The background corpus has %d works, %d are needed.", F.col("background_works"), F.col("min_background_works"))),
        F.when((F.col("target_works") > 0) & ~F.col("target_valid"), "The target corpus has no valid manifest."),
        F.when((F.col("background_works") > 0) & ~F.col("background_valid"), "The background corpus has no valid manifest."),
        F.when(some, "The candidate corpus has no valid manifest."),
    )
    return counts.withColumn("blockers", F.filter(blockers, lambda x: x.isNotNull())).withColumn("ready", F.size("blockers") == 0)
