"""Topic profiles from keywords, and their incremental upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BANNED_TOPIC_WORDS, IMAGE_STOPWORDS, TOPIC_STOPWORDS
from ..functions.text import BORDER, collapse, topic_tokens

FIELDS = ("main_theme", "emotional_subject", "central_situation", "central_image", "content_only_summary")


def keywords(works: DataFrame, key: str = "id", k: int = 6) -> DataFrame:
    """(key, rank, token, n): the k most frequent tokens of each work, ties by first appearance.

    Texts are dealt out by key first, so they are shuffled instead of their tokens; counts and ranks need no more."""
    tokens = works.select(key, "text").repartition(key).select(key, F.posexplode(topic_tokens(F.col("text"))).alias("_pos", "token")).where(~F.col("token").isin(TOPIC_STOPWORDS))
    counts = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "_first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "token", "n")


def clean(c: Column) -> Column:
    return collapse(F.regexp_replace(c, f"(?i){BORDER}(?:{'|'.join(BANNED_TOPIC_WORDS)}){BORDER}", ""))


# The phrases of profiles where keywords are missing, and around them.
def topic_profiles(works: DataFrame, domain: str = "lyrics") -> DataFrame:
    """works (id, title, text) to (work_id, five fields, synthetic, extractor)."""
    top = keywords(works).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("_k"))
    rows = works.select("id", "title").join(top, "id", "left").withColumn("_k", F.coalesce(F.col("_k.token"), F.array().cast("array<string>")))
    some = lambda a, n, other: F.coalesce(F.nullif(F.array_join(F.slice("_k", a, n), ", "), F.lit("")), other)
    image = F.coalesce(F.try_element_at(F.filter("_k", lambda x: ~x.isin(IMAGE_STOPWORDS)), F.lit(1)), F.try_element_at("_k", F.lit(1)), F.lit("unspecified"))
    fields = (
        some(1, 3, F.col("title")),
        some(4, 3, F.lit("personal conflict")),
        F.concat(F.lit("A narrator works through "), some(1, 4, F.lit("a personal situation")), F.lit(".")),
        image,
        F.concat(F.lit(f"The {domain} work concerns "), some(1, 6, F.col("title")), F.lit(".")),
    )
    return rows.select(F.col("id").alias("work_id"), *[clean(c).alias(n) for n, c in zip(FIELDS, fields)], F.lit(True).alias("synthetic"), F.lit("local-keyword-fallback").alias("extractor"))


def topic_text() -> Column:
    return F.concat_ws("\n", *[F.coalesce(f, F.lit("")) for f in FIELDS])


def refresh_topics(works: DataFrame, cached: DataFrame, domain: str = "lyrics", force: bool = False) -> DataFrame:
    """Cached profiles of works that are still there, and new ones of those that have none."""
    if force:
        return topic_profiles(works, domain)
    ids = works.select(F.col("id").alias("work_id"))
    new = works.join(cached.select(F.col("work_id").alias("id")), "id", "left_anti")
    return cached.join(ids, "work_id", "left_semi").unionByName(topic_profiles(new, domain))


PROVIDERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def register_provider(name: str, extract: Callable[[DataFrame, str], DataFrame]) -> None:
    """Add a topic provider: a function of works (id, domain, title, text) and the domain's name that gives
    (work_id, the five fields), say by mapInPandas over a model's answers."""
    PROVIDERS[name] = extract


def extract_topics(works: DataFrame, domain: str = "lyrics", provider: str = "local") -> DataFrame:
    """Profiles by a registered provider, its fields cleaned like the local ones (missing ones empty), or the local ones."""
    if provider == "local":
        return topic_profiles(works, domain)
    rows = PROVIDERS[provider](works, domain)
    return rows.select("work_id", *[clean(F.coalesce(F.col(n) if n in rows.columns else F.lit(None).cast("string"), F.lit(""))).alias(n) for n in FIELDS], F.lit(False).alias("synthetic"), F.lit(provider).alias("extractor"))
