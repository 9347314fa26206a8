"""Control and sample corpora: invented lines, made by rule, in the text form that the parser reads.

Works are (title, control_type, text); ``as_files`` gives them as the files that parse_works takes, and ``write_texts``
writes such files with ---- lines between works. Nothing is deleted: a corpus is written to a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONTROL_TYPES

# The control types of generated backgrounds.
BACKGROUND_TYPES = ("generic_pop", "generic_indie", "generic_worship_or_spiritual", "llm_generated_near_miss", "mutated_target_style", "nihilistic", "ornate_poetic", "overly_preachy", "topic_matched_wrong_style")
PER_TYPE, NEAR_MISSES, LOOKALIKES, TARGETS = 4, 12, 13, 16

PLACES = ("harbour", "orchard", "station", "stairwell", "quarry", "market", "rooftop", "ferry")
THINGS = ("lantern", "ledger", "kettle", "ribbon", "compass", "window", "letter", "bicycle", "umbrella")
DEEDS = ("I carry my %s past the %s", "I count every %s left at the %s", "Nobody mends my %s beside the %s", "I traded a %s for the road to the %s", "They painted my %s the colour of the %s")
WORDS = "title string, control_type string, a string, b string, c string, d string"


def _line(n: int, shift: int) -> str:
    return DEEDS[(n + shift) % len(DEEDS)] % (THINGS[(n * 2 + shift) % len(THINGS)], PLACES[(n * 3 + 2 * shift) % len(PLACES)])


def _rows(kinds: list[str], first: int) -> list[tuple]:
    name = lambda n: f"{THINGS[n % len(THINGS)].title()} {PLACES[n // len(THINGS) % len(PLACES)].title()} {n}"
    return [(name(n), k, *(_line(n, s) for s in range(4))) for n, k in enumerate(kinds, first)]


def _sections(*parts: tuple[str, tuple[Column, ...]]) -> Column:
    return F.concat_ws("\n\n", *[F.concat_ws("\n", F.lit(f"[{name}]"), *lines) for name, lines in parts])


def control_text(verse: Column, chorus: Column, closing: Column) -> Column:
    """The text of a control: two verses, choruses and a bridge of three lines, with changed persons and a loud end."""
    we = F.regexp_replace(verse, r"\bI\b", "We")
    you = F.regexp_replace(closing, r"\bI\b", "You")
    the = F.regexp_replace(verse, r"\bmy\b", "the")
    twice = (chorus, closing, chorus, closing)
    return _sections(("Verse 1", (verse, closing, we, closing)), ("Chorus", twice), ("Verse 2", (verse, you, the, closing)), ("Chorus", twice), ("Bridge", (verse, chorus, closing, chorus)), ("Final Chorus", (chorus, closing, F.upper(chorus), closing)))


def target_text(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The text of a sample target: four lines in four blocks, in changing order."""
    return _sections(("Verse 1", (a, b, c, d)), ("Chorus", (c, d, a, b)), ("Verse 2", (a, d, b, c)), ("Final Chorus", (c, d, c, d)))


def background_controls(spark: SparkSession) -> DataFrame:
    """(title, control_type, text): PER_TYPE works of each background type."""
    rows = spark.createDataFrame(_rows([k for k in BACKGROUND_TYPES for _ in range(PER_TYPE)], 0), WORDS)
    return rows.select("title", "control_type", control_text(F.col("a"), F.col("b"), F.col("c")).alias("text"))


def hard_controls(spark: SparkSession) -> DataFrame:
    """(title, control_type, text): near misses on the same topics, and attempted lookalikes."""
    rows = spark.createDataFrame(_rows([CONTROL_TYPES[0]] * NEAR_MISSES + [CONTROL_TYPES[1]] * LOOKALIKES, 100), WORDS)
    a, b, c, d = (F.col(x) for x in "abcd")
    near = _sections(("Verse", (a, b, c, d)), ("Chorus", (d, b, a)), ("Bridge", (c, a)))
    return rows.select("title", "control_type", F.when(F.col("control_type") == CONTROL_TYPES[0], near).otherwise(target_text(a, b, c, d)).alias("text"))


def sample_targets(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A target corpus of TARGETS works and one candidate, to try a run with."""
    rows = spark.createDataFrame(_rows([None] * (TARGETS + 1), 200), WORDS)
    out = rows.select("title", "control_type", target_text(*(F.col(x) for x in "abcd")).alias("text"))
    last = _rows([None], 200 + TARGETS)[0][0]
    return out.where(F.col("title") != last), out.where(F.col("title") == last)


def file_text() -> Column:
    """A work (title, control_type, text) as a text file."""
    kind = F.concat(F.lit("\nSynthetic-Control-Type: "), F.col("control_type"))
    return F.concat(F.lit("Title: "), F.col("title"), F.coalesce(kind, F.lit("")), F.lit("\n\n"), F.col("text"), F.lit("\n"))


def as_files(works: DataFrame, set_name: str) -> DataFrame:
    """works as files (path, value, set), a file each."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9_]+", "-"), "^-|-$", "")
    path = F.concat(F.lit(f"generated/{set_name}/"), F.concat_ws("__", "control_type", slug), F.lit(".txt"))
    return works.select(path.alias("path"), file_text().alias("value"), F.lit(set_name).alias("set"))


def write_texts(works: DataFrame, folder: str) -> None:
    """Write works to text files of a new folder, ---- between those of one file."""
    works.select(F.concat(file_text(), F.lit("\n----")).alias("value")).write.mode("errorifexists").text(folder)
