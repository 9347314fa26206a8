"""Features of atoms, blocks and works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FIRST_PERSON, SECOND_PERSON
from ..functions.text import alternation, word_count


def atom_features(atoms: DataFrame) -> DataFrame:
    t = F.col("text")
    return atoms.withColumns({
        "word_count": word_count(t),
        "character_count": F.length(t),
        "question_mark_present": t.contains("?"),
        "exclamation_mark_present": t.contains("!"),
        "first_person_pronoun_count": alternation(t, FIRST_PERSON),
        "second_person_pronoun_count": alternation(t, SECOND_PERSON),
        "punctuation_count": F.regexp_count(t, F.lit("[.,!?;:'\"-]")),
    })


def block_features(atoms: DataFrame, keys: list[str]) -> DataFrame:
    rows = atoms.withColumn("_w", word_count(F.col("text")))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("line_count"), F.avg("_w").alias("average_words_per_line"), (F.count(F.lit(1)) - F.countDistinct(F.lower("text"))).alias("repeated_line_count"))


def work_features(works: DataFrame, blocks: DataFrame, atoms: DataFrame) -> DataFrame:
    """works (work_id), blocks (work_id, type), atoms (work_id, text); works without atoms get zeros."""
    by_type = blocks.groupBy("work_id").agg(F.count(F.lit(1)).alias("block_count"), *[F.count_if(F.col("type") == k).alias(f"{k}_count") for k in ("chorus", "verse", "bridge")])
    f = atom_features(atoms.select("work_id", "text"))
    lines = F.greatest(F.lit(1), F.count(F.lit(1)))
    by_line = f.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.avg("word_count").alias("average_words_per_line"),
        (F.count_if("question_mark_present") / lines).alias("question_mark_density"),
        (F.sum("first_person_pronoun_count") / lines).alias("first_person_density"),
        (F.sum("second_person_pronoun_count") / lines).alias("second_person_density"),
    )
    return works.select("work_id").join(by_type, "work_id", "left").join(by_line, "work_id", "left").na.fill(0)
