"""Reports: small tables (at most a row for each model, gate or split) as Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cell(x) -> str:
    """A value in a Markdown table."""
    text = f"{x:.6f}" if isinstance(x, float) else "" if x is None else str(x)
    return text.replace("|", "\\|").replace("\n", " ")


def markdown(title: str, df: DataFrame, most: int = 50) -> str:
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]) + "\n"


def write_one(spark: SparkSession, folder: str, name: str, title: str, df: DataFrame) -> None:
    spark.createDataFrame([(markdown(title, df),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.md")
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")


TITLES = {
    "models": "Models compared on validation",
    "selected": "Selected model",
    "summary": "Works by set and split",
    "held_out": "Held-out evaluation",
    "gates": "Hard-negative gates",
    "assessment": "Residual against raw models",
    "acceptance": "Acceptance",
    "confident": "Most confident works",
    "limitations": "Limitations",
    "failures": "What was missed",
    "hard_negative_report": "Hard-negative selection",
}


def write(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
    """Training, evaluation, gate, failure, mining and candidate reports: they land wherever the other tables do."""
    for name, title in TITLES.items():
        if name in tables:
            write_one(spark, folder, name, title, flat(tables[name]))
    if "candidates" in tables:
        write_candidates(spark, folder, tables["candidates"], tables["candidate_sections"])


def flat(df: DataFrame) -> DataFrame:
    """Lists of texts as one text."""
    return df.select(*[F.concat_ws("; ", c).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


def write_candidates(spark: SparkSession, folder: str, scored: DataFrame, sections: DataFrame) -> None:
    """All candidates as JSON lines with their sections, and Markdown on the best of them."""
    parts = sections.groupBy(F.col("work_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("type", "target_similarity", "background_similarity", "style_margin"))).alias("section_scores"))
    scored.join(parts, "id", "left").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/candidates.json")
    order = [F.desc("score"), "id"]
    cols = ["title", "model", "score", "threshold", "target_style", "overall_style_score", "overfit_risk", "line_matches", "phrase_matches", "long_run", "warnings"]
    text = markdown("Candidates", flat(scored.orderBy(*order).select(*cols))) + "\nScores are diagnostics, neither probabilities nor measures of quality.\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/candidates.md")
