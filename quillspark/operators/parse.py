"""Works, blocks and atoms from text files: one plan of built-in functions, a shuffle by work only for atoms' places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import create_id, generic_label, lines, section_label, trim
from ..functions.vector import let

HEADER = r"^\s*\[([^\]]+)\]\s*$"


def parse_works(files: DataFrame, domain: str = "lyrics") -> DataFrame:
    """files (path, value, set) to works: chunks between ---- lines, numbered after blank ones are dropped."""
    chunks = F.filter(F.transform(F.split("value", r"\n\s*----\s*\n"), trim), lambda x: x != "")
    rows = files.select("path", "set", F.posexplode(chunks).alias("chunk_index", "chunk"))
    ls = F.split("chunk", r"\r?\n")
    rows = rows.withColumn("_l", ls).withColumn("_t", F.transform("_l", trim))
    rows = rows.withColumn("_ti", F.expr("array_position(transform(_t, x -> x rlike '(?i)^title[ \\t]*:'), true)"))
    rows = rows.withColumn("_si", F.expr("array_position(transform(_t, x -> x rlike '(?i)^synthetic-control-type[ \\t]*:'), true)"))
    parent = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit("."))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    given = trim(F.expr("regexp_replace(element_at(_l, greatest(cast(_ti as int), 1)), '(?i)^title[ \\t]*:', '')"))
    rest = trim(F.array_join(F.expr("filter(_l, (x, i) -> i + 1 <> _ti and i + 1 <> _si)"), "\n"))
    title = F.when(F.col("_ti") > 0, F.when(given != "", given).otherwise(F.concat(parent, F.lit(" "), (F.col("chunk_index") + 1).cast("string"))))
    title = F.coalesce(title, F.when(parent.isin(".", ""), stem).otherwise(parent))
    text = F.when(F.col("_ti") > 0, rest).otherwise(trim(F.col("chunk")))
    control = F.nullif(trim(F.regexp_extract("chunk", r"(?im)^synthetic-control-type\s*:\s*(.+)$", 1)), F.lit(""))
    rows = rows.select("path", "set", "chunk_index", title.alias("title"), text.alias("text"), control.alias("synthetic_control_type"))
    work = create_id("work", F.concat_ws("", F.col("path"), F.lit("#"), F.col("chunk_index").cast("string"), F.lit(":"), F.col("title")))
    return rows.select(work.alias("id"), F.lit(domain).alias("domain"), "set", "title", F.col("path").alias("source_path"), "text", F.struct("chunk_index", "synthetic_control_type").alias("metadata"))


def parse_blocks(works: DataFrame, key: str = "id", text: str = "text", domain: str = "lyrics") -> DataFrame:
    """(work, block_index, type, lines) of works: sections under [headers], else paragraphs. A work is cut up in its row."""
    label = section_label if domain == "lyrics" else generic_label
    full = lambda ls: F.filter(F.transform(ls, trim), lambda x: x != "")
    block = lambda kind, ls: F.struct(kind.alias("type"), ls.alias("lines"))

    def sections(ls: Column, heads: Column) -> Column:
        """What stands before the first header and between one and the next."""
        at = F.filter(F.transform(heads, lambda h, i: F.when(h != "", i)), lambda i: i.isNotNull())
        ends = F.concat(at, F.array(F.size(ls)))
        part = lambda a, e: block(F.coalesce(label(F.when(a >= 0, F.get(heads, a))), F.lit("section")), full(F.slice(ls, a + 2, e - a - 1)))
        return F.zip_with(F.concat(F.array(F.lit(-1)), at), ends, part)

    by_line = F.split("_text", r"\r?\n")
    headed = let(by_line, lambda ls: let(F.transform(ls, lambda x: F.regexp_extract(x, HEADER, 1)), lambda heads: sections(ls, heads)))
    plain = F.transform(F.split("_text", r"\n\s*\n"), lambda p: block(F.lit("section"), lines(p)))
    blocks = F.when(F.exists(by_line, lambda x: x.rlike(HEADER)), headed).otherwise(plain)
    rows = works.select(F.col(key).alias("work_id"), F.col(text).alias("_text"))
    rows = rows.select("work_id", F.posexplode(F.filter(blocks, lambda b: F.size(b["lines"]) > 0)).alias("block_index", "_b"))
    return rows.select("work_id", "block_index", "_b.type", "_b.lines")


def blocks_and_atoms(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with ids and their atoms with places in block and work."""
    text = F.array_join("lines", "\n")
    blocks = parsed.withColumn("text", text).withColumn("id", create_id("block", F.col("work_id"), F.col("block_index"), F.col("type"), F.col("text")))
    before = F.sum(F.size("lines")).over(Window.partitionBy("work_id").orderBy("block_index")) - F.size("lines")
    atoms = blocks.withColumn("_before", before).select("work_id", F.col("id").alias("block_id"), "_before", F.posexplode("lines").alias("index_in_block", "text"))
    atoms = atoms.select(create_id("atom", F.col("block_id"), F.col("index_in_block"), F.col("text")).alias("id"), "work_id", "block_id", (F.col("_before") + F.col("index_in_block")).alias("index_in_work"), "index_in_block", "text")
    return blocks.select("id", "work_id", "type", F.col("block_index").alias("index"), "text"), atoms


def extra_scopes(works: DataFrame, blocks: DataFrame) -> DataFrame:
    """Further texts of a lyrics work: title with choruses (under two names) and bridges."""
    joined = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.struct("index", "text")))), lambda x: x.text), "\n")
    parts = blocks.groupBy("work_id").agg(joined("chorus").alias("choruses"), joined("bridge").alias("bridges"))
    rows = works.select(F.col("id").alias("work_id"), "title").join(parts, "work_id", "left")
    chorus = F.concat("title", F.lit("\n"), F.nullif("choruses", F.lit("")))  # null without choruses
    scopes = F.array(F.struct(F.lit("all_choruses").alias("scope"), chorus.alias("text")), F.struct(F.lit("bridge_only").alias("scope"), F.coalesce("bridges", F.lit("")).alias("text")), F.struct(F.lit("title_plus_chorus").alias("scope"), chorus.alias("text")))
    return rows.select("work_id", F.inline(scopes)).where("text <> ''")
