"""Text functions, Column to Column: trimming, tokens, ids, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SEPARATOR

#: White space as the reference's language has it (Java's \\s is ASCII only).
SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A word border between ASCII word characters and others (Java's \\b is Unicode-aware).
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


#: The characters of SPACE.
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(BORDER + r"[A-Za-z0-9_']+" + BORDER), F.lit(0))


def word_count(c: Column) -> Column:
    """How many words there are: they reach from word character to word character, so no borders need be tested."""
    return F.regexp_count(c, F.lit("[A-Za-z0-9_]+(?:'+[A-Za-z0-9_]+)*"))


def topic_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(BORDER + r"[a-z']{4,}" + BORDER), F.lit(0))


def leak_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))


def alternation(c: Column, listed: list[str]) -> Column:
    """How often a text holds one of the words listed, in any case. They begin and end with ASCII word characters."""
    return F.regexp_count(c, F.lit(f"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(listed)})(?![A-Za-z0-9_])"))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)


def create_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(content_hash(*parts), 1, 16))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_]+", "-"), r"^-|-$", "")


def lines(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(c, r"\r?\n"), trim), lambda x: x != "")


def leak_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: ~x.rlike(r"^\[[^\]]+\]$"))


def section_label(label: Column) -> Column:
    """Label of a lyrics section; the order of tests is part of the result."""
    name = F.regexp_replace(F.regexp_replace(F.lower(label), r"\d+", ""), "^final ", "")
    name = trim(name)
    out = F.when(name.contains("chorus"), "chorus")
    for x in ("verse", "bridge", "intro", "outro", "refrain"):
        out = out.when(name.contains(x), x)
    return out.when(name == "", "section").otherwise(F.regexp_replace(name, r"\s+", "-"))


def generic_label(label: Column) -> Column:
    name = trim(F.regexp_replace(F.lower(label), r"\d+", ""))
    name = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]+", "-"), "^-|-$", "")
    return F.when(name == "", "section").otherwise(name)
