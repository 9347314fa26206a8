"""License scan: fuzzy search for short notices, by exact seeds and bounded-error matching.

Words are runs of letters, digits and characters beyond ASCII, after A-Z is lower-cased; a text is its words joined
by single spaces. A notice with at most k errors is split into k + 1 pieces, of which an occurrence with no more
errors holds at least one exactly: places of the pieces are the candidates. In the window of each, the regex library's
bounded-error matching verifies every run of whole words of fitting length, counts its least edits and gives the span.
Words that tell notices apart (the licence's name, its version) must be exact. Occurrences without errors are the base
places, which all count. Of the others, those stay that overlap no exact one nor one that goes before: fewer edits,
then the earlier start, then the shorter span (ties can't remain).

NOTICES are those of the base and further ones (``base`` False), which add labels and places of their own.

Defined cases: a null or empty text has no words; rows that repeat get the same answer each; overlapping exact places
count each; an empty table gives an empty result; extra columns are ignored; null doc_ids stay null; a very long text
is searched whole, in time proportional to it and to its candidates.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


class Notice(NamedTuple):
    """errors: edits allowed, of characters, outside the exact words; a phrase has over 4 * errors + 2 characters."""

    phrase: str
    label: str
    exact: tuple[str, ...]
    errors: int
    base: bool = False


NOTICES = (
    Notice("under the mit license", "mit", ("mit",), 2, True),
    Notice("apache license version 2", "apache-2", ("2",), 2, True),
    Notice("cc by nc", "cc-by-nc", ("nc",), 1, True),
    Notice("gnu general public license version 2", "gpl-2", ("general", "2"), 3),
    Notice("gnu general public license version 3", "gpl-3", ("general", "3"), 3),
    Notice("gnu lesser general public license", "lgpl", ("lesser",), 3),
    Notice("gnu affero general public license", "agpl", ("affero",), 3),
    Notice("mozilla public license version 2", "mpl-2", ("mozilla", "2"), 3),
    Notice("under the bsd license", "bsd", ("bsd",), 2),
    Notice("bsd 2 clause license", "bsd-2", ("bsd", "2"), 2),
    Notice("bsd 3 clause license", "bsd-3", ("bsd", "3"), 2),
)


class Matcher:
    def __init__(self, notice: Notice):
        self.notice = notice
        n, k = len(notice.phrase), notice.errors
        if n <= 4 * k + 2:
            raise ValueError(f"{notice.phrase!r} is too short for {k} errors")
        at = [n * i // (k + 1) for i in range(k + 2)]
        self.seeds = [(notice.phrase[a:b], a) for a, b in zip(at, at[1:])]
        runs: list[tuple[bool, str]] = []
        for i, w in enumerate(notice.phrase.split(" ")):
            fixed, w = w in notice.exact, w if not i else " " + w
            if fixed and i:
                runs = runs[:-1] + [(False, runs[-1][1] + " ")]
                w = w[1:]
            if runs and runs[-1][0] == fixed:
                runs[-1] = (fixed, runs[-1][1] + w)
            else:
                runs.append((fixed, w))
        # the whole within k errors, and each part between exact words within as many
        body = "".join(f"(?<![^ ]){regex.escape(x)}(?![^ ])" if fixed else f"(?:{regex.escape(x)}){{e<={k}}}" for fixed, x in runs)
        self.pattern = regex.compile(f"(?b){body}")
        self.needs = [f" {w} " for w in notice.exact]

    def base(self, text: str) -> list[int]:
        found, p = [], f" {self.notice.phrase} "
        at = text.find(p)
        while at >= 0:
            found.append(at + 1)
            at = text.find(p, at + 1)
        return found

    def candidates(self, text: str):
        """Windows (start, end) around the seeds' places, by start."""
        n, k = len(self.notice.phrase), self.notice.errors
        for seed, off in self.seeds:
            at = text.find(seed)
            while at >= 0:
                yield max(0, at - off - k - 1), min(len(text), at - off + n + k + 1)
                at = text.find(seed, at + 1)

    def spans(self, text: str) -> set[tuple[int, int, int]]:
        """(edits, start, length) of all runs of whole words with at most k errors; text begins and ends with a space."""
        n, k = len(self.notice.phrase), self.notice.errors
        if not all(w in text for w in self.needs):
            return set()
        out: set[tuple[int, int, int]] = set()
        for a, z in set(self.candidates(text)):
            part = text[a:z]
            if not all(w in part for w in self.needs):
                continue
            cuts = [i for i in range(len(part)) if part[i] == " "]
            for i in cuts:
                if i + 1 > 2 * k + 2:  # an occurrence starts within k characters of where the seed puts it
                    break
                for j in cuts:
                    if abs(j - i - 1 - n) <= k and (m := self.pattern.fullmatch(part, i + 1, j)) and sum(m.fuzzy_counts) <= k:
                        out.add((sum(m.fuzzy_counts), a + i + 1, j - i - 1))
        return out

    def near(self, text: str, exact: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of occurrences with errors, apart from each other and from exact ones."""
        n = len(self.notice.phrase)
        out, taken = [], [(at, at + n) for at in exact]
        for edits, start, length in sorted(x for x in self.spans(text) if x[0]):
            end = start + length
            # no place is longer than n + errors: only those that start so near can overlap
            near = taken[bisect.bisect_left(taken, (start - n - self.notice.errors, 0)) : bisect.bisect_left(taken, (end, 0))]
            if all(z <= start for _, z in near):
                bisect.insort(taken, (start, end))
                out.append((start, end, edits))
        return out


def scan(text: str | None, matchers: list[Matcher]) -> tuple[int, list[tuple[str, int, int, int, str, bool]]]:
    """(number of words, [(label, first word, words, edits, span, whether a base notice)])."""
    words = BREAK.sub(" ", (text or "").translate(LOWER)).strip(" ")
    joined = f" {words} " if words else " "
    found = []
    for m in matchers:
        exact = m.base(joined)
        found += [(a, a + len(m.notice.phrase), 0, m.notice) for a in exact]
        found += [(*x, m.notice) for x in m.near(joined, exact)]
    out, at, word = [], 0, -1
    for a, z, edits, notice in sorted(found, key=lambda f: (f[0], f[3].label, f[2])):
        word += joined.count(" ", at, a)
        at = a
        out.append((notice.label, word, joined.count(" ", a, z) + 1, edits, joined[a:z], notice.base))
    return joined.count(" ") - 1, out


SCHEMA = "doc_id long, n_words long, places array<struct<label:string,word:long,words:long,edits:long,span:string,base:boolean,likeness:double>>"


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, places) for each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    size = {n.label: len(n.phrase) for n in notices}

    def run(batches):
        matchers = [Matcher(n) for n in notices]
        for pdf in batches:
            got = [scan(t, matchers) for t in pdf.text]
            places = [[(*f, max(0.0, 1 - f[3] / size[f[0]])) for f in x] for _, x in got]
            names = ("label", "word", "words", "edits", "span", "base", "likeness")
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n_words": [n for n, _ in got], "places": [[dict(zip(names, f)) for f in x] for x in places]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op8 over all documents."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("places", lambda p: p.base & (p.edits == 0))
    starts, best = F.transform(base, lambda p: p.word), F.transform("places", lambda p: p.likeness)
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p.label))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(best), F.lit(0.0)).alias("score"), "places")
