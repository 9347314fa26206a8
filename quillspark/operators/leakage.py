"""Lexical leakage of protected wording: equal lines, distinctive phrases, longest shared run of tokens."""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LEAK_STOPWORDS
from ..functions.text import leak_lines, leak_tokens

#: n-grams of targets that are sent to the tasks, 8 bytes each; candidates are joined with those of more targets.
LISTED = 1 << 21
#: Characters of texts whose n-grams are looked up at once, tokens of a longer text, and tokens that a worker remembers.
SLICE, TOKENS, KNOWN = 1 << 20, 1 << 18, 1 << 19


def _looked_up(least: int, most: int, by_line: bool, listed: np.ndarray | None, give: str, limits: tuple[int, int, int]):
    """What a task does with (key, text), texts in lower case: n-grams of least to most tokens (with by_line: within lines,
    with two distinctive tokens at least), those listed only, if there is a list. An n-gram is a hash of 64 bits.

    give: hashes (h), places (key, _i, _h), phrases (key, phrase), or longest (key, run). All of it is sent along with
    the plan, so workers need nothing of this package."""
    slice_, tokens_, known = limits
    stop, token_of = frozenset(LEAK_STOPWORDS), re.compile("[a-z0-9']+|\n" if by_line else "[a-z0-9']+")
    times, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    table, shift = None, np.uint64(0)
    if listed is not None:
        bits = min(25, max(16, (16 * len(listed)).bit_length()))
        table, shift = np.zeros(1 << bits, dtype=bool), np.uint64(64 - bits)
        table[(listed >> shift).astype(np.int64)] = True

    class Hashes(dict):
        """Tokens' hashes, the last bit of which says whether a token is distinctive; 0 for the end of a line."""

        def __missing__(self, token: str) -> int:
            if len(self) >= known:
                self.clear()
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little") | 1
            self[token] = h = 0 if token == "\n" else h if len(token) >= 4 and token not in stop else h - 1 or 2
            return h

    hashes = Hashes()

    def parts(texts: list[str]):
        """(rows, tokens, places, starts): tokens of some texts, or of a part of one, and how many of them begin n-grams."""
        rows, tokens, places = [], [], []
        for i, text in enumerate(texts):
            found = token_of.finditer(text)
            if len(text) > slice_:
                some, at = [m.group() for m in islice(found, tokens_ + most - 1)], 0
                while some:
                    more = [m.group() for m in islice(found, tokens_)]
                    starts = tokens_ if more else len(some)
                    yield np.full(len(some), i), some, np.arange(at, at + len(some)), starts
                    some, at = some[starts:] + more, at + starts
                continue
            some = token_of.findall(text)
            rows.append(np.full(len(some), i))
            places.append(np.arange(len(some)))
            tokens += some
            if len(tokens) >= tokens_:
                yield np.concatenate(rows), tokens, np.concatenate(places), len(tokens)
                rows, tokens, places = [], [], []
        if tokens:
            yield np.concatenate(rows), tokens, np.concatenate(places), len(tokens)

    def grams(rows: np.ndarray, tokens: list[str], starts: int):
        """(n, places among tokens, hashes) of the n-grams asked for, the longest last."""
        one = np.array([hashes[t] for t in tokens], dtype=np.uint64)
        group, marked = rows, np.zeros(len(one) + 1, dtype=np.int64)
        if by_line:
            group = rows * (len(one) + 1) + np.cumsum(one == 0)
            marked[1:] = np.cumsum(one & np.uint64(1))
        h = one
        for n in range(1, min(most, len(one)) + 1):
            if n > 1:
                h = h[:-1] * times + one[n - 1 :]
            if n < least:
                continue
            # a line's end begins its group, so it can only be an n-gram's first token
            ok = (group[: len(h)] == group[n - 1 :]) & (np.arange(len(h)) < starts)
            if by_line:
                ok &= (one[: len(h)] != 0) & (marked[n:] - marked[:-n] >= 2)
            at = np.flatnonzero(ok)
            v = (h[at] + np.uint64(n)) * odd
            v = (v ^ (v >> np.uint64(31))) * times
            v ^= v >> np.uint64(29)
            if listed is not None:
                some = np.flatnonzero(table[(v >> shift).astype(np.int64)])
                some = some[listed[np.minimum(np.searchsorted(listed, v[some]), len(listed) - 1)] == v[some]] if len(listed) else some[:0]
                at, v = at[some], v[some]
            yield n, at, v

    def plain(values) -> pd.Series:
        """Values as they are: strings in Arrow's chunks can't be sent back."""
        return pd.Series(values, dtype=object)

    def run(batches):
        for pdf in batches:
            key, best = pdf.iloc[:, 0].to_numpy(), np.zeros(len(pdf), dtype=np.int64)
            for rows, tokens, places, starts in parts(pdf.iloc[:, 1].tolist()):
                if give == "hashes":
                    yield pd.DataFrame({"h": np.unique(np.concatenate([np.zeros(0, np.uint64), *[v for _, _, v in grams(rows, tokens, starts)]])).view(np.int64)})
                elif give == "places":
                    for _, at, v in grams(rows, tokens, starts):
                        yield pd.DataFrame({"key": plain(key[rows[at]]), "_i": places[at].astype(np.int32), "_h": v.view(np.int64)})
                elif give == "phrases":
                    found = {(int(rows[i]), " ".join(tokens[i : i + n])) for n, at, _ in grams(rows, tokens, starts) for i in at.tolist()}
                    yield pd.DataFrame({"key": plain([key[i] for i, _ in found]), "phrase": plain([p for _, p in found])})
                else:
                    for n, at, _ in grams(rows, tokens, starts):
                        best[rows[at]] = np.maximum(best[rows[at]], n)
            if give == "longest":
                yield pd.DataFrame({"key": plain(key[best > 0]), "run": best[best > 0]})

    return run


def _apply(df: DataFrame, key: str, least: int, most: int, by_line: bool, listed: np.ndarray | None, give: str) -> DataFrame:
    whole = F.array_join(leak_lines(F.col("text")), "\n") if by_line else F.col("text")
    schema = {"hashes": "h long", "places": "key {0}, _i int, _h long", "phrases": "key {0}, phrase string", "longest": "key {0}, run long"}[give].format(dict(df.dtypes)[key])
    rows = df.where(F.col("text").isNotNull()).select(key, F.lower(whole).alias("text"))
    out = rows.mapInPandas(_looked_up(least, most, by_line, listed, give, (SLICE, TOKENS, KNOWN)), schema)
    return out.withColumnRenamed("key", key)


def _listed(targets: DataFrame, least: int, most: int, by_line: bool) -> np.ndarray | None:
    """The hashes of the targets' n-grams in order, None if they are over LISTED."""
    rows = _apply(targets, "target_id", least, most, by_line, None, "hashes").distinct().limit(LISTED + 1).toPandas()
    return np.sort(rows.h.to_numpy(dtype=np.int64).view(np.uint64)) if len(rows) <= LISTED else None


def _known_phrases(candidates: DataFrame, targets: DataFrame, least: int, most: int) -> DataFrame:
    """(id, phrase) of candidates, once each: those that targets have too (by hash) as long as these fit a list, else all."""
    listed = _listed(targets, least, most, True)
    return (_phrases(candidates, "id", least, most).select("id", "phrase") if listed is None else _apply(candidates, "id", least, most, True, listed, "phrases")).distinct()


def exact_lines(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, line, target_id, target_line) of candidates (id, text) and targets (target_id, text), first places only."""
    norm = lambda x: F.array_join(leak_tokens(x), " ")
    left = candidates.select("id", F.posexplode(leak_lines(F.col("text"))).alias("_o", "line")).withColumn("_n", norm(F.col("line"))).where("_n <> ''")
    left = left.groupBy("id", "_n").agg(F.min_by("line", "_o").alias("line"))
    right = targets.select("target_id", F.posexplode(leak_lines(F.col("text"))).alias("_o", "target_line")).withColumn("_n", norm(F.col("target_line"))).where("_n <> ''")
    right = right.groupBy("target_id", "_n").agg(F.min_by("target_line", "_o").alias("target_line"))
    return left.join(right, "_n").select("id", "line", "target_id", "target_line")


def _phrases(df: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """(key, line, line_no, phrase): n-grams within lines with two distinctive tokens."""
    rows = df.select(key, F.posexplode(leak_lines(F.col("text"))).alias("_o", "line")).withColumn("_t", leak_tokens(F.col("line")))
    rows = rows.withColumn("_k", F.transform("_t", lambda t: (~t.isin(LEAK_STOPWORDS) & (F.length(t) >= 4)).cast("int"))).where(f"size(_t) >= {least}")
    grams = F.expr(f"""flatten(transform(sequence({least}, least({most}, size(_t))), n -> filter(transform(sequence(1, size(_t) - n + 1),
        i -> if(aggregate(slice(_k, i, n), 0, (a, x) -> a + x) >= 2, array_join(slice(_t, i, n), ' '), null)), p -> p is not null)))""")
    return rows.select(key, "line", "_o", F.explode(grams).alias("phrase"))


def shared_phrases(candidates: DataFrame, targets: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """(id, phrase, target_id, target_line): distinctive phrases in common, once for each target line's wording."""
    left = _known_phrases(candidates, targets, least, most)
    right = _phrases(targets, "target_id", least, most).withColumn("_n", F.array_join(leak_tokens(F.col("line")), " "))
    right = right.groupBy("target_id", "phrase", "_n").agg(F.min_by("line", "_o").alias("target_line"))
    return left.join(right, "phrase").select("id", "phrase", "target_id", "target_line")


def _grams(df: DataFrame, key: str, n: int, at: str | None = None) -> DataFrame:
    """(key, h) for each n-gram of a text's tokens; with ``at``, its place."""
    t = df.select(key, leak_tokens(F.col("text")).alias("_t")).where(F.size("_t") >= n)
    hashes = F.expr(f"transform(sequence(1, size(_t) - {n - 1}), i -> xxhash64(array_join(slice(_t, i, {n}), ' ')))")
    return t.select(key, F.posexplode(hashes).alias(at, "_h") if at else F.explode(F.array_distinct(hashes)).alias("_h"))


def long_runs(candidates: DataFrame, targets: DataFrame, seed: int = 6) -> DataFrame:
    """(id, run): the longest run of tokens that a candidate shares with one target, for runs of ``seed`` at least.

    Seeds of that many tokens are joined; those of one diagonal that follow each other make an island, whose length
    is its seeds plus seed - 1. Of candidates' seeds only those of the targets are rows, as long as these fit a list."""
    listed = _listed(targets, seed, seed, False)
    if listed is None:
        pairs = _grams(candidates, "id", seed, "_i").join(_grams(targets, "target_id", seed, "_j"), "_h")
    else:
        pairs = _apply(candidates, "id", seed, seed, False, listed, "places").join(_apply(targets, "target_id", seed, seed, False, None, "places").withColumnRenamed("_i", "_j"), "_h")
    hits = pairs.select("id", "target_id", "_i", (F.col("_i") - F.col("_j")).alias("_d"))
    w = Window.partitionBy("id", "target_id", "_d").orderBy("_i")
    runs = hits.withColumn("_g", F.col("_i") - F.row_number().over(w)).groupBy("id", "target_id", "_d", "_g").agg((F.count(F.lit(1)) + seed - 1).alias("run"))
    return runs.groupBy("id").agg(F.max("run").alias("run"))


def longest_runs(candidates: DataFrame, targets: DataFrame, seed: int = 6) -> DataFrame:
    """(id, run) of all candidates: the longest run of tokens shared with one target, 0 if there is none.

    Runs of ``seed`` tokens or more are measured by long_runs. For shorter ones it is enough that some target has the
    n-gram: targets' distinct n-grams are looked up, so frequent tokens meet one row each and no pairs come of them."""
    listed = _listed(targets, 1, seed - 1, False) if seed > 1 else None
    short = None if listed is None else _apply(candidates, "id", 1, seed - 1, False, listed, "longest")
    for n in range(1, seed if listed is None else 1):
        found = _grams(candidates, "id", n).join(_grams(targets, "target_id", n).select("_h").distinct(), "_h", "left_semi").select("id", F.lit(n).cast("long").alias("run"))
        short = found if short is None else short.unionByName(found)
    every = candidates.select("id", F.lit(0).cast("long").alias("run")).unionByName(long_runs(candidates, targets, seed))
    every = every if short is None else every.unionByName(short)
    return every.groupBy("id").agg(F.max("run").alias("run"))


def line_counts(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, line_matches): how many rows exact_lines has for a candidate; targets are counted for each line first."""
    norm = lambda x: F.array_join(leak_tokens(x), " ")
    lined = lambda df, key: df.select(key, F.explode(leak_lines(F.col("text"))).alias("_l")).select(key, norm(F.col("_l")).alias("_n")).where("_n <> ''")
    known = lined(targets, "target_id").distinct().groupBy("_n").agg(F.count(F.lit(1)).alias("_c"))
    return lined(candidates, "id").join(known, "_n").distinct().groupBy("id").agg(F.sum("_c").alias("line_matches"))


def phrase_counts(candidates: DataFrame, targets: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """(id, phrase_matches): how many rows shared_phrases has for a candidate; targets' lines are counted first."""
    known = _phrases(targets, "target_id", least, most).select("target_id", "phrase", F.array_join(leak_tokens(F.col("line")), " ").alias("_n")).distinct()
    known = known.groupBy("phrase").agg(F.count(F.lit(1)).alias("_c"))
    return _known_phrases(candidates, targets, least, most).join(known, "phrase").groupBy("id").agg(F.sum("_c").alias("phrase_matches"))


def verdicts(candidates: DataFrame, targets: DataFrame, max_lines: int = 0, max_phrases: int = 0, max_run: int = 5, least: int = 2) -> DataFrame:
    """(id, line_matches, phrase_matches, long_run, passed); long_run is null if it is at most max_run."""
    rows = candidates.select("id").join(line_counts(candidates, targets), "id", "left").join(phrase_counts(candidates, targets, least), "id", "left")
    rows = rows.join(long_runs(candidates, targets, max_run + 1).withColumnRenamed("run", "long_run"), "id", "left").na.fill(0, ["line_matches", "phrase_matches"])
    return rows.withColumn("passed", passed(max_lines, max_phrases))


def passed(max_lines: int, max_phrases: int) -> Column:
    return (F.col("line_matches") <= max_lines) & (F.col("phrase_matches") <= max_phrases) & F.col("long_run").isNull()
