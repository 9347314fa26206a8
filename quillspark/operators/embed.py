"""Embeddings: the deterministic hash embedding, and a plug for other providers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DIMENSIONS
from ..functions.text import content_hash, create_id
from ..functions.vector import normalize
from .topics import FIELDS, topic_text


#: Characters whose 3-grams are looked up at once, and words that a worker remembers the hash of.
SLICE, KNOWN = 1 << 20, 1 << 19


def _hasher(width: int, slice_: int, known: int):
    """What a task does; all of it is sent along with the plan, so workers need nothing of this package."""
    word_of = re.compile("[A-Za-z0-9_]+(?:'+[A-Za-z0-9_]+)*")  # runs of word characters and apostrophes, from word character to word character

    class Places(dict):
        """Hashes as numbers: bucket, sign, and for words the length up to 12, which their weight goes by."""

        def __init__(self, place):
            super().__init__()
            self.place = place

        def __missing__(self, unit: str) -> int:
            if len(self) >= known:
                self.clear()
            self[unit] = at = self.place(unit)
            return at

    def of_word(w: str) -> int:
        d = hashlib.sha256(w.encode()).digest()
        return (d[0] % width * 2 + d[1] % 2) * 13 + min(len(w), 12)

    def of_gram(g: str) -> int:
        d = hashlib.sha1(g.encode()).digest()
        return d[0] % width * 2 + d[1] % 2

    words, grams = Places(of_word), Places(of_gram)
    sign = np.where(np.arange(width * 2) % 2 == 0, 1.0, -1.0)
    weight = (sign[:, None] * (1 + np.arange(13) / 12)[None, :]).ravel()

    def add_words(sums: np.ndarray, row: int, text: str) -> None:
        found = word_of.finditer(text)
        while some := [words[m.group()] for m in islice(found, slice_)]:
            at = np.array(some)
            sums[row] += np.bincount(at // 26, weight[at], width)

    def add_grams(sums: np.ndarray, first: int, texts: list[str]) -> None:
        """3-grams of texts, the rows from first on: characters are numbered, distinct grams hashed once."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        if len(points) < 3:
            return
        there = np.zeros(0x110000, dtype=bool)
        there[points] = True
        chars = np.flatnonzero(there)
        number = np.zeros(0x110000, dtype=np.int64)
        number[chars] = np.arange(len(chars))
        c, k = number[points], len(chars)
        codes = (c[:-2] * k + c[1:-1]) * k + c[2:]
        ends = np.cumsum([len(t) for t in texts])
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[:-2]
        inside = np.arange(len(codes)) + 3 <= ends[row]
        codes, row = codes[inside], row[inside]
        if k**3 <= 4 * len(codes) + 65_536:
            distinct = np.flatnonzero(np.bincount(codes, minlength=1))
            at = np.zeros(k**3, dtype=np.int64)
        else:
            distinct, codes = np.unique(codes, return_inverse=True)
            at = None
        places = np.array([grams[chr(chars[x // k // k]) + chr(chars[x // k % k]) + chr(chars[x % k])] for x in distinct.tolist()], dtype=np.int64)
        if at is None:
            at = places
        else:
            at[distinct] = places
        at = at[codes]
        counts = np.bincount(row * width + at // 2, sign[at], len(texts) * width)
        sums[first : first + len(texts)] += 0.15 * counts.reshape(len(texts), width)

    def vectors(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        sums, held, size = np.zeros((len(texts), width)), [], 0
        for i, t in enumerate(texts):
            add_words(sums, i, t)
            if len(t) > slice_:
                add_grams(sums, i - len(held), held)
                for s in range(0, len(t), slice_):
                    add_grams(sums, i, [t[s : s + slice_ + 2]])
                held, size = [], 0
                continue
            held.append(t)
            size += len(t)
            if size > slice_:
                add_grams(sums, i + 1 - len(held), held)
                held, size = [], 0
        add_grams(sums, len(texts) - len(held), held)
        return pd.Series(list(sums))

    return vectors


def hash_vector(text: Column) -> Column:
    """The text's words and character 3-grams, in lower case, hashed to DIMENSIONS buckets with signs and summed by weight
    (0.15 a 3-gram), normalised; zeros for a text without words or grams. Row by row: nothing is shuffled."""
    return normalize(F.pandas_udf(_hasher(DIMENSIONS, SLICE, KNOWN), "array<double>")(F.lower(F.coalesce(text, F.lit("")))))


def hash_embedding(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, vector) for each distinct key and text of df; a text without words or grams has the zero vector."""
    rows = df.select(F.col(key), F.xxhash64(text).alias("_h"), hash_vector(F.col(text)).alias("vector"))
    return rows.groupBy(key, "_h").agg(F.any_value("vector").alias("vector")).select(key, "vector")


PROVIDERS: dict[str, tuple[str, Callable[[DataFrame, str, str], DataFrame]]] = {"hash": ("local-hash-embedding-v1", hash_embedding)}


def register_provider(name: str, model: str, embed: Callable[[DataFrame, str, str], DataFrame]) -> None:
    """Add a provider: a function of (rows, key, text) that returns (key, vector), say by mapInPandas."""
    PROVIDERS[name] = (model, embed)


def embedding_inputs(works: DataFrame, blocks: DataFrame, atoms: DataFrame, topics: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(owner_type, owner_id, scope, text): all texts to embed."""
    part = lambda df, kind, owner, scope, text: df.select(F.lit(kind).alias("owner_type"), owner.alias("owner_id"), scope.alias("scope"), text.alias("text"))
    out = part(works, "work", F.col("id"), F.lit("work"), F.concat_ws("\n", "title", "text"))
    out = out.unionByName(part(blocks, "block", F.col("id"), F.lit("block"), F.col("text"))).unionByName(part(atoms, "atom", F.col("id"), F.lit("atom"), F.col("text")))
    fields = F.array(*[F.struct(F.lit(n).alias("scope"), F.col(n).alias("text")) for n in FIELDS], F.struct(F.lit("combined_topic_profile").alias("scope"), topic_text().alias("text")))
    rows = topics.select("work_id", F.inline(fields))
    out = out.unionByName(part(rows, "topic", F.col("work_id"), F.col("scope"), F.col("text")))
    return out if scopes is None else out.unionByName(part(scopes, "work", F.col("work_id"), F.col("scope"), F.col("text")))


def embed(inputs: DataFrame, provider: str = "hash", cached: DataFrame | None = None) -> DataFrame:
    """Embedding records of inputs; with a cached table, only texts whose hash isn't in it are embedded."""
    model, run = PROVIDERS[provider]
    keys = [F.lit(model), F.col("owner_type"), F.col("owner_id"), F.col("scope")]
    rows = inputs.withColumns({"id": create_id("emb", *keys, F.sha2("text", 256)), "model": F.lit(model), "text_hash": content_hash(*keys, F.col("text"))})
    new = rows if cached is None else rows.join(cached.select("text_hash"), "text_hash", "left_anti")
    # the hash embedding is a column; what other providers give is joined by id
    made = new.withColumn("vector", hash_vector(F.col("text"))) if run is hash_embedding else new.join(run(new, "id", "text"), "id")
    done = made.select("id", "owner_type", "owner_id", "scope", "model", "text_hash", "vector")
    return done if cached is None else done.unionByName(cached.join(rows.select("text_hash"), "text_hash", "left_semi").select(*done.columns))
