"""Language identification by language-bitmask n-gram filters.

Training counts character n-grams (3 and 4, with word borders) of labelled documents for each language, and takes a
language's most frequent ones, unless another language uses an n-gram many times as often. They go into one
bit-sliced Bloom filter: each of its positions holds a bit for every language, and the words at an n-gram's
positions, and-ed, are the set of all languages that contain it. A text's n-grams give a popcount for each language;
the hits to be expected from false positives, by the share of positions that a language has set, are taken off; the
largest count decides.

The classifier is fitted on a sample of some ``docs_per_lang`` labelled documents of each language (whole texts,
chosen by hash of doc_id); languages with fewer use all. Predictions read text only.

A language's n-grams are cut off at ``grams_per_lang``, the model's size (held-out accuracy on sf0.1: see the README).

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; a null lang isn't
learned from; texts whose n-grams are all unknown get the language with most labelled documents and score 0; with
nothing to learn from, all are ``und``; equal counts go to the first language by name; rows that repeat get the same
answer; an empty table gives an empty result; extra columns are ignored and stay, but for a lang_pred, score or known,
which predictions replaces; a document with null doc_id is not held out, and not learned from; a very long text is read
whole, a million characters at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, pieces, prepare

WORD = re.compile(r"[^\W\d_]+")  # letters, and numerals that aren't digits
BORDER = re.compile(r"[\W\d_]")
LETTERS = regex.compile(r"\p{L}+")
SIZES = (3, 4)
DOCS_PER_LANG, GRAMS_PER_LANG = 3000, 20_000
#: The pipeline's stage asks that the language predicted knows so many of a text's n-grams.
LEAST_KNOWN = 0.5
#: An n-gram that another language uses so many times as often isn't taken for a language.
RATIO = 20.0
BITS, PROBES = 20, 4
SLICE = 1 << 20
#: A task of the training counts so many n-grams, or a SLICE more, before it passes them on.
HELD = 1 << 20


def words(text: str) -> list[str]:
    """The runs of letters of a text."""
    found = WORD.findall(text)
    return found if "".join(found).isalpha() else LETTERS.findall(text)


def hashes(text: str | None):
    """Hashes of all n-grams of a text's words, SLICE of them at a time at most."""
    tail = " "
    for piece in pieces((text or "").lower(), BORDER):
        if not (found := words(piece)):
            continue
        codes = np.frombuffer(f"{tail}{' '.join(found)} ".encode("utf-32-le", "surrogatepass"), "<u4")
        for n in SIZES:
            # those that end in this piece
            for at in range(max(0, len(tail) - n + 1), len(codes) - n + 1, SLICE):
                x = codes[at : at + SLICE + n - 1].astype(np.uint64)
                h = np.full(len(x) - n + 1, n, np.uint64)
                for i in range(n):
                    h = (h ^ x[i : len(x) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                yield h
        tail = codes[-(max(SIZES) - 1) :].tobytes().decode("utf-32-le", "surrogatepass")


def grams(text: str | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *hashes(text)])


def _positions(h: np.ndarray, i: int) -> np.ndarray:
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a + np.uint64(i) * b) & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Filters:
    """The bit-sliced filter; languages beyond 64 take further words of each position."""

    def __init__(self, langs: list[str], prior: str | None, tables: dict[str, np.ndarray]):
        self.langs, self.prior = langs, prior
        self.slots = np.zeros((max(1, -(-len(langs) // 64)), 1 << BITS), np.uint64)
        for k, lang in enumerate(langs):
            for i in range(PROBES):
                at = _positions(tables[lang], i)
                self.slots[k // 64, at] |= np.uint64(1 << (k % 64))
        fill = [float(((self.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(langs))]
        self.false = np.array(fill) ** PROBES

    def hits(self, h: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter holds."""
        out = np.zeros(len(self.langs))
        for at in range(0, len(h), SLICE):
            part = h[at : at + SLICE]
            for w, slots in enumerate(self.slots):
                mask = slots[_positions(part, 0)]
                for i in range(1, PROBES):
                    mask = mask & slots[_positions(part, i)]
                for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                    out[k] += np.count_nonzero(mask & np.uint64(1 << (k % 64)))
        return out

    def corrected(self, hits: np.ndarray, n: int) -> np.ndarray:
        """Hits among n n-grams less those to be expected from false positives."""
        return (hits - n * self.false) / (1 - self.false)

    def counts(self, h: np.ndarray) -> np.ndarray:
        return self.corrected(self.hits(h), len(h))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, share of the n-grams that it knows)."""
        n, c = 0, np.zeros(len(self.langs))
        for h in hashes(text):
            n += len(h)
            c += self.hits(h)
        if not n or not self.langs:
            return "und", 0.0, 0.0
        c = np.maximum(self.corrected(c, n), 0)
        best = int(c.argmax())
        if c[best] <= 0:
            return self.prior, 0.0, 0.0
        second = np.delete(c, best).max() if len(c) > 1 else 0.0
        return self.langs[best], float(c[best] / (c[best] + second)), float(min(1.0, c[best] / n))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def count_grams(batches):
    """Rows (lang, gram, n) of batches (lang, text). Some HELD n-grams are held at a time, so one may have several rows."""
    for pdf in batches:
        for lang, texts in pdf.groupby("lang").text:
            held, size = [], 0
            for h in (h for t in texts for h in hashes(t)):
                held.append(h)
                size += len(h)
                if size >= HELD:
                    yield _counts(lang, held)
                    held, size = [], 0
            if held:
                yield _counts(lang, held)


def _counts(lang: str, held: list[np.ndarray]) -> pd.DataFrame:
    h, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n})


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, grams_per_lang: int = GRAMS_PER_LANG) -> Filters:
    """Filters from docs (doc_id, text, lang) that aren't held out. The driver gets grams_per_lang rows a language."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    labelled = rows.groupBy("lang").count()
    numbers = sorted(((r.lang, r["count"]) for r in labelled.collect()), key=lambda x: (-x[1], x[0]))
    if not numbers:
        return Filters([], None, {})
    share = F.create_map(*[x for lang, n in numbers for x in (F.lit(lang), F.lit(min(1.0, docs_per_lang / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    sample = rows.where(draw < F.element_at(share, F.col("lang")))

    counted = sample.select("lang", "text").mapInPandas(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("r", order).where(F.col("r") <= grams_per_lang).select("lang", "gram", (F.col("n") / F.col("all")).alias("p")).toPandas()
    most = top.groupby("gram").p.transform("max")
    top = top[top.p * RATIO >= most]
    langs = sorted(x for x, _ in numbers)
    return Filters(langs, numbers[0][0], {x: top.gram[top.lang == x].to_numpy(np.int64).view(np.uint64) for x in langs})


def predictor(spark, filters: Filters):
    """A Column function: text to struct (lang_pred, score, known)."""
    sent = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double, known double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score", "known"])

    return predict


def predictions(docs: DataFrame, **bounds) -> DataFrame:
    """docs with lang_pred, score and known added, learned from its own labelled rows that aren't held out."""
    spark = prepare(docs.sparkSession)
    guess = predictor(spark, train(docs, **bounds))
    docs = docs.drop("lang_pred", "score", "known")
    (g,) = fresh(docs, "_g")
    return docs.withColumn(g, guess("text")).select(*columns(docs), *[F.col(g)[c].alias(c) for c in ("lang_pred", "score", "known")])


def query(spark, sf_dir: str) -> DataFrame:
    """op10 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predictions(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keeps(guess: F.Column, label: F.Column, languages: tuple[str, ...] | None = None, least_known: float = LEAST_KNOWN) -> F.Column:
    """Whether a document stays: its text has letters, the language predicted is one of ``languages`` (None: any that
    was learned) and knows at least ``least_known`` of its n-grams, and a label, if there is one, names the same."""
    wanted = guess["lang_pred"].isin(*languages) if languages is not None else F.lit(True)
    return (guess["lang_pred"] != "und") & wanted & (guess["known"] >= least_known) & F.coalesce(label == guess["lang_pred"], F.lit(True))


def stage(spark, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = None, least_known: float = LEAST_KNOWN) -> DataFrame:
    """Pipeline stage: documents go whose text has no letter, is in none of the languages (by ``keeps``), or is in
    another one than their label says. With nothing labelled there is no language to tell: all of them go."""
    guess = predictor(prepare(spark), train(docs))
    (g,) = fresh(docs, "_g")
    return docs.withColumn(g, guess("text")).where(keeps(F.col(g), F.col("lang"), languages, least_known)).select(*columns(docs))
