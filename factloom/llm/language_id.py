"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a generator seeded by its code point, so all machines agree.
A letter trigram abc is bound into one vector: a's turned by two places, times b's turned by one, times c's. A
document's profile bundles (adds) its trigrams' vectors by their counts; a language's prototype bundles its training
documents, each with the same weight. The language whose prototype has the largest cosine with the profile wins.

What training sends is one vector for each task and language. Letters are lower-cased; anything between words is one
blank, which counts as a letter. Prototypes stay in a table; BLOCK_LANGUAGES of them at a time go to every task, and where
there are more languages, the documents pass by one block after another with the best language so far. Long texts are
read whole, PART characters at a time.

Edge cases: texts that are null or have no letter are `und` with score 0, and so is everything if there is nothing to
learn from; training rows with a null language or without letters are passed over; of equal cosines the first language
in alphabetical order wins. Ids, languages and sources are never looked at in a prediction. Repeated rows and null ids
stay; an empty table gives no rows. Kept columns may have any names but lang_pred and score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map, cut, remainder, schema_with, session, table

DIMENSIONS = 1024
SEED = 11
#: Trigrams whose vectors a task keeps; beyond it, it starts anew.
KEPT_TRIGRAMS = 40_000
#: Prototypes that go to a task at a time: 4 KB each.
BLOCK_LANGUAGES = 4096
#: Characters whose trigrams are counted at a time.
PART = 1 << 20
#: The pipeline rejects documents without a language, and those whose letters look like none that was learned: whose score
#: is within five standard deviations of what unrelated vectors have, and most of whose letters no language uses. A short
#: text of a learned language may score as low, but has its letters.
LEAST_SCORE = 5 / DIMENSIONS**0.5
#: A language uses the letters that stand in one of so many of its training documents at least.
RARE_LETTER = 100
UNKNOWN = "und"


class Profiles:
    """Trigram counts and vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, dimensions), np.int8)
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[code]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams and how often each stands in the text; None without letters."""
        if not text:
            return None
        low = text.lower()
        before, any_letter, found = np.array([32], np.int64), False, []
        for at in range(0, len(low), PART):
            last = at + PART >= len(low)
            codes = np.frombuffer(low[at : at + PART].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            known = self.is_letter[codes]
            any_letter = any_letter or bool(known.any())
            codes = np.concatenate((before, np.where(known, codes, 32), np.array([32] * last, np.int64)))
            codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
            found.append(np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True))
            before = codes[-2:]
        if not any_letter:
            return None
        if len(found) == 1:
            return found[0]
        keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64)

    def place(self, trigrams: list[int]) -> list[int]:
        """Rows of the trigrams' vectors."""
        if len(self.rows) + len(trigrams) > max(KEPT_TRIGRAMS, len(trigrams)):
            self.rows.clear()
        rows = list(map(self.rows.get, trigrams))
        if None in rows:
            for k, (row, key) in enumerate(zip(rows, trigrams, strict=True)):
                if row is None:
                    rows[k] = row = self.rows[key] = len(self.rows)
                    if row >= len(self.vectors):
                        self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
                    a, b, c = (self.letter((key >> s) & 0x1FFFFF) for s in (42, 21, 0))
                    self.vectors[row] = np.roll(a, 2) * np.roll(b, 1) * c
        return rows

    def bundle(self, trigrams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(trigrams), 8192):
            rows = self.place(trigrams[at : at + 8192].tolist())
            out += weights[at : at + 8192].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(lang, v): the prototype of each language of docs, of unit length."""
    source = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches):
        profiles = Profiles(dimensions, seed)
        sums: dict[str, dict[int, float]] = {}

        def out():
            rows = []
            for name, weights in sums.items():
                vector = profiles.bundle(np.fromiter(weights, np.int64, len(weights)), np.fromiter(weights.values(), np.float64, len(weights)))
                rows.append((name, vector.astype(np.float64).tolist()))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["lang", "v"])

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := profiles.counts(body)) is None:
                    continue
                own = sums.setdefault(name, {})
                norm = float(np.sqrt((found[1].astype(np.float64) ** 2).sum()))
                for key, n in zip(found[0].tolist(), found[1].tolist(), strict=True):
                    own[key] = own.get(key, 0.0) + n / norm
                if sum(map(len, sums.values())) > 500_000:
                    yield out()
        if sums:
            yield out()

    session(docs.sparkSession)
    parts = source.mapInArrow(run, "lang string, v array<double>")
    added = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    whole = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda n, x: n + x * x))
    return cut(whole.withColumn("__n", length).where(F.col("__n") > 0).select("lang", F.transform("v", lambda x: x / F.col("__n")).alias("v")))


def predict(docs: DataFrame, keep: list[str], prototypes: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED, block: int = BLOCK_LANGUAGES) -> DataFrame:
    """The kept columns, lang_pred and score (the cosine, 0 where it is negative)."""
    spark = session(docs.sparkSession)
    out = docs.select(*keep, F.col(text).alias("__text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    n = len(keep)
    edge, blocks = None, -(-prototypes.count() // block) or 1
    for nth in range(blocks):
        left = prototypes if edge is None else prototypes.where(F.col("lang") > edge)
        rows = left.orderBy("lang").limit(block).collect()  # at most `block` of them
        names = [r["lang"] for r in rows]
        edge = names[-1] if names else None
        shared = spark.sparkContext.broadcast((names, np.array([r["v"] for r in rows], np.float32).reshape(len(rows), dimensions)))

        def make(shared=shared):
            profiles, (names, matrix) = Profiles(dimensions, seed), shared.value

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                said, scores = [], []
                for body, name, score in zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True):
                    found = profiles.counts(body) if names else None
                    if found is not None:
                        profile = profiles.bundle(*found)
                        cosines = matrix @ profile / max(float(np.linalg.norm(profile)), 1e-9)
                        best = int(np.argmax(cosines))
                        if name == UNKNOWN or cosines[best] > score:
                            name, score = names[best], min(1.0, max(0.0, float(cosines[best])))
                    said.append(name)
                    scores.append(score)
                return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n + 1)), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "__text", "lang_pred", "score"])

            return step

        out = arrow_map(out, make, schema_with(out, [*keep, "__text"], "lang_pred string, score double"))
        if nth + 1 < blocks:
            out = cut(out)
    return out.select(*keep, "lang_pred", "score")


def letters(docs: DataFrame, text: str = "text", lang: str = "lang") -> str:
    """The letters, lower-cased, that the languages of docs use: no more than there are code points."""
    source = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches):
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own := [c for c in set(body.lower()) if c.isalpha()]:
                    seen.update((name, c) for c in ["", *own])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "c", "n"])

    counts = cut(source.mapInArrow(run, "lang string, c string, n long").groupBy("lang", "c").agg(F.sum("n").alias("n")))
    texts = counts.where("c = ''").select("lang", F.col("n").alias("texts"))
    used = counts.where("c <> ''").join(texts, "lang").where(F.col("n") * RARE_LETTER >= F.col("texts")).select("c").distinct()
    return "".join(sorted(r["c"] for r in used.collect()))


def like_learned(score: Column, text: Column, known: str) -> Column:
    """Whether a text with this score is like a learned language, of which `known` are the letters."""
    own = F.regexp_replace(F.lower(text), r"\P{L}+", "")
    strange = F.length(F.translate(own, known, "")) if known else F.length(own)
    return F.when(score >= LEAST_SCORE, True).otherwise(2 * strange <= F.length(own))


def training(docs: DataFrame, doc_id: Column | None = None) -> DataFrame:
    """The documents that aren't held out."""
    return docs.where(remainder(F.col("doc_id") if doc_id is None else doc_id, 4) != 2)


def learned(docs: DataFrame, doc_id: Column | None = None) -> DataFrame:
    """Prototypes from the documents that aren't held out."""
    return train(training(docs, doc_id))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = predict(docs, ["doc_id"], learned(docs))
    return said.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
