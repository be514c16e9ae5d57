"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding: lower case, homoglyphs of Latin letters to these letters, digits and signs that stand for letters to those
(signs only where a letter or digit follows: at a word's end they are punctuation).
Entries of the lexicon are words and word beginnings of STEMS letters; their weight is the smoothed log odds of
being in a document labelled toxic, learned from the labelled rows given. An entry stays if it is among the strongest
(within NEAR_BEST) of enough toxic documents, counted by the words around it: words that only go along with such
entries, or that only stand in copies of one text, are left out. Exception phrases are word pairs around an
entry that stand in clean documents at least as often as elsewhere; a match inside one doesn't count.

score: a logistic function, fitted on the same rows, of the weight found and of that weight per 100 words.

The fit uses at most MAX_LABELLED labelled rows (a sample by the ids' hash when there are more); each table it builds
is bounded by that number. These rows are written once, one for each distinct text (toxic if one of its rows is), so that
copies of a text count once wherever the fit counts, and all steps of the fit read that table. Entries need a share of MIN_SHARE of the toxic rows, so there are at most the mean number of
features of a document divided by MIN_SHARE. Every text is scored whole.

Edge cases: null and empty texts score as a text without entries; without any toxic label, all score 0; rows with a
null label are not learned from; an id labelled twice counts as toxic if one label says so. Repeated rows and null ids
stay; an empty table gives no rows, and one without labelled rows scores 0. Columns other than id, text and label are never
looked at, and columns that are kept may have any names but score and __entries.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map, remainder, schema_with, session, table, written

MAX_LABELLED = 200_000
MIN_SHARE = 0.002
MIN_DOCS = 4
NEAR_BEST = 2.0
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Lookalikes from other alphabets, then digits and signs used as letters.
HOMOGLYPHS = dict(zip("авеёкмнорстухіјѕԁԛԝһαβγεηικνορτυχ", "abeekmhopctyxijsdqwhabyenikvoptux", strict=True))
SUBSTITUTES = dict(zip("013457$@!|", "oieastsaii", strict=True))
_TABLE = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+")
_TRAILING = re.compile(r"[@$!|]++(?![^\W_])")


def folded_words(text: str | None) -> list[str]:
    """Words of the folded text; full-width letters become plain ones."""
    if not text:
        return []
    low = text.lower()
    if any("！" <= c <= "～" for c in (low if not low.isascii() else "")):
        low = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in low)
    return _WORD.findall(_TRAILING.sub(" ", low).translate(_TABLE))


def features(words: list[str]) -> set[str]:
    """Whole words as `word ` and word beginnings as `wor`."""
    distinct = set(words)
    out = {w + " " for w in distinct if len(w) > 2}
    for n in STEMS:
        out.update(w[:n] for w in distinct if len(w) > n)
    return out


def automaton(weights: dict[str, float], exceptions: set[str]) -> ahocorasick.Automaton:
    """Keys begin with the blank before a word. `1` folds to i, so l is also looked for as i."""
    out = ahocorasick.Automaton()
    for phrase in exceptions:
        out.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, ""))
    for entry, weight in weights.items():
        for form in {entry, entry.replace("l", "i")}:
            if f" {form}" not in out:
                out.add_word(f" {form}", (len(form) + 1, weight, entry))
    if len(out):
        out.make_automaton()
    return out


def hits(words: list[str], machine: ahocorasick.Automaton) -> list[tuple[int, float, str]]:
    """Where, weight and entry; at each word its strongest entry, none inside an exception."""
    if not words or not len(machine):
        return []
    line = f" {' '.join(words)} "
    at: dict[int, tuple[float, str]] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight, entry) in machine.iter(line):
        start = end - length + 1
        if not entry:
            spared.append((start, end))
        elif start not in at or weight > at[start][0]:
            at[start] = (weight, entry)
    return [(k, *v) for k, v in sorted(at.items()) if not any(a <= k < b for a, b in spared)]


def measures(words: list[str], machine: ahocorasick.Automaton) -> tuple[float, float]:
    """Weight found, damped, and that weight per 100 words, damped."""
    total = sum(w for _, w, _ in hits(words, machine))
    return math.log1p(total), math.log1p(100 * total / max(len(words), 20))


def _count(rows: DataFrame, make) -> DataFrame:
    """Sums of (f, n) that the tasks count in rows of (text, toxic)."""

    def run(batches):
        seen: Counter[str] = Counter()
        step = make()
        for batch in batches:
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(step(folded_words(body), toxic))
            if len(seen) > 300_000:
                yield _rows(seen)
                seen.clear()
        if seen:
            yield _rows(seen)

    return rows.select("text", "toxic").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _rows(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])


def logistic(cells: dict[tuple[float, float, int], int]) -> tuple[float, float, float]:
    """Intercept and two slopes (never negative) by Newton's method on counted cells, slightly ridged."""
    x = np.array([(1.0, a, b) for a, b, _ in cells], float).reshape(-1, 3)
    y = np.array([t for _, _, t in cells], float)
    n = np.array(list(cells.values()), float)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1.0, 1.0])
    free = [0, 1, 2]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge @ w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge
        step = np.zeros(3)
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
        w += np.clip(step, -2, 2)
        if (bad := [k for k in free if k and w[k] < 0]):
            w[bad] = 0.0
            free = [k for k in free if k not in bad]
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> dict:
    """Lexicon, exceptions and the logistic function from at most max_labelled labelled rows."""
    spark = session(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__label_id")).agg(F.max(F.col(label)).alias("toxic"))
    total = known.count()
    share = min(1.0, max_labelled / max(total, 1))
    # At most about max_labelled rows of 12 bytes: this side may go to every task.
    some = known if share == 1.0 else known.where(F.pmod(F.xxhash64("__label_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(some), F.col("__id") == F.col("__label_id")).select("text", "toxic")
    one = F.coalesce("text", F.lit(""))
    rows = rows.groupBy(F.xxhash64(one).alias("a"), F.hash(F.lit(17), one).alias("b")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = written(rows.select("text", "toxic"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy(F.least(F.col("toxic").cast("int"), F.lit(1)).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return {"weights": {}, "exceptions": set(), "curve": (-30.0, 0.0, 0.0)}
    least = max(MIN_DOCS, MIN_SHARE * n_toxic)
    toxic = {r["f"]: r["n"] for r in _count(rows.where("toxic > 0"), lambda: lambda words, _: features(words)).where(F.col("n") >= least).toLocalIterator()}
    shared = spark.sparkContext.broadcast(set(toxic))
    clean = {r["f"]: r["n"] for r in _count(rows.where("toxic <= 0"), lambda: lambda words, _: features(words) & shared.value).toLocalIterator()}
    odds = {f: math.log(((n + 0.5) / (n_toxic + 1)) / ((clean.get(f, 0) + 0.5) / (n_clean + 1))) for f, n in toxic.items()}
    # A word beginning is only an entry of its own if it is as telling as log(8); words that it covers are left out.
    chosen = {f: w for f, w in odds.items() if w >= math.log(8) and clean.get(f, 0) <= toxic[f]}
    weights = {f: w for f, w in chosen.items() if not any(f[:n] in chosen and chosen[f[:n]] >= w - 0.5 for n in STEMS if n < len(f.rstrip()))}
    every = spark.sparkContext.broadcast((weights, set(), NEAR_BEST))

    def strongest():
        *own, near = every.value
        machine = automaton(*own)

        def step(words, _):
            found = hits(words, machine)
            best, line, first = max((w for _, w, _ in found), default=0.0), f" {' '.join(words)} ", {}
            for at, weight, entry in found:
                if weight >= best - near and entry not in first:
                    end = line.find(" ", at + 1)
                    first[entry] = f"{entry}|{line[line.rfind(' ', 0, at) + 1 : at]}|{line[end + 1 : max(line.find(' ', end + 1), end + 1)]}"
            return first.values()

        return step

    places = _count(rows.where("toxic > 0"), strongest).groupBy(F.substring_index("f", "|", 1).alias("f")).agg(F.count("*").alias("n"))
    leading = {r["f"] for r in places.where(F.col("n") >= least).toLocalIterator()}
    weights = {f: w for f, w in weights.items() if f in leading}
    machine_of = spark.sparkContext.broadcast((weights, set()))

    def around():
        machine = automaton(*machine_of.value)

        def step(words, is_toxic):
            out = Counter()
            if hits(words, machine):
                for a, b in zip(words, words[1:], strict=False):
                    if hits([a], machine) or hits([b], machine):
                        out[f"{int(is_toxic > 0)} {a} {b}"] = 1
            return out

        return step

    pairs = _count(rows, around).select(F.substring("f", 3, 1 << 20).alias("p"), F.substring("f", 1, 1).alias("t"), "n")
    pairs = pairs.groupBy("p").agg(F.sum(F.when(F.col("t") == "1", F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("t") == "0", F.col("n")).otherwise(0)).alias("good"))
    exceptions = {r["p"] for r in pairs.where((F.col("good") >= MIN_DOCS) & (F.col("good") >= 4 * F.col("bad"))).toLocalIterator()}
    model_of = spark.sparkContext.broadcast((weights, exceptions))

    def measured():
        machine = automaton(*model_of.value)

        def step(words, is_toxic):
            a, b = measures(words, machine)
            return [f"{a:.1f} {b:.1f} {int(is_toxic > 0)}"]

        return step

    cells = {}
    for r in _count(rows, measured).toLocalIterator():
        a, b, t = r["f"].split()
        cells[float(a), float(b), int(t)] = r["n"]
    return {"weights": weights, "exceptions": exceptions, "curve": logistic(cells)}


def score(docs: DataFrame, keep: list[str], model: dict, text: str = "text") -> DataFrame:
    """The kept columns, score and __entries (what was found)."""
    spark = session(docs.sparkSession)
    source = docs.select(*keep, F.col(text).alias("__text"))
    shared = spark.sparkContext.broadcast(model)

    def make():
        own = shared.value
        machine, (c, a, b) = automaton(own["weights"], own["exceptions"]), own["curve"]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, entries = [], []
            for body in batch.column(len(keep)).to_pylist():
                words = folded_words(body)
                found = hits(words, machine)
                total = sum(w for _, w, _ in found)
                z = c + a * math.log1p(total) + b * math.log1p(100 * total / max(len(words), 20))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                entries.append(sorted({e.strip() for _, _, e in found}))
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(scores, pa.float64()), pa.array(entries, pa.list_(pa.string()))], names=[*keep, "score", "__entries"])

        return step

    return arrow_map(source, make, schema_with(source, keep, "score double, __entries array<string>"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    scored = score(docs, ["doc_id"], fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
