import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import context_mixing
from factloom.llm.common import LONG_TEXT


def test_pairs_by_arrays_equal_those_of_each_text():
    """Blanks of all kinds, words of zeros, ties of the class's sign, texts without words, and which are learned from."""
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"aAbB\x00\x1f \t\r\n\x0b\x0c", k=rng.randrange(40))) for _ in range(400)]
    texts += [None, b"   ", b"ab " * (LONG_TEXT // 3) + b"  c " * 300_000, "\u2003é é É\u00a0x".encode()]
    held, n, m = context_mixing.Pairs(), Counter(), Counter()
    for k, text in enumerate(texts):
        held.add(text, k % 3 > 0)
        own = context_mixing.pairs_of(text)
        m.update(own)
        n.update({key: times * (k % 3 > 0) for key, times in own.items()})
    found = held.batch().to_pydict()
    assert dict(zip(found["key"], found["m"], strict=True)) == dict(m)
    assert dict(zip(found["key"], found["n"], strict=True)) == dict(n)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    common = [f"w{k}" for k in range(300)]
    texts = [" ".join([*rng.choices(common, range(300, 0, -1), k=60), *(f"rare{k}x{j}" for j in range(100))]) for k in range(60)]
    return list(enumerate([*texts, "long words " * (LONG_TEXT // 10), None, ""]))


def test_scores_are_the_same_whatever_is_joined(spark, corpus, monkeypatch):
    """What goes to every task and what is joined adds up alike, and the base is exact for texts of many rare words."""
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    runs = []
    for heavy in (200_000, 100, 1):
        monkeypatch.setattr(context_mixing, "HEAVY", heavy)
        runs.append({r["doc_id"]: r.asDict() for r in context_mixing.score(docs, F.col("doc_id") % 3 != 1, ["doc_id"]).collect()})
    assert runs[0] == runs[1] == runs[2]
    counts = Counter(w for k, t in corpus if k % 3 != 1 for w in [*(t or "").split(), None])
    total = sum(counts.values())
    for k, text in corpus:
        words = [*(text or "").split(), None]
        want = math.fsum(n * math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w, n in Counter(words).items())
        got = runs[0][k]
        assert abs(got["base_score"] - want) < 1e-9 * max(1, len(words) / 100) and got["n_tokens"] == len(words)


def test_as_many_pairs_as_allowed_go_to_every_task(spark, monkeypatch):
    """Not only those that make up one in HEAVY of all tokens: the others' rows are shuffled."""
    monkeypatch.setattr(context_mixing, "HEAVY", 50)
    often = [1] * 1000 + [2] * 100 + [10] * 30 + [1000] * 10
    costs = spark.createDataFrame([(n,) for n in often], "m long")
    assert context_mixing._least(costs, sum(often)) == 10
    assert context_mixing._least(costs.where("m = 1"), 1000) > 1
    assert context_mixing._least(costs.where("m = 0"), 0) == 2
