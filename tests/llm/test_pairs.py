from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import context_mixing
from factloom.llm.common import LONG_TEXT


def test_pairs_of_many_texts_are_the_sum_of_each_ones():
    texts = [None, b"", b" \n", b"the cat and the dog", b"The CAT und der Hund und", b"no no on on", b"the cat and the dog", b"ab " * (LONG_TEXT // 3 + 5)]
    want, held = Counter(), context_mixing.Pairs()
    for text in texts:
        want.update(context_mixing.pairs_of(text))
        held.add(text)
    assert held.held == len(want)
    assert held.taken() == dict(want)
    assert held.held == 0 and held.taken() == {}


def test_slots_of_all_tables_at_once():
    rng = np.random.default_rng(1)
    contexts, byte = [rng.integers(0, 1 << 60, 50, np.uint64) for _ in context_mixing.BITS], rng.integers(0, 256, 50)
    for bit in range(8):
        assert (context_mixing._all_slots(np.stack(contexts), byte, bit) == np.stack(context_mixing._slots(contexts, byte, bit))).all()


def test_rare_pairs_are_joined_without_sorting_the_documents(spark):
    docs = spark.createDataFrame([(k, f"the word w{k} and w{k // 2} of {k % 3}") for k in range(40)], "doc_id long, text string")
    scored = context_mixing.score(docs, F.col("doc_id") % 5 != 1, ["doc_id"])
    assert scored.count() == 40
    plan = scored._jdf.queryExecution().optimizedPlan().toString() + scored._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan
