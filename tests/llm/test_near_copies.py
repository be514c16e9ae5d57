"""The pipeline's near copies against brute force."""

import random

import pytest

from factloom.llm import near_copies


def own_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def texts(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    notice = [word() for _ in range(30)]
    out = []
    for k in range(60):
        body = [word() for _ in range(rng.choice([3, 40, 120, 400]))] + (notice if k % 3 == 0 else [])
        out.append(body)
        for _ in range(rng.randrange(5)):
            copy = list(rng.choice(out[-3:]))
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    return [" ".join(t) for t in out] + ["", None, "one two", "One  two"]


@pytest.mark.parametrize("seed,common", [(1, 8), (2, 1)])
def test_dedup_stage_equals_brute_force(spark, monkeypatch, seed, common):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    rows = list(enumerate(texts(seed)))
    sets = [own_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {k for k in root if find(k) == k}
    assert len(want) < len(rows) - 20
    assert {r["doc_id"] for r in corpus_pipeline.dedup(spark, docs, "").collect()} == want


def test_dedup_stage_on_odd_rows(spark, nasty, empty):
    import corpus_pipeline

    kept = corpus_pipeline.dedup(spark, nasty, "")
    assert kept.columns == nasty.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert corpus_pipeline.dedup(spark, empty, "").count() == 0


def test_large_group_gives_few_candidates(spark, monkeypatch):
    """Pairs around the similarity, many of them with one passage in common: candidates follow the group, not its square."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for k in range(300):
        text = list(base)
        for _ in range(rng.randrange(1, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(text)))
    seen = []
    similar = near_copies._similar

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(near_copies, "_similar", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    sets, root = [own_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert kept == set(root)
    assert sum(seen) < 10 * len(rows)


def test_sketch_is_of_the_parities_of_fewer_remainders():
    import numpy as np

    for n in (0, 1, 700, 3000):
        own = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64))
        odd = np.bincount((own % np.uint64(near_copies.PARITIES)).astype(np.int64), minlength=near_copies.PARITIES) & 1
        assert near_copies.sketch(near_copies.parities(own)) == np.packbits(odd.astype(np.uint8)).tobytes()
