"""The pipeline's language stage on scripts that were never learned."""

import random

from factloom.llm import language_id


def test_language_stage_rejects_scripts_not_learned(spark):
    import corpus_pipeline

    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    said = lambda letters, n: " ".join(word(letters) for _ in range(n))
    latin = [word("etaoinshrdlucm") for _ in range(80)]
    rows = [(k, " ".join(rng.choices(latin, k=60)), "en") for k in range(200)]
    span = lambda a, b: [chr(c) for c in range(a, b)]
    scripts = [span(0x430, 0x450), span(0x3B1, 0x3CA), span(0x5D0, 0x5EB), span(0x4E00, 0x5E00), span(0x627, 0x64B), span(0x905, 0x93A), span(0xAC00, 0xD7A0)]
    odd = [(1000 + 20 * s + k, said(letters, 3 + 10 * k), None) for s, letters in enumerate(scripts) for k in range(20)]
    short = [(5000, "A.", None), (5001, "ed to", None)]
    docs = spark.createDataFrame(rows + odd + short, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {k for k, _, _ in rows} | {5000, 5001}
    assert language_id.LEAST_SCORE >= 4 / language_id.DIMENSIONS**0.5
