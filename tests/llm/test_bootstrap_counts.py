"""Occurrences of contexts that first vouch after round 1."""

from factloom.llm import personal_data


def test_words_that_join_in_a_later_round_are_counted(spark):
    rows = [(k, f"mail account: user{k}@mail.example end") for k in range(20)]
    # Identifiers that the seeds' context vouches for, and that also follow `for`, which stands before much else.
    rows += [(100 + k, f"mail account: zx-9981{k}-k and then for zx-9981{k}-k") for k in range(4)]
    rows += [(200 + k, f"for the love of words and for all {k}") for k in range(60)]
    rows += [(300 + k, f"open for year-202{k} now") for k in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in personal_data.masked(frame).collect()}
    assert out[100] == "mail account: [ID] and then for [ID]"
    assert all(out[300 + k] == rows[84 + k][1] for k in range(2))
