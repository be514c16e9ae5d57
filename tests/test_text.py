import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.fuzzy import common_subsequence, word_set_similarity
from factloom.functions.locate import verbatim_span
from factloom.sources.pages import packed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    assert common_subsequence(a, b) == lcs(a, b)


def test_word_set_similarity():
    assert word_set_similarity("total revenue", "revenue total growth") == 100.0
    assert round(word_set_similarity("revenue", "revenues"), 1) == 93.3
    assert word_set_similarity("", "a") == 0.0


def test_spans():
    text = "Revenue grew **31%**\nto 8,142 Cr in FY24."
    assert verbatim_span("Revenue grew **31%**", text) == "Revenue grew **31%**"
    assert verbatim_span("to 8,142  Cr in", "x to 8,142\n Cr in y") == "to 8,142\n Cr in"
    assert verbatim_span("Revenue grew 31% to 8,142 Cr", text) == "Revenue grew **31%**\nto 8,142 Cr"
    assert verbatim_span("Revenue rose 31%", text) is None
    assert verbatim_span("", text) is None and verbatim_span("x", None) is None


def test_topic_scope_subject(spark):
    assert one(spark, T.topic_anchor(F.lit("Total Revenue for FY24 in crore"))) == "total revenue"
    assert one(spark, T.scope_of(F.lit("Adjusted total EBITDA, consolidated"))) == "adjusted; consolidated; total"
    assert one(spark, T.subject_of(F.lit("In May Acme Data Bank rose"), F.lit(""))) == "In May Acme Data Bank"
    assert one(spark, T.subject_of(F.lit("it rose"), F.lit(""))) == "document"
    assert one(spark, T.cleaned_value(F.lit('**"8,142  Cr"**'))) == "8,142 Cr"


def slow_chunks(page, limit):
    """Paragraph by paragraph, from the rules."""
    if len(page) <= limit:
        return [page]
    done, held = [], ""
    for p in page.split("\n\n"):
        lines = p.split("\n")
        rows = len(p) > limit and all(x.strip().startswith("|") for x in lines if x.strip())
        if held.strip() and (rows or len(held + p) + 2 > limit):
            done, held = [*done, held], ""
        if not rows:
            held += p + "\n\n"
            continue
        held = ""
        head = next(x for x in lines if x.strip().startswith("|")) + "\n"
        parts = [head]
        for x in lines[1:]:
            if len(parts[-1]) + len(x) + 1 > limit:
                parts.append(head)
            parts[-1] += x + "\n"
        done += [x for x in parts if x.strip() != head.strip()]
    return [x for x in [*done, held] if x.strip()]


def test_chunks_keep_tables_and_pages(spark):
    cut = lambda page, limit=4000: one(spark, packed(F.lit(page), limit))
    assert cut("short") == ["short"]
    table = "| h |\n" + "\n".join(f"| {k:05d} |" for k in range(30))
    parts = cut("intro\n\n" + table + "\n\ntail", 120)
    assert parts[0] == "intro\n\n" and all(p.startswith("| h |\n") for p in parts[1:-1]) and parts[-1] == "tail\n\n"
    assert sorted(line for p in parts[1:-1] for line in p.split("\n")[1:] if line) == sorted(table.split("\n")[1:])


def test_chunks_equal_brute_force(spark):
    rng = random.Random(7)
    table = lambda: "\n".join(f"| {'x' * rng.randrange(1, 30)} |" for _ in range(rng.randrange(1, 12)))
    plain = lambda: " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 25)))
    rows = [("\n\n".join(table() if rng.random() < 0.3 else plain() for _ in range(rng.randrange(1, 9))),) for _ in range(150)]
    for r in spark.createDataFrame(rows, "page string").select("page", packed(F.col("page"), 100).alias("parts")).collect():
        assert r["parts"] == slow_chunks(r["page"], 100), r["page"]


def test_spans_equal_a_loose_pattern():
    rng = random.Random(4)
    bits = ["ab", "c", "*", " ", "\n", "  ", "d.e", "_", "fgh", "|"]
    for _ in range(3000):
        text, quote = ("".join(rng.choices(bits, k=n)) for n in (14, rng.randrange(1, 6)))
        if not quote.split() or quote in text:
            continue
        found = re.search(r"\s+".join(map(re.escape, quote.split())), text)
        got = verbatim_span(quote, text)
        if found:
            assert got == found[0]
        elif got is not None:
            bare = lambda x: " ".join(re.sub(r"[*_`~>|]", "", x).split())
            assert got in text and bare(got) == bare(quote)
