"""Pairs of facts against brute force, and how they are made."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from factloom.operators import link as L

FACT = "seq long, vintage int, fact_id string, doc string, page_label string, subject string, attribute string, value_raw string, value_norm double, unit_norm string, period string, scope string, fact_type string, confidence double, quote string, modality string"
UNKNOWN = ["", "document", "doc", "report", "presentation"]


def facts(n, subjects):
    pick = random.Random(7).choice
    row = lambda k: (k, 0, f"f{k}", pick("xyz"), "1", pick(subjects), pick(["total revenue", "revenue total", "net revenue remarks", "total units", "units", "headcount"]), "5", pick([1.0, 1.01, 2.0]), pick(["inr", "inr-mn", "usd", "", "%"]), "FY2024", "", pick(["numeric", "numeric", "semantic"]), 0.8, "q", "text")
    return [row(k) for k in range(n)]


@pytest.mark.parametrize("match", ["exact", "fuzzy"])
def test_pairs_equal_brute_force(spark, match):
    rows = facts(120, ["Acme Bank", "acme bank ", "Zyx", "", "document", "report"])
    dimension = {"inr": "m", "inr-mn": "m"}
    want = {}
    for a, b in combinations(rows, 2):
        x, y = (r[5].strip().lower() for r in (a, b))
        left, right = set(a[6].split()), set(b[6].split())
        shared = len(left & right)
        numbers = a[12] == b[12] == "numeric" and a[9] != "" != b[9]
        if not shared or a[3] == b[3] or (numbers and dimension.get(a[9], a[9]) != dimension.get(b[9], b[9])):
            continue
        if x not in UNKNOWN and y not in UNKNOWN:
            met = x == y
        elif a[12] == b[12] == "semantic":
            met = shared >= 2 or left == right
        else:
            met = left == right or (x in UNKNOWN[1:] and y in UNKNOWN[1:])
        if met:
            want[a[0], b[0]] = shared
    got = L.same_topic(spark.createDataFrame(rows, FACT), match).select("a_seq", "b_seq", "shared").collect()
    assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == want


def test_exact_pairs_are_dealt_out_by_subject(spark):
    """A topic is no key by itself: all facts of a frequent one would go to one task. And a JVM compiles no method beyond 8000 bytes."""
    pairs = L.relate(spark.createDataFrame(facts(40, ["Acme", "Zyx"]), FACT), None, "exact").groupBy("relation", "axis").agg(F.count("*"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = spark.createDataFrame([], pairs.schema).union(pairs)._jdf.queryExecution()
        plan, codes = execution.executedPlan().toString(), execution.debug().codegenToSeq()
        sizes = [codes.apply(k)._3().maxMethodCodeSize() for k in range(codes.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Join [a_who" in plan and "_anchor" not in plan and max(sizes) < 8000


def test_verdict_in_another_dimension(spark):
    rows = [(1, 0, "f1", "x", "1", "Acme", "total revenue", "5", 5.0, "", "FY2024", "", "numeric", 0.8, "q", "text"), (2, 0, "f2", "y", "1", "Acme", "total revenue", "5", 5.0, "inr", "FY2024", "", "numeric", 0.8, "q", "text")]
    [row] = L.relate(spark.createDataFrame(rows, FACT), None, "exact").collect()
    assert (row["relation"], row["axis"], row["confidence"]) == ("reconciled", "units", 0.75) and row["explanation"].endswith("[corrected:  vs inr are different dimensions]")
