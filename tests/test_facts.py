from pyspark.sql import functions as F

from factloom.operators import extract as X
from factloom.operators import link as L
from factloom.operators import store as O
from factloom.operators.jobs import Jobs, fraction
from factloom.sources.pages import chunk_pages, split_pages

FACT = "seq long, fact_id string, doc string, page_index int, page_label string, subject string, attribute string, value_raw string, value_norm double, unit_norm string, period string, scope string, fact_type string, confidence double, quote string, modality string, flags array<string>"


def fact(seq, doc, value, unit="inr-cr", period="FY2024", scope="", attribute="revenue from services", subject="Acme", kind="numeric"):
    return (seq, f"f{seq}", doc, 0, "1", subject, attribute, str(value), value, unit, period, scope, kind, 0.8, "q", "text", [])


def relations(spark, rows, years=(), match="fuzzy"):
    docs = spark.createDataFrame([(r[2], dict(years).get(r[2], 0)) for r in rows], "doc string, vintage int").distinct()
    out = L.relate(spark.createDataFrame(rows, FACT), docs, match)
    return {(r["fact_a"], r["fact_b"]): (r["relation"], r["axis"]) for r in out.collect()}


def test_verdicts(spark):
    a = fact(1, "d1", 8.142e10)
    cases = [
        (fact(2, "d2", 8.142e10), ("corroborates", None)),
        (fact(2, "d2", 8.1415e10, "inr-mn"), ("corroborates", "units")),
        (fact(2, "d2", 7.0e10), ("contradicts", None)),
        (fact(2, "d2", 7.2e10, period="FY2023"), ("reconciled", "time")),
        (fact(2, "d2", 7.2e10, scope="adjusted"), ("reconciled", "scope")),
    ]
    for b, expected in cases:
        assert relations(spark, [a, b]) == {("f1", "f2"): expected}
    assert relations(spark, [a, fact(2, "d1", 8.142e10)]) == {}
    assert relations(spark, [a, fact(2, "d2", 31.0, "%")]) == {}
    assert relations(spark, [a, fact(2, "d2", 8.142e10, subject="Wholly other")]) == {}


def test_supersession(spark):
    pair = [fact(1, "old", 58000.0, "employees"), fact(2, "new", 65000.0, "employees")]
    assert relations(spark, pair, {"old": 2030, "new": 2020}.items()) == {("f2", "f1"): ("superseded-by", "vintage")}
    assert relations(spark, pair, {"old": 2025, "new": 2025}.items()) == {("f1", "f2"): ("contradicts", None)}
    assert relations(spark, pair, {"new": 2025}.items()) == {("f1", "f2"): ("contradicts", None)}


def test_unknown_subjects(spark):
    rows = [fact(1, "d1", 1.0, subject="document"), fact(2, "d2", 1.0, subject=""), fact(3, "d3", 1.0, subject="report", attribute="revenue outlook")]
    assert set(relations(spark, rows)) == {("f1", "f2"), ("f1", "f3")}


def test_judge_budget(spark):
    rows = [fact(k, "d1", 100.0 + k, "inr", attribute=f"total revenue alpha {c}{c}{c}") for k, c in enumerate("abcdefgh")]
    rows += [fact(100 + k, "d2", 900.0 + k, "inr", attribute=f"revenue growth alpha {c}{c}{c}") for k, c in enumerate("abcdefgh")]
    frame, docs = spark.createDataFrame(rows, FACT), spark.createDataFrame([("d1", 0), ("d2", 0)], "doc string, vintage int")
    said = L.relate(frame, docs, "exact", judge=lambda a, b: {"relation": "reconciled", "axis": "None", "confidence": 0.6, "explanation": "x"}, budget=5)
    got = said.collect()
    assert len(got) == 5 and {r["axis"] for r in got} == {None}


def test_greedy_dedupe(spark):
    rows = [(1, "a", 1.0), (2, "b", 1.0), (3, "b", 2.0), (4, "c", None), (5, "d", None)]
    frame = spark.createDataFrame([("d", 0, "x", s, raw, v, "u") for s, raw, v in rows], "doc string, page_index int, attribute string, seq int, value_raw string, value_norm double, unit_norm string")
    assert sorted(r["seq"] for r in X.deduplicated(frame, ["seq"]).collect()) == [1, 3, 4]


def test_end_to_end(spark):
    blob = "Delta Express Limited results\n== PAGE 5 ==\nTotal revenue of Delta Express Limited was Rs 8,142 Cr in FY2024 overall.\n\nHeadcount (404) see 2024 and 110042 for details here.\n== PAGE 6 ==\nMr Rao was appointed chairman of Delta Express Limited last year."
    pages = split_pages(spark.createDataFrame([("d.pdf", blob)], "doc string, blob string"))
    assert [(r["page_index"], r["page_label"]) for r in pages.orderBy("page_index").collect()] == [(0, "?"), (1, "5"), (2, "6")]
    facts, questions = X.facts_of(chunk_pages(pages))
    rows = {r["value_raw"]: r for r in facts.collect()}
    money = rows["Rs 8,142 Cr"]
    assert money["value_norm"] == 8142e7 and money["unit_norm"] == "inr-cr" and money["period"] == "FY2024" and money["subject"].endswith("Limited") and money["fact_id"].startswith("d_pdf-001-")
    assert [r["fact_type"] for r in rows.values()].count("semantic") == 1
    assert "110042" not in rows and "2024" not in rows


def test_model_items(spark):
    chunk = spark.createDataFrame([("d", 0, "1", (0, 0), "Revenue was 5 Cr in FY24 for us", [], "Revenue was 5 Cr in FY24 for us", "")], "doc string, page_index int, page_label string, chunk_ord struct<page_index:int,__i:int>, text string, modality_hints array<string>, page_text string, entity string")
    answer = '```json\n[{"subject":"Acme","attribute":"revenue FY24","value_raw":"**5**","unit":"Cr","quote":"Revenue was  5 Cr"},{"quote":"made up"}]\n```'
    facts, rejected = X.model_facts(chunk, lambda text, doc: answer)
    [row] = facts.collect()
    assert (row["attribute"], row["value_raw"], row["value_norm"], row["quote"], row["period"]) == ("revenue", "5", 5e7, "Revenue was 5 Cr", "FY2024")
    assert rejected.count() == 1


def test_delete_cascade(spark):
    tables = {
        "documents": spark.createDataFrame([("a.pdf",), ("b.pdf",)], "doc string"),
        "facts": spark.createDataFrame([("f1", "a.pdf"), ("f2", "a.pdf"), ("f3", "b.pdf")], "fact_id string, doc string"),
        "relations": spark.createDataFrame([("f1", "f3"), ("f3", "f2")], "fact_a string, fact_b string"),
        "open_questions": spark.createDataFrame([(1, ["f1"]), (2, [])], "id int, fact_ids array<string>"),
    }
    left = O.delete_document(tables, "a.pdf")
    assert {k: v.count() for k, v in left.items()} == {"documents": 1, "facts": 1, "relations": 0, "open_questions": 1}


def test_store_and_stream(spark, tmp_path):
    from factloom.operators.store import Store
    from factloom.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    said = "Revenue of Acme Data Bank was Rs {} Cr in FY2023 in total. Profit of Acme Data Bank was Rs 345 Cr in total."
    (tmp_path / "in/r1.txt").write_text(said.format("12,345"))
    store = Store(spark, str(tmp_path / "kb"))
    run = lambda: ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
    for _ in range(2):
        run()
        assert store.read("documents").count() == 1 and store.read("facts").count() == 2
    asked = store.read("open_questions").collect()
    assert asked and sorted(r["id"] for r in asked) == list(range(1, len(asked) + 1)) and {r["doc"] for r in asked} == {"r1.txt"}
    assert store.read("relations").count() == 0
    # A second document links with the first.
    (tmp_path / "in/r2.txt").write_text(said.format("12,345"))
    run()
    assert "corroborates" in {r["relation"] for r in store.read("relations").collect()}
    before = {r["attribute"]: r["count"] for r in store.read("schema_registry").collect()}
    # A changed document replaces its facts and questions; the registry counts on.
    store.ingest(store.read("documents").where("doc = 'r1.txt'"), store.read("facts").where("doc = 'r1.txt'"), store.read("open_questions").where("doc = 'r1.txt'").drop("id"))
    assert store.read("facts").count() == 4 and store.read("open_questions").count() == 2 * len(asked)
    assert all(r["count"] > before[r["attribute"]] for r in store.read("schema_registry").collect())
    store.delete("r1.txt")
    assert store.read("facts").count() == 2 and store.read("relations").count() == 0 and {r["doc"] for r in store.read("open_questions").collect()} == {"r2.txt"}
    assert {r["name"]: r["n"] for r in store.stats().collect()}["documents"] == 1


def test_alike_names_equal_brute_force(spark):
    from factloom.functions.fuzzy import word_set_similarity

    names = ["acme bank", "acme", "bank of acme", "acne", "xyz", "acme data bank ltd", "a", "nothing alike", "", "akme"]
    got = {(r["p"], r["q"]) for r in L.alike_names(spark.createDataFrame([(n,) for n in names], "who string")).collect()}
    assert got == {(p, q) for p in names for q in names if p == q or word_set_similarity(p, q) >= L.SUBJECT_ALIKE}


def test_jobs():
    assert fraction("parse", 1, 2) == 0.1 and fraction("extract", 1, 2) == 0.5 and fraction("link", 0, 0) == 0.0
    jobs = Jobs()
    key = jobs.start(["a"], lambda progress, stop: progress("parse", 1, 2) or {"facts": 3}, wait=True)
    assert jobs.rows[key]["status"] == "done" and jobs.rows[key]["stats"] == {"facts": 3}
    key = jobs.start(["a"], lambda progress, stop: (stop.set(), progress("link", 1, 2)), wait=True)
    assert jobs.rows[key]["status"] == "cancelled"
    jobs.rows["x"] = {"id": "x", "status": "running", "started_at": 0}
    jobs.reconcile()
    assert jobs.rows["x"]["status"] == "interrupted"
