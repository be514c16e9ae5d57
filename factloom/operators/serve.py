"""Read queries of the knowledge base: search, relations, timeline, best cases, questions, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import values as V

SEARCH_LIMIT, TIMELINE_LIMIT, QUESTION_LIMIT, QUOTE_CHARS = 500, 1000, 300, 300
# Words too general to connect two attributes, and which failures are shown first.
GENERIC = ["growth", "rate", "rates", "total", "average", "change", "index", "year", "annual", "overall", "general", "nominal", "real"]
PRIORITY = {"verifier-rejection": 0, "link-error": 1, "llm-extract-error": 1, "chart-sourced-provisional": 2, "ambiguous-period": 3}
EXPORTED = ["fact_id", "doc", "page_index", "page_label", "subject", "attribute", "value_raw", "value_norm", "unit_norm", "period", "scope", "confidence"]


def search(facts: DataFrame, query: str = "", doc: str = "", limit: int = SEARCH_LIMIT) -> DataFrame:
    """Facts whose subject, attribute, value and period, run together, hold the query; in order of seq."""
    found = facts
    if query:
        found = found.where(F.contains(F.lower(F.concat("subject", "attribute", "value_raw", "period")), F.lit(query.lower())))
    if doc:
        found = found.where(F.col("doc") == doc)
    return found.orderBy("seq").limit(limit)


def filtered(facts: DataFrame, fact_type: str = "", flagged: bool | None = None) -> DataFrame:
    out = facts.where(F.col("fact_type") == fact_type) if fact_type else facts
    return out if flagged is None else out.where((F.size("flags") > 0) == F.lit(flagged))


def with_facts(relations: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """relations with a_* and b_* of both facts, null where a fact is missing."""
    out = relations
    for side in "ab":
        own = facts.select(F.col("fact_id").alias(f"fact_{side}"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        out = out.join(own, f"fact_{side}", "left")
    return out


def relations_of(relations: DataFrame, kind: str = "") -> DataFrame:
    return (relations.where(F.col("relation") == kind) if kind else relations).orderBy(F.desc("confidence"), "fact_a", "fact_b")


def timeline(facts: DataFrame, limit: int = TIMELINE_LIMIT) -> DataFrame:
    return facts.where("period <> ''").orderBy("period", "doc", "seq").limit(limit)


def per_group(rows: DataFrame, key: str, n: int, order: list) -> DataFrame:
    """The first n rows of each group, as lists beside each other show them."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)


def quality() -> Column:
    """How well a relation (with a_* and b_* of its facts) serves as an example; -1 if not at all.

    A subject counts as equal only if the second one is in lower case: that is the behaviour to match.
    """
    a, b = (lambda name: F.coalesce(f"a_{name}", F.lit(""))), (lambda name: F.coalesce(f"b_{name}", F.lit("")))
    words = lambda text: F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    left, right = words(a("attribute")), words(b("attribute"))
    both, all_words = F.array_intersect(left, right), F.array_union(left, right)
    spoken = (F.size(left) > 0) & (F.size(right) > 0)
    points = lambda when, n: F.when(when, F.lit(n)).otherwise(F.lit(0.0))
    drawn = [points(F.col(f"{s}_modality").isin("chart", "infographic"), -0.15) + points(F.size(F.filter(F.split(F.coalesce(f"{s}_attribute", F.lit("")), r"\s+"), lambda w: w != "")) > 6, -0.1) for s in "ab"]
    total = (
        points((F.lower(a("subject")) == b("subject")) & (a("subject") != ""), 3.0)
        + points((a("unit_norm") == b("unit_norm")) & (a("unit_norm") != ""), 2.0)
        + points((a("period") == b("period")) & (a("period") != ""), 1.0)
        + F.when(spoken, F.size(both) / F.size(all_words)).otherwise(F.lit(0.0))
        + F.lit(0.1) * F.least(F.coalesce("a_confidence", F.lit(0.0)), F.coalesce("b_confidence", F.lit(0.0)))
        + drawn[0]
        + drawn[1]
        + points(F.col("verified"), 0.05)
    )
    missing = F.col("a_subject").isNull() | F.col("b_subject").isNull()
    general = spoken & (F.size(F.array_except(both, F.array(*map(F.lit, GENERIC)))) == 0)
    return F.when(missing | ~V.same_dimension(a("unit_norm"), b("unit_norm")) | general, F.lit(-1.0)).otherwise(total)


def best_cases(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """For each kind the relation that shows it best, with its facts."""
    rated = with_facts(relations, facts, ["subject", "attribute", "value_raw", "unit_norm", "period", "confidence", "modality"]).withColumn("quality", F.round(quality(), 6))
    order = Window.partitionBy("relation").orderBy(F.desc("quality"), F.desc("confidence"), "fact_a", "fact_b")
    return rated.where(F.col("relation").isin("corroborates", "contradicts", "reconciled")).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def first_failure(questions: DataFrame) -> DataFrame:
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("kind")), F.lit(9))
    return questions.orderBy(rank, "id").limit(1)


def question_page(questions: DataFrame, limit: int = QUESTION_LIMIT) -> DataFrame:
    return questions.orderBy("id").limit(limit)


def exported_facts(facts: DataFrame) -> DataFrame:
    return facts.select(*EXPORTED[:-1], F.col("confidence"), F.substring("quote", 1, QUOTE_CHARS).alias("quote"))


def export(facts: DataFrame, relations: DataFrame, path: str) -> None:
    exported_facts(facts).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/facts")
    relations_of(relations).write.mode("overwrite").json(f"{path}/relations")
