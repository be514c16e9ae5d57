"""Linking facts of different documents: candidate pairs, verdicts, supersession, re-check, the judge's share.

Candidates come from equi-joins, never from all pairs of facts. With equal subjects, facts are joined on the subject and a
word of the topic. In the fuzzy mode they are joined on dictionaries of distinct strings: topics that share a word, or
(compared once for each pair of distinct topics of like length) that are nearly spelt alike; and subjects that are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V
from factloom.functions.fuzzy import token_set_ratio

ANCHOR_ALIKE, SUBJECT_ALIKE = 92, 60
JUDGE_BUDGET = 80
#: Into how many keys the facts of a topic are dealt where a topic alone is joined on.
SALTS = 32
RELATIONS = ["corroborates", "contradicts", "reconciled", "superseded-by"]
AXES = ["time", "scope", "units", "vintage"]
_SIDE = ["seq", "vintage", "fact_id", "doc", "page_label", "subject", "attribute", "value_raw", "value_norm", "unit_norm", "period", "scope", "fact_type", "confidence", "quote", "modality"]


def featured(facts: DataFrame) -> DataFrame:
    """Facts that can link at all, with all that pairs are compared by, so that it is worked out once a fact."""
    anchor, unit = T.topic_anchor(F.col("attribute")), F.col("unit_norm")
    known = facts if "vintage" in facts.columns else facts.withColumn("vintage", F.lit(0))
    out = known.select(*_SIDE).withColumns(
        {
            "anchor": anchor,
            "topic": T.topic_set(anchor),
            "who": V.strip(F.lower("subject")),
            "qualifier": V.strip(F.lower("scope")),
            "family": V.family(unit),
            "dimension": F.coalesce(V.family(unit), unit),
            "figure": T.digits(F.col("value_raw")),
            "prose": T.digits(F.concat("value_raw", "quote")),
            "context": T.context_of(*map(F.col, ("period", "scope", "unit_norm", "doc", "page_label"))),
        }
    )
    return out.where((F.col("attribute") != "") & (F.length("anchor") >= 4))


def topic_pairs(features: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(x, y, shared): ordered pairs of distinct anchors that may link, with the number of words they share."""
    anchors = features.select("anchor", "topic").distinct()
    words = anchors.select("anchor", F.explode("topic").alias("w"))
    left, right = words.select(F.col("anchor").alias("x"), "w"), words.select(F.col("anchor").alias("y"), "w")
    shared = left.join(right, "w").groupBy("x", "y").agg(F.count("*").cast("int").alias("shared"))
    if not fuzzy:
        return shared
    # Without a common word the score is 200 * common subsequence / both lengths: lengths differ by at most 8 % of their sum.
    sized = anchors.select("anchor", F.length("anchor").alias("n"))
    step = F.floor(F.log("n") / F.lit(0.16))
    near = sized.select(F.col("anchor").alias("x"), F.col("n").alias("nx"), step.cast("int").alias("b")).join(
        sized.select(F.col("anchor").alias("y"), F.col("n").alias("ny"), F.explode(F.array(*((step + k).cast("int") for k in (-1, 0, 1)))).alias("b")), "b"
    )
    near = near.where((F.col("x") != F.col("y")) & (F.abs(F.col("nx") - F.col("ny")) <= 0.08 * (F.col("nx") + F.col("ny"))))
    alike = near.join(shared, ["x", "y"], "left_anti").where(token_set_ratio("x", "y") >= ANCHOR_ALIKE)
    return shared.unionByName(alike.select("x", "y", F.lit(0).alias("shared")))


def alike_names(names: DataFrame, least: float = SUBJECT_ALIKE) -> DataFrame:
    """(p, q), both ways and each name with itself: pairs of the distinct `who` that are alike.

    Candidates are joined on a common word, or on like lengths: without a common word, the score is 200 * common subsequence /
    both lengths, so the shorter has at least least / (200 - least) of the longer's length.
    """
    names = names.select("who").distinct()
    words = names.select("who", F.explode(F.array_distinct(F.split("who", r"\s+"))).alias("w")).where("w <> ''")
    step = F.floor(F.log(F.greatest(F.length("who"), F.lit(1))) / -F.log(F.lit(least / (200 - least)))).cast("int")
    near = names.select(F.col("who").alias("p"), step.alias("b")).join(names.select(F.col("who").alias("q"), F.explode(F.array(step - 1, step, step + 1)).alias("b")), "b")
    near = near.where(200 * F.least(F.length("p"), F.length("q")) >= least * (F.length("p") + F.length("q")))
    shared = words.select(F.col("who").alias("p"), "w").join(words.select(F.col("who").alias("q"), "w"), "w")
    pairs = near.select("p", "q").union(shared.select("p", "q")).where("p < q").distinct().where(token_set_ratio("p", "q") >= least)
    return pairs.union(pairs.select("q", "p")).union(names.select("who", "who"))


def _sides(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(features.select(*(F.col(c).alias(f"{p}_{c}") for c in features.columns)) for p in "ab")


def _apart() -> Column:
    """a before b, of different documents, and not two numbers of different dimensions."""
    numbers = (F.col("a_fact_type") == "numeric") & (F.col("b_fact_type") == "numeric") & (F.col("a_unit_norm") != "") & (F.col("b_unit_norm") != "")
    return (F.col("a_seq") < F.col("b_seq")) & (F.col("a_doc") != F.col("b_doc")) & (~numbers | (F.col("a_dimension") == F.col("b_dimension")))


def _equal_subjects(features: DataFrame) -> DataFrame:
    """Pairs with one subject and a common word, met at the first of these: no earlier word of one is the other's."""
    earlier = F.transform("topic", lambda w, i: F.struct(w.alias("w"), F.slice("topic", F.lit(1), i).alias("earlier")))
    worded = features.select("*", F.inline(earlier))
    a, b = _sides(worded)
    first = (F.size("a_earlier") == 0) | (F.size("b_earlier") == 0) | ~F.arrays_overlap("a_earlier", "b_earlier")
    # In a filter and not in the join's own condition, which Spark would ask after what later filters ask of the pairs.
    pairs = a.join(b, (F.col("a_who") == F.col("b_who")) & (F.col("a_w") == F.col("b_w"))).where(_apart() & first)
    return pairs.drop("a_w", "b_w", "a_earlier", "b_earlier").withColumn("shared", F.size(F.array_intersect("a_topic", "b_topic")))


def _salted(side: DataFrame, seq: str) -> DataFrame:
    """side with one of SALTS numbers for each fact, so that the facts of a frequent topic go to many tasks."""
    return side.withColumn("salt", F.pmod(F.xxhash64(seq), F.lit(SALTS)).cast("int"))


def _every_salt(side: DataFrame) -> DataFrame:
    return side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _alike_subjects(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with alike subjects, by a dictionary of distinct subjects, not of facts."""
    a, b = _sides(features)
    on_topic = _salted(a, "a_seq").join(_every_salt(pairs.withColumnRenamed("x", "a_anchor")), ["a_anchor", "salt"]).drop("salt")
    met = on_topic.join(alike_names(features), F.col("a_who") == F.col("p"))
    return met.join(b, (F.col("b_anchor") == F.col("y")) & (F.col("b_who") == F.col("q")) & _apart())


def _vague(features: DataFrame, unknown: Column, pairs: DataFrame) -> DataFrame:
    """Pairs with at least one side without a known subject, joined by themselves so that known pairs are never built.

    Each fact without a subject looks for all others of its topic; two such facts meet once, by the first of them.
    """
    features = features.withColumn("unknown", unknown)
    one = features.where("unknown").select(F.struct("*").alias("v"), F.col("anchor").alias("x")).join(pairs, "x")
    other = _salted(features.select(F.struct("*").alias("o"), F.col("anchor").alias("y"), "seq"), "seq").drop("seq")
    met = _every_salt(one).join(other, ["y", "salt"])
    ahead = F.col("v.seq") < F.col("o.seq")
    met = met.where(ahead | ((F.col("v.seq") > F.col("o.seq")) & ~F.col("o.unknown")))
    columns = [c for c in features.columns if c != "unknown"]
    first, second = F.when(ahead, F.col("v")).otherwise(F.col("o")), F.when(ahead, F.col("o")).otherwise(F.col("v"))
    met = met.select(first.alias("a"), second.alias("b"), "shared").select(*(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in columns), "shared")
    same_words = F.col("a_topic") == F.col("b_topic")
    claims = (F.col("a_fact_type") == "semantic") & (F.col("b_fact_type") == "semantic")
    fallback = F.col("a_who").isin(T.UNKNOWN_SUBJECTS) & F.col("b_who").isin(T.UNKNOWN_SUBJECTS)
    return met.where(_apart() & F.when(claims, (F.col("shared") >= 2) | same_words).when(fallback, F.col("shared") >= 1).otherwise(same_words))


def same_topic(facts: DataFrame, subject_match: str = "fuzzy") -> DataFrame:
    """Ordered pairs (a_*, b_*; a before b in seq) of different documents on the same topic, and `shared`."""
    features = featured(facts)
    unknown = (F.col("who") == "") | F.col("who").isin(T.UNKNOWN_SUBJECTS)
    exact = subject_match == "exact"
    pairs = topic_pairs(features, not exact)
    known = _equal_subjects(features.where(~unknown)) if exact else _alike_subjects(features.where(~unknown), pairs)
    columns = [*(f"{p}_{c}" for p in "ab" for c in features.columns), "shared"]
    # Asked first, as the other join would deal out all facts by topic, only to find nothing.
    if features.where(unknown).select("seq").isEmpty():
        return known.select(*columns)
    return known.select(*columns).unionByName(_vague(features, unknown, pairs).select(*columns))


def _scope(side: str) -> Column:
    return F.col(f"{side}_qualifier")


def difference_axis() -> Column:
    return F.when(F.col("a_period") != F.col("b_period"), "time").when(_scope("a") != _scope("b"), "scope").when(F.col("a_unit_norm") != F.col("b_unit_norm"), "units").otherwise("vintage")


def said(side: str) -> Column:
    return F.col(f"{side}_context")


def vetoed() -> Column:
    """Two numbers whose units are known and can't be compared."""
    numbers = (F.col("a_fact_type") == "numeric") & (F.col("b_fact_type") == "numeric")
    return numbers & F.coalesce(F.col("a_family") != F.col("b_family"), F.lit(False))


def cites_figure() -> Column:
    """The prose side holds the digits of the number side."""
    a_number = F.col("a_fact_type") == "numeric"
    number = F.when(a_number, F.col("a_figure")).otherwise(F.col("b_figure"))
    prose = F.when(a_number, F.col("b_prose")).otherwise(F.col("a_prose"))
    return (number != "") & F.contains(prose, number)


def verdict(tolerance: float = V.TOLERANCE) -> Column:
    """What can be said of a pair without a judge, checked again, as a key of VERDICTS; null if nothing.

    A restatement in another dimension, which only a missing unit lets through, is none; a conflict between disclosures of
    different known years is a supersession.
    """
    a_year, b_year = (F.coalesce(f"{s}_vintage", F.lit(0)) for s in "ab")
    a_number, b_number = (F.col(f"{s}_fact_type") == "numeric" for s in "ab")
    near = V.close(F.col("a_value_norm"), F.col("b_value_norm"), tolerance)
    same_context = (F.col("a_period") == F.col("b_period")) & (_scope("a") == _scope("b")) & (F.col("a_unit_norm") == F.col("b_unit_norm"))
    return (
        F.when(vetoed(), F.lit(None))
        .when(a_number != b_number, F.when(cites_figure(), "cites"))
        .when(~a_number, "claims")
        .when(F.col("a_value_norm").isNull() | F.col("b_value_norm").isNull(), F.lit(None))
        .when(~same_context, F.when(~near, "explained").when(F.col("a_dimension") != F.col("b_dimension"), "dimension").otherwise("restated"))
        .when(near, "same")
        .when(F.col("a_topic") == F.col("b_topic"), F.when((a_year != 0) & (b_year != 0) & (a_year != b_year), "superseded").otherwise("conflict"))
    )


#: Relation, axis (DIFFERS: what differs first) and confidence of each verdict.
DIFFERS = "differs"
VERDICTS = {
    "cites": ("corroborates", None, 0.6),
    "claims": ("corroborates", None, 0.5),
    "restated": ("corroborates", DIFFERS, 0.75),
    "dimension": ("reconciled", "units", 0.75),
    "explained": ("reconciled", DIFFERS, 0.7),
    "same": ("corroborates", None, 0.85),
    "conflict": ("contradicts", None, 0.7),
    "superseded": ("superseded-by", "vintage", 0.75),
}


def _by_verdict(key: Column, values: dict[str, Column]) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def explanation(key: Column) -> Column:
    a_number = F.col("a_fact_type") == "numeric"
    number = F.when(a_number, F.col("a_value_raw")).otherwise(F.col("b_value_raw"))
    topic = F.when(a_number, F.col("b_attribute")).otherwise(F.col("a_attribute"))
    prefix = _by_verdict(key, {"restated": F.lit("Same figure expressed with different context: "), "dimension": F.lit("Same figure expressed with different context: "), "explained": F.lit("Figures differ but so does context: "), "same": F.lit("Same period, scope and value: "), "conflict": F.lit("Same period and scope but different values: ")})
    return (
        F.when(key == "cites", F.concat(F.lit("Prose claim cites the figure: '"), topic, F.lit("' mentions "), number, F.lit(" ("), F.when(a_number, said("a")).otherwise(said("b")), F.lit(").")))
        .when(key == "claims", F.concat(F.lit("Both state '"), F.col("a_attribute"), F.lit("' similarly ('"), F.col("a_value_raw"), F.lit("' vs '"), F.col("b_value_raw"), F.lit("').")))
        .otherwise(F.concat(prefix, F.lit("'"), F.col("a_attribute"), F.lit("' is "), F.col("a_value_raw"), F.lit(" ("), said("a"), F.lit(") vs "), F.col("b_value_raw"), F.lit(" ("), said("b"), F.lit(")")))
    )


def concluded(pairs: DataFrame) -> DataFrame:
    """Relations of pairs with a verdict. A verdict is looked up rather than asked for case by case: JVMs don't compile long methods."""
    key = F.col("v")
    found = lambda n: F.try_element_at(F.create_map(*(x for k, v in VERDICTS.items() if v[n] is not None for x in (F.lit(k), F.lit(v[n])))), key)
    axis = found(1)
    return _reported(pairs.where(key.isNotNull()), found(0), F.when(axis == DIFFERS, difference_axis()).otherwise(axis), found(2), explanation(key), key, F.lit(True))


def coerced_axis(axis: Column) -> Column:
    tidy = F.lower(V.strip(axis))
    return F.when(tidy.isin(AXES), tidy)


def finalized(rows: DataFrame, text: Column, tolerance: float = V.TOLERANCE) -> DataFrame:
    """Relations of pairs with relation, axis, confidence and an explanation (text).

    Only known kinds stay. A conflict of the same period between disclosures of different known years is a
    supersession. Other claims about numbers are checked again; there, a context is only the same if it has a period.
    """
    relation, axis = F.col("relation"), coerced_axis(F.col("axis"))
    a_year, b_year = (F.coalesce(f"{s}_vintage", F.lit(0)) for s in "ab")
    numbers = (F.col("a_fact_type") == "numeric") & (F.col("b_fact_type") == "numeric")
    near = V.close(F.col("a_value_norm"), F.col("b_value_norm"), tolerance)
    same = (F.col("a_period") == F.col("b_period")) & (F.col("a_period") != "") & (_scope("a") == _scope("b"))
    case = (
        F.when((relation == "contradicts") & (a_year != 0) & (b_year != 0) & (a_year != b_year) & (F.col("a_period") == F.col("b_period")), "superseded")
        .when(~numbers, "stands")
        .when(F.col("a_value_norm").isNull() | F.col("b_value_norm").isNull(), "unread")
        .when(F.col("a_dimension") != F.col("b_dimension"), F.when(relation.isin("corroborates", "contradicts"), "dimension").otherwise("stands"))
        .when(near & (relation == "contradicts") & ~same, "context")
        .when(~near & (relation == "corroborates") & same, "differs")
        .otherwise("stands")
    )
    rows = rows.where(relation.isin(RELATIONS)).withColumn("case", case)
    case = F.col("case")
    kind = F.when(case == "superseded", "superseded-by").when(case.isin("dimension", "context"), "reconciled").when(case == "differs", "contradicts").otherwise(relation)
    why = F.when(case == "superseded", "vintage").when(case == "dimension", "units").when(case == "context", F.coalesce(axis, difference_axis())).when(relation == "superseded-by", F.coalesce(axis, F.lit("vintage"))).otherwise(axis)
    return _reported(rows, kind, why, F.when(case == "superseded", 0.75).otherwise(F.coalesce("confidence", F.lit(0.5))), text, case, case != "unread")


def _reported(rows: DataFrame, relation: Column, axis: Column, confidence: Column, text: Column, case: Column, verified: Column) -> DataFrame:
    """Relations with all their columns; the older fact first where it was superseded."""
    a_year, b_year = (F.coalesce(f"{s}_vintage", F.lit(0)) for s in "ab")
    swapped = (case == "superseded") & (a_year > b_year)
    older = lambda name: F.when(swapped, F.col(f"b_{name}")).otherwise(F.col(f"a_{name}"))
    newer = lambda name: F.when(swapped, F.col(f"a_{name}")).otherwise(F.col(f"b_{name}"))
    corrected = lambda name, tail: F.concat(text, F.lit(" [corrected: "), F.col(f"a_{name}"), F.lit(" vs "), F.col(f"b_{name}"), F.lit(tail))
    words = (
        F.when(case == "superseded", F.concat(older("value_raw"), F.lit(" ("), older("context"), F.lit(") was superseded by "), newer("value_raw"), F.lit(" ("), newer("context"), F.lit("): later disclosure wins, not a conflict.")))
        .when(case == "unread", F.concat(text, F.lit(" [unverified: unparseable value]")))
        .when(case == "dimension", corrected("unit_norm", " are different dimensions]"))
        .when(case == "differs", corrected("value_raw", " differ beyond tolerance]"))
        .otherwise(text)
    )
    return rows.select(relation.alias("relation"), axis.alias("axis"), older("fact_id").alias("fact_a"), newer("fact_id").alias("fact_b"), words.alias("explanation"), confidence.alias("confidence"), verified.alias("verified"), "a_seq", "b_seq")


def candidate_score(tolerance: float = V.TOLERANCE) -> Column:
    """How promising a pair is for the judge."""
    same = lambda name: (F.col(f"a_{name}") != "") & (F.col(f"a_{name}") == F.col(f"b_{name}"))
    one = lambda when, points: F.when(when, F.lit(points)).otherwise(F.lit(0.0))
    numbers = (F.col("a_fact_type") == "numeric") & (F.col("b_fact_type") == "numeric")
    near = F.coalesce(numbers & V.close(F.col("a_value_norm"), F.col("b_value_norm"), tolerance), F.lit(False))
    return F.col("shared") + one(same("period"), 2.0) + one(same("scope"), 1.0) + one(same("unit_norm"), 1.0) + one(near, 1.5)


def judge_candidates(pairs: DataFrame, budget: int = JUDGE_BUDGET, tolerance: float = V.TOLERANCE) -> DataFrame:
    """The most promising pairs without a verdict, as many as the budget of one run allows."""
    open_pairs = pairs.where(F.col("v").isNull()).withColumn("score", candidate_score(tolerance))
    return open_pairs.orderBy(F.desc("score"), "a_seq", "b_seq").limit(budget)


def slim(side: str) -> Column:
    """What a judge gets to see of a fact, as JSON."""
    plain = [F.col(f"{side}_{c}").alias(c) for c in ("subject", "attribute", "value_raw", "value_norm", "unit_norm", "period", "scope", "fact_type")]
    source = F.concat(F.col(f"{side}_doc"), F.lit(" p."), F.coalesce(f"{side}_page_label", F.lit("None"))).alias("source")
    return F.to_json(F.struct(*plain, source, F.substring(f"{side}_quote", 1, 400).alias("quote")))


Judge = Callable[[str, str], dict | None]


def judged(candidates: DataFrame, judge: Judge) -> DataFrame:
    """candidates with the judge's verdict as `v`; a judge that fails says nothing. Vetoed pairs aren't asked."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for a, b in zip(frame["ja"], frame["jb"], strict=True):
                try:
                    said.append(judge(a, b) or {})
                except Exception:  # noqa: BLE001 - any failure of the judge is no verdict
                    said.append({})
            yield pd.DataFrame({"a_seq": frame["a_seq"], "b_seq": frame["b_seq"], **{k: [s.get(k) for s in said] for k in ("relation", "axis", "confidence", "explanation")}}).astype({"confidence": "float64"})

    asked = candidates.where(~vetoed()).select("a_seq", "b_seq", slim("a").alias("ja"), slim("b").alias("jb"))
    kinds = candidates.schema
    answers = asked.mapInPandas(ask, f"a_seq {kinds['a_seq'].dataType.simpleString()}, b_seq {kinds['b_seq'].dataType.simpleString()}, relation string, axis string, confidence double, explanation string")
    return candidates.drop("v", "score").join(answers, ["a_seq", "b_seq"])


def relate(facts: DataFrame, documents: DataFrame | None, subject_match: str = "fuzzy", judge: Judge | None = None, budget: int = JUDGE_BUDGET, tolerance: float = V.TOLERANCE) -> DataFrame:
    """All relations of the facts; documents: doc and vintage; None if the facts have it. Without a judge, pairs that need one stay out."""
    dated = facts if documents is None else facts.drop("vintage").join(documents.select("doc", "vintage"), "doc", "left")
    pairs = same_topic(dated, subject_match).withColumn("v", verdict(tolerance))
    relations = concluded(pairs)
    if judge is None:
        return relations
    answered = judged(judge_candidates(pairs, budget, tolerance), judge)
    return relations.unionByName(finalized(answered, F.coalesce("explanation", F.lit("")), tolerance))
