"""Facts from chunks: votes for a document's entity, candidates with their guards, grounding, dedupe, questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V
from factloom.functions.locate import locate

# The three families of numbers, tried one after the other, and words of addresses.
MONEY = r"(?i)(?:₹|Rs\.?|INR|USD|\$)?\s*\(?\s*\d[\d,]*(?:\.\d+)?\s*\)?\s*(?:Cr|crore?s?|lakh?s?|Mn|Bn|million|billion|%|percent)?"
PERCENT = r"(?i)\(?\s*\d[\d,]*(?:\.\d+)?\s*\)?\s*(?:%|percent)"
QUANTITY = r"(?i)\(?\s*\d[\d,]*(?:\.\d+)?\s*\)?\s*(?:Mn|Bn|million|billion|tons?|tonnes?|shipments|employees|people|days|branches|orders)\b.{0,8}?(?:plus|\+)?"
ADDRESS = r"(?i)\b(?:plot|road|street|floor|building|complex|mumbai|delhi|tel|phone|fax|\bCIN\b|pincode|email|@|www\.|gate|opposite|bandra|kurla)\b"
FACT = ["subject", "attribute", "value_raw", "value_norm", "unit_norm", "period", "scope", "fact_type", "confidence", "quote", "modality", "flags"]


def _none() -> Column:
    return F.array().cast("array<string>")


def located(text: Column, pattern: str) -> Column:
    """array<struct<raw,start,end>> of all matches; places are characters from 0."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))

    def placed(p: Column) -> Column:
        sizes = F.transform(p["m"], lambda m, i: F.length(F.get(p["b"], i)) + F.length(m))
        return V.bind(sizes, lambda n: F.transform(p["m"], lambda m, i: V.bind(F.aggregate(F.slice(n, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x), lambda end: F.struct(m.alias("raw"), (end - F.length(m)).alias("start"), end.alias("end")))))

    return V.bind(parts, placed)


def numeric_candidates(flat: Column, sentence: Column) -> Column:
    """array<struct<raw,unit,window>> of a sentence's measurements; flat: the sentence with single blanks.

    A raw text counts at its first place only, also where that place is then rejected.
    """
    every = F.concat(located(flat, MONEY), located(flat, PERCENT), located(flat, QUANTITY))
    seen = F.transform(every, lambda m: F.struct(V.strip(m["raw"]).alias("raw"), m["start"].alias("start"), m["end"].alias("end")))
    firsts = lambda all_seen: V.bind(F.transform(all_seen, lambda m: m["raw"]), lambda raws: F.filter(all_seen, lambda m, i: F.array_position(raws, m["raw"]) == i + 1))
    first = V.bind(seen, firsts)
    shaped = F.filter(first, lambda m: F.length(F.regexp_replace(m["raw"], r"(?U)[^\w]", "")) >= 2)
    closing = lambda m: m["raw"].startswith("(") & ~m["raw"].endswith(")") & (F.substr(flat, m["end"] + 1, F.lit(1)) == ")")
    back = lambda m, n: F.substr(flat, F.greatest(m["start"] - n, F.lit(0)) + 1, F.least(m["start"], F.lit(n)))
    full = F.transform(
        shaped,
        lambda m: F.struct(
            F.when(closing(m), F.concat(m["raw"], F.lit(")"))).otherwise(m["raw"]).alias("raw"),
            T.tail_unit(m["raw"]).alias("unit"),
            back(m, 12).alias("before"),
            F.when(F.contains(back(m, 90), F.lit(" ")), F.regexp_replace(back(m, 90), r"^[^ ]* ", "")).otherwise(F.lit("")).alias("window"),
        ),
    )
    bare = lambda c: c["unit"] == ""
    size = lambda c: F.length(T.digits(c["raw"]))
    rejected = lambda c: (
        (
            bare(c)
            & (
                c["raw"].rlike(r"^\(?\s*(?:19|20)\d{2}\s*,?\)?$")
                | T.digits(c["raw"]).rlike(r"^0\d+$")
                | ((size(c) >= 4) & F.contains(F.lower(sentence), F.lit("http")))
                | (size(c) == 6)
                | sentence.rlike(ADDRESS)
                | (size(c) <= 3)
            )
        )
        | (c["before"].rlike(r"(?i)(?:FY|Q[1-4]\s*FY)\s*$") & (size(c) <= 4))
        | c["raw"].rlike(r"^\(?\d{1,2}\)?$")
    )
    return F.filter(full, lambda c: ~rejected(c))


def has_signal(text: Column) -> Column:
    return text.rlike(MONEY) | text.rlike(PERCENT) | text.rlike(QUANTITY) | text.rlike(T.ORGANISATION) | text.rlike(T.ROLE)


def document_entities(chunks: DataFrame) -> DataFrame:
    """doc, entity: the organisation named most in the first 40 chunks, the first three counting more; empty if none."""
    numbered = chunks.select("doc", "text", F.row_number().over(Window.partitionBy("doc").orderBy("chunk_ord")).alias("k")).where("k <= 40")
    weight = F.when(F.col("k") == 1, 5).when(F.col("k") <= 3, 3).otherwise(1)
    named = numbered.select("doc", "k", weight.alias("w"), F.posexplode(T.organisations(F.col("text"))).alias("p", "name"))
    votes = named.groupBy("doc", "name").agg(F.sum("w").alias("w"), F.min(F.struct("k", "p")).alias("first"))
    best = votes.groupBy("doc").agg(F.max_by("name", F.struct("w", (-F.col("first.k")).alias("k"), (-F.col("first.p")).alias("p"))).alias("entity"))
    return chunks.select("doc").distinct().join(best, "doc", "left").select("doc", F.regexp_replace(F.coalesce("entity", F.lit("")), r"(?U)\s+", " ").alias("entity"))


def extract(chunks: DataFrame) -> DataFrame:
    """One row a fact of chunks (with entity): the chunk's columns, sent_ord, item_ord and FACT."""
    lines = chunks.select("*", F.posexplode(T.sentences(F.col("text"))).alias("sent_ord", "__s")).withColumn("__s", T.trimmed_sentence(F.col("__s")))
    lines = lines.where(~T.skipped(F.col("__s"))).withColumn("__flat", F.regexp_replace("__s", r"(?U)\s+", " "))
    found = lines.withColumn("__c", numeric_candidates(F.col("__flat"), F.col("__s")))
    claim = (F.size("__c") == 0) & (F.size(F.split(V.strip(F.col("__flat")), " ")) >= 6) & (F.col("__s").rlike(T.ROLE) | F.col("__s").rlike(T.ORGANISATION))
    common = [*chunks.columns, "sent_ord"]
    s = F.col("__s")
    each = found.select("*", F.posexplode("__c").alias("item_ord", "c"))
    number, unit = V.parse_number(V.number_part(F.col("c.raw"))), V.canonical_unit(F.col("c.unit"), F.concat(F.col("c.raw"), F.lit(" "), F.col("__flat")))
    period = V.canonical_period(F.col("__flat"))
    modality = F.when(F.contains(s, F.lit("|")), F.lit("table")).when(F.array_contains("modality_hints", "chart"), F.lit("chart")).otherwise(F.lit("text"))
    each = each.withColumns({"__n": number, "__u": unit, "__p": period, "__m": modality})
    window = F.col("c.window")
    numeric = each.select(
        *common,
        "item_ord",
        T.subject_of(s, F.col("entity")).alias("subject"),
        F.when(V.strip(window) != "", T.attribute_of(F.concat(window, F.lit(" "), F.col("c.unit")))).when(F.col("c.unit") != "", F.col("c.unit")).otherwise(F.lit("value")).alias("attribute"),
        F.col("c.raw").alias("value_raw"),
        V.to_base(F.col("__n.value"), F.col("__u")).alias("value_norm"),
        F.col("__u").alias("unit_norm"),
        F.col("__p.period").alias("period"),
        T.scope_of(s).alias("scope"),
        F.lit("numeric").alias("fact_type"),
        V.heuristic_confidence(F.col("__p.period"), F.col("__u"), F.col("__m")).alias("confidence"),
        F.substring(s, 1, 500).alias("quote"),
        F.col("__m").alias("modality"),
        F.concat("__n.flags", F.when(F.col("__m") == "chart", F.array(F.lit("chart-sourced"))).otherwise(_none()), "__p.flags").alias("flags"),
    )
    semantic = found.where(claim).select(
        *common,
        F.lit(0).alias("item_ord"),
        T.subject_of(s, F.col("entity")).alias("subject"),
        T.attribute_of(s).alias("attribute"),
        F.substring(s, 1, 160).alias("value_raw"),
        F.lit(None).cast("double").alias("value_norm"),
        F.lit("").alias("unit_norm"),
        F.lit("").alias("period"),
        F.lit("").alias("scope"),
        F.lit("semantic").alias("fact_type"),
        F.lit(0.45).alias("confidence"),
        F.substring(s, 1, 500).alias("quote"),
        F.lit("text").alias("modality"),
        F.array(F.lit("semantic-heuristic")).alias("flags"),
    )
    return numeric.unionByName(semantic)


_ITEM = "array<struct<subject:string,attribute:string,value_raw:string,unit:string,period:string,scope:string,fact_type:string,confidence:double,quote:string,modality:string>>"


def salvaged(answer: Column, schema: str = _ITEM) -> Column:
    """A model's JSON list: out of a code fence, or its outermost brackets; a single object is a list of one."""
    bare = V.strip(F.regexp_replace(F.regexp_replace(V.strip(answer), r"^```[^\n]*\n?", ""), r"`+$", ""))
    return F.coalesce(F.from_json(bare, schema), F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), schema), F.array().cast(schema))


def model_facts(chunks: DataFrame, extractor: Callable[[str, str], str]) -> tuple[DataFrame, DataFrame]:
    """Facts and rejected items of a model that answers (text, doc) with JSON; chunks without a signal aren't asked."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(answer=[extractor(t, d) for t, d in zip(frame["text"], frame["doc"], strict=True)])

    asked = chunks.where(has_signal(F.col("text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields) + ", answer string"
    each = asked.mapInPandas(ask, schema).select(*chunks.columns, F.posexplode(salvaged(F.col("answer"))).alias("item_ord", "i"))
    quote = V.strip(F.coalesce("i.quote", F.lit("")))
    placed = each.withColumn("__q", F.coalesce(locate(quote, F.col("text")), locate(quote, F.col("page_text"))))
    numeric = F.coalesce("i.fact_type", F.lit("numeric")) == "numeric"
    value = V.normalize_value(F.coalesce("i.value_raw", F.lit("")), F.col("i.unit"), F.concat(F.coalesce("i.period", F.lit("")), F.lit(" "), F.substring("text", 1, 400)))
    claimed = V.canonical_period(F.concat(F.coalesce("i.period", F.lit("")), F.lit(" "), F.col("__q")))
    given = F.coalesce("i.period", F.lit(""))
    kind = F.coalesce("i.modality", F.lit("text"))
    kind = F.when(kind == "unknown", F.when(F.contains("__q", F.lit("|")), F.lit("table")).otherwise(F.lit("text"))).otherwise(kind)
    good = placed.where(F.col("__q").isNotNull()).withColumns({"__v": value, "__c": claimed, "__m": kind, "__n": numeric})
    drawn = F.when(F.col("__m").isin("chart", "infographic"), F.array(F.lit("chart-sourced"))).otherwise(_none())
    facts = good.select(
        *chunks.columns,
        F.lit(1_000_000).alias("sent_ord"),
        "item_ord",
        F.coalesce(F.when(F.col("i.subject") != "", F.col("i.subject")), F.when(F.col("entity") != "", F.col("entity")), F.lit("document")).alias("subject"),
        T.cleaned_attribute(F.coalesce(F.when(F.col("i.attribute") != "", F.col("i.attribute")), F.lit("statement"))).alias("attribute"),
        T.cleaned_value(F.col("i.value_raw")).alias("value_raw"),
        F.when(F.col("__n"), F.col("__v.value_norm")).alias("value_norm"),
        F.when(F.col("__n"), F.col("__v.unit_norm")).otherwise(F.lit("")).alias("unit_norm"),
        F.when(given != "", given).when(F.col("__n"), F.col("__v.period")).otherwise(V.canonical_period(F.col("__q"))["period"]).alias("period"),
        F.coalesce("i.scope", F.lit("")).alias("scope"),
        F.coalesce("i.fact_type", F.lit("numeric")).alias("fact_type"),
        V.model_confidence(F.col("i.confidence"), F.col("__m")).alias("confidence"),
        F.col("__q").alias("quote"),
        F.col("__m").alias("modality"),
        F.concat(F.when(F.col("__n"), F.col("__v.flags")).otherwise(F.col("__c.flags")), drawn).alias("flags"),
    )
    rejected = placed.where(F.col("__q").isNull()).select(F.lit("llm-item-rejected").alias("kind"), F.concat(F.lit("["), F.col("doc"), F.lit(" p"), F.coalesce("page_label", F.lit("")), F.lit("] rejected: quote not grounded in source page; quote="), F.substring(quote, 1, 400)).alias("detail"))
    return facts, rejected


def grounded(facts: DataFrame) -> DataFrame:
    """facts with __reason: null if the quote stands in the chunk and a number is either read or flagged."""
    missing = (F.coalesce("quote", F.lit("")) == "") | ~F.contains("text", F.col("quote"))
    unread = (F.col("fact_type") == "numeric") & F.col("value_norm").isNull() & (F.size("flags") == 0)
    return facts.withColumn("__reason", F.when(missing, F.lit("quote not found verbatim in source chunk")).when(unread, F.lit("numeric fact without parseable value")))


def deduplicated(facts: DataFrame, order: list[str]) -> DataFrame:
    """Greedy in the given order: a fact goes if a kept one of its page has its attribute and its raw value, or its number and unit."""
    key = V.strip(F.lower("attribute"))
    row = F.struct(F.struct(*order).alias("o"), V.strip(F.col("value_raw")).alias("raw"), F.col("value_norm").alias("v"), F.col("unit_norm").alias("u"), F.struct(*facts.columns).alias("row"))
    groups = facts.groupBy("doc", "page_index", key.alias("__key")).agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("g"))
    empty = F.filter("g", lambda x: F.lit(False))
    fresh = lambda kept, x: ~F.exists(kept, lambda y: y["raw"].eqNullSafe(x["raw"]) | (y["v"].eqNullSafe(x["v"]) & y["u"].eqNullSafe(x["u"])))
    kept = F.aggregate("g", empty, lambda a, x: F.when(fresh(a, x), F.concat(a, F.array(x))).otherwise(a))
    return groups.select(F.explode(kept).alias("k")).select("k.row.*")


def numbered(facts: DataFrame, order: list[str]) -> DataFrame:
    """facts with fact_id: the document's name, the page and a running number of the document."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy(*order))
    return facts.withColumn("fact_id", F.concat(T.id_stem(F.col("doc")), F.lit("-"), F.lpad(F.col("page_index").cast("string"), 3, "0"), F.lit("-"), F.lpad(n.cast("string"), 4, "0")))


_EVIDENCE = ["doc", "page_index", "page_label", "quote", "modality"]


def questions_of(facts: DataFrame) -> DataFrame:
    """kind, detail, fact_ids, evidence: up to two questions a fact (drawn from a chart; without a period)."""
    ask = lambda when, kind, tail: F.when(when, F.struct(F.lit(kind).alias("kind"), F.concat(F.col("attribute"), F.lit(" = "), F.col("value_raw"), F.lit(tail)).alias("detail")))
    drawn = F.array_contains("flags", "chart-sourced") | F.col("modality").isin("chart", "infographic")
    undated = F.array_contains("flags", "no-period") & (F.col("fact_type") == "numeric")
    both = F.array_compact(F.array(ask(drawn, "chart-sourced-provisional", " awaits table/text corroboration."), ask(undated, "ambiguous-period", " has no detectable period.")))
    return facts.select(F.explode(both).alias("q"), F.array("fact_id").alias("fact_ids"), F.array(F.struct(*_EVIDENCE)).alias("evidence")).select("q.*", "fact_ids", "evidence")


def rejections(facts: DataFrame) -> DataFrame:
    return grounded(facts).where("__reason is not null").select(F.lit("verifier-rejection").alias("kind"), F.col("__reason").alias("detail"), F.array().cast("array<string>").alias("fact_ids"), F.array(F.struct(*_EVIDENCE)).alias("evidence"))


def facts_of(chunks: DataFrame, more: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda found: found) -> tuple[DataFrame, DataFrame]:
    """The knowledge base's facts and questions of chunks (and of a model's facts). keep: writes what was found, so that it is found once."""
    found = extract(chunks.join(document_entities(chunks), "doc") if "entity" not in chunks.columns else chunks)
    found = keep(found if more is None else found.unionByName(more))
    order = ["chunk_ord", "sent_ord", "item_ord"]
    facts = numbered(deduplicated(grounded(found).where("__reason is null").drop("__reason"), order), order)
    return facts, questions_of(facts).unionByName(rejections(found))
