"""Text functions as columns: cleaning, sentences, names, topics, scopes, pages' marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.values import strip

# Patterns and word lists.
HTML_TAG = r"(?i)</?(?:sup|sub|br|b|i|em|strong|span|div)[^>]*>"
MARKUP = r"\*\*|__|\*|_|`|#{1,6}\s?"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9(])"
ORGANISATION = r"\b([A-Z][A-Za-z&.,'’\-]+(?:\s+(?:of\s+)?[A-Z][A-Za-z&.,'’\-]+){0,3})\s+(Limited|Ltd\.?|Inc\.?|Bank|Corporation|Group|Fund|Ministry|Board|Authority|Organisation|Organization|Agency|Department|Survey|Office|Commission)\b"
ROLE = r"(?i)\b(?:is|are|was|were|became|appointed|resigned|retired|headquartered|founded|launched|acquired|merged|renamed|vision|mission)\b"
BOILERPLATE = r"(?i)^(?:contents?|what'?s inside|corporate overview|statutory reports|financial statements|page \d+|annual report|for more details|https?://|\d+\s*$)"
FOOTNOTE = r"(?i)^\(?\d{1,2}\)?\s+(?:As per|Growth rate|Includes|Note|Source|Due to)"
LEGEND = r"(?i)^\s*[#*^….\s]{1,6}:|^\s*\*{0,2}source\s*:|data for \d{4}[-–]\d{2} are provisional|^\s*(?:#+|\.\.\.)\s*:"
PERIOD_WORD = r"(?i)\b(?:FY\d{2,4}|Q[1-4]\s*FY\d{2,4}|FY\d{4}-\d{2,4}|20\d{2})\b"
ATTRIBUTE_STOP = ["the", "a", "an", "of", "in", "on", "for", "to", "and", "was", "were", "is", "are", "with", "by", "as", "at", "from", "its", "it", "sup", "sub", "br"]
TOPIC_NOISE = r"(?i)\b(?:fy\d{0,4}|q[1-4]|yoy|qoq|cr|crs|crore?s?|lakhs?|mn|bn|million|billion|rs|inr|usd|per|cent|percent)\b|[₹$%]"
TOPIC_STOP = ["the", "and", "for", "from", "with", "was", "are", "that", "this", "these", "those", "which", "such", "than", "then", "also", "into", "over", "about"]
SCOPES = [r"adjust(?:ed|ment)", r"standalone", r"consolidat(?:ed|ion)", r"pro forma", r"excluding [A-Za-z ]{0,40}", r"from services", r"service EBITDA", r"\btotal\b", r"\bnet\b", r"\bgross\b"]
CHART_WORD = r"(?i)\b(?:chart|margin|YoY|QoQ|legend)\b"
UNIT_TAIL = r"(?i)(Cr|crore?s?|lakh?s?|Mn|Bn|million|billion|%|percent|tons?|tonnes?|shipments|employees|people|days)(\s+(?:Tons?|tonnes?|shipments?))?\+?$"
UNKNOWN_SUBJECTS = ["document", "doc", "report", "presentation"]


def clean(text: Column) -> Column:
    """Without inline HTML tags and Markdown marks; runs of blanks are one."""
    plain = F.regexp_replace(F.regexp_replace(text, HTML_TAG, " "), MARKUP, "")
    return strip(F.regexp_replace(plain, r"[ \t]+", " "))


def sentences(text: Column) -> Column:
    """array<string>: cut at white space after . ! ? and before a capital, digit or parenthesis."""
    return F.split(text, SENTENCE_GAP)


def trimmed_sentence(sentence: Column) -> Column:
    return strip(F.regexp_replace(strip(sentence), r"^[| ]+|[| ]+$", ""))


def skipped(sentence: Column) -> Column:
    """Too short, boilerplate, a footnote or a legend."""
    tidy = clean(sentence)
    return (F.length(sentence) < 25) | F.substring(tidy, 1, 60).rlike(BOILERPLATE) | F.substring(tidy, 1, 80).rlike(FOOTNOTE) | F.substring(sentence, 1, 80).rlike(LEGEND)


def organisations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ORGANISATION), F.lit(0)), strip)


def subject_of(sentence: Column, entity: Column) -> Column:
    """The first organisation, else the document's entity, else `document`."""
    named = strip(F.regexp_extract(sentence, ORGANISATION, 0))
    return F.coalesce(F.when(named != "", named), F.when(entity != "", entity), F.lit("document"))


def attribute_of(text: Column) -> Column:
    """Up to six words that say what is measured."""
    tidy = F.regexp_replace(clean(F.regexp_replace(text, r"[₹$].*", "")), PERIOD_WORD, " ")
    words = F.regexp_extract_all(tidy, F.lit(r"[A-Za-z][A-Za-z&\-']+"), F.lit(0))
    kept = F.array_join(F.slice(F.filter(words, lambda w: ~F.lower(w).isin(ATTRIBUTE_STOP)), 1, 6), " ")
    return F.when(kept != "", kept).otherwise(F.substring(clean(text), 1, 60))


def cleaned_attribute(attribute: Column) -> Column:
    """An attribute given by a model, without periods."""
    out = attribute_of(F.regexp_replace(F.coalesce(attribute, F.lit("")), PERIOD_WORD, " "))
    return F.when(out != "", out).otherwise(F.substring(F.coalesce(F.when(attribute != "", attribute), F.lit("statement")), 1, 60))


def scope_of(sentence: Column) -> Column:
    """Qualifiers of the first line, in the order of SCOPES."""
    line = F.substring(F.split(clean(sentence), "\n")[0], 1, 160)
    found = F.array(*(strip(F.lower(F.regexp_extract(line, f"(?i){p}", 0))) for p in SCOPES))
    return F.array_join(F.filter(found, lambda x: x != ""), "; ")


def topic_anchor(attribute: Column) -> Column:
    """The words of an attribute that name its topic, in order, repeats kept."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(attribute), TOPIC_NOISE, " "), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~w.isin(TOPIC_STOP)), " ")


def topic_set(anchor: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(anchor, " "), lambda w: w != "")))


def tail_unit(raw: Column) -> Column:
    text = strip(raw)
    first, second = F.regexp_extract(text, UNIT_TAIL, 1), strip(F.regexp_extract(text, UNIT_TAIL, 2))
    return F.when(second != "", F.concat(first, F.lit(" "), second)).otherwise(first)


def cleaned_value(raw: Column) -> Column:
    """A value given by a model, without Markdown, quotes and runs of white space."""
    text = strip(F.coalesce(raw, F.lit("")))
    for mark in ("**", "__", "``"):
        wrapped = (F.length(text) > 4) & text.startswith(mark) & text.endswith(mark)
        text = F.when(wrapped, strip(F.substr(text, F.lit(3), F.greatest(F.length(text) - 4, F.lit(0))))).otherwise(text)
    quoted = (F.length(text) >= 2) & F.substring(text, 1, 1).isin('"', "'") & (F.substring(text, 1, 1) == F.substring(text, -1, 1))
    text = F.when(quoted, strip(F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))))).otherwise(text)
    return strip(F.regexp_replace(F.regexp_replace(text, r"[*`~]", ""), r"(?U)\s+", " "))


def modality_hints(markdown: Column) -> Column:
    table = F.when(F.contains(markdown, F.lit("|")) & F.contains(markdown, F.lit("---")), F.lit("table"))
    return F.array_compact(F.array(table, F.when(markdown.rlike(CHART_WORD), F.lit("chart"))))


def folio_label(markdown: Column, trim: Callable[[Column], Column] = strip) -> Column:
    """The printed page number at the foot of a page (behind which `trim` cuts off blanks), else `?`."""
    found = F.regexp_extract(trim(markdown), r"(?:^|[\r\n])[ \t]*(\d{1,4})\z", 1)
    return F.when(found != "", found).otherwise(F.lit("?"))


def page_numbers(pages: Column, count: Column) -> Column:
    """array<int> of a range list such as 1,3,5-8; without one, 0 to count - 1."""
    tokens = F.filter(F.transform(F.split(pages, ","), strip), lambda t: t != "")
    span = lambda t: F.sequence(F.split(t, "-", 2)[0].cast("int"), F.try_element_at(F.split(t, "-", 2), F.lit(-1)).cast("int"))
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(pages, F.lit("")) == "", every).otherwise(F.flatten(F.transform(tokens, span)))


def content_hash(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 16)


def content_years(text: Column) -> Column:
    """array<int> of the years 1990 to 2030 that stand by themselves."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\d.,])(19\d{2}|20[0-3]\d)(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y.between(1990, 2030))


def vintage(content_year: Column, name: Column, fallback: int = 0) -> Column:
    """The latest year of the content, else the first one of the file's name, else the fallback."""
    first = F.regexp_extract(name, r"(?<![\d.,])(19\d{2}|20[0-3]\d)(?!\d)", 1).try_cast("int")
    return F.coalesce(content_year, F.when(first.between(1990, 2030), first), F.lit(fallback))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def id_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\W+", "_")


def context_of(period: Column, scope: Column, unit: Column, doc: Column, label: Column) -> Column:
    said = F.array_join(F.filter(F.array(period, scope, unit), lambda x: x != ""), ", ")
    return F.concat(F.when(said != "", said).otherwise(F.lit("no context")), F.lit(" ["), doc, F.lit(" p."), F.coalesce(label, F.lit("None")), F.lit("]"))
