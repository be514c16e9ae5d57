"""Numbers, units and periods as columns: dirty text in, comparable values out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of each family and how many base units one of them is.
FAMILIES = {
    "money-inr": {"inr": 1, "rs": 1, "rupee": 1, "rupees": 1, "inr-cr": 1e7, "cr": 1e7, "crore": 1e7, "crores": 1e7, "inr-lakh": 1e5, "lakh": 1e5, "lakhs": 1e5, "inr-mn": 1e6, "mn-inr": 1e6, "million-inr": 1e6, "inr-bn": 1e9, "bn-inr": 1e9},
    "money-usd": {"usd": 1, "usd-mn": 1e6, "usd-bn": 1e9},
    "qty": {"qty": 1},
    "qty-scale": {"mn": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9},
    "qty-k": {"k": 1e3, "thousand": 1e3},
    "mass": {"tons": 1, "tonnes": 1, "mn-tons": 1e6},
    "count": {"shipments": 1, "mn-shipments": 1e6, "bn-shipments": 1e9},
    "people": {"people": 1, "employees": 1},
    "days": {"days": 1},
    "pct": {"%": 1, "percent": 1, "per cent": 1},
}
# What a unit as written is called; written units that aren't here but are listed above keep their name.
ALIASES = {"cr": "inr-cr", "crs": "inr-cr", "crore": "cr", "crores": "cr", "lakh": "inr-lakh", "lakhs": "inr-lakh", "%": "%", "percent": "percent", "per cent": "percent", "mn": "mn", "million": "million", "bn": "bn", "billion": "billion", "tons": "tons", "tonnes": "tons", "t": "tons", "shipments": "shipments", "employees": "employees", "people": "people", "days": "days", "k": "k", "thousand": "thousand", "million-inr": "inr-mn", "inr million": "inr-mn"}
# Nouns that make a number a count rather than money.
COUNT_NOUNS = ["shipment", "ton", "employee", "people", "branch", "order", "parcel"]
TOLERANCE = 0.02


def bind(value: Column, f) -> Column:
    """f(value), with value worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(_map(values), key)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _any_of(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def parse_number(raw: Column) -> Column:
    """struct<value double, flags array<string>>. A number in parentheses is negative."""
    text = strip(raw)
    inside = text.startswith("(") & text.endswith(")")
    found = F.regexp_extract(F.replace(F.when(inside, F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    number = F.when(found != "", found.try_cast("double"))
    flags = F.array_compact(F.array(F.when(inside, F.lit("paren-negative")), F.when(found == "", F.lit("unparseable-number"))))
    return F.struct(F.when(inside, -F.abs(number)).otherwise(number).alias("value"), flags.alias("flags"))


def number_part(raw: Column) -> Column:
    """The first number of a raw value, with parentheses that stand right around it."""
    pattern = r"\(?\s*[\d,]+(?:\.\d+)?\s*\)?"
    return F.when(raw.rlike(pattern), F.regexp_extract(raw, pattern, 0)).otherwise(raw)


def canonical_unit(unit: Column, hint: Column) -> Column:
    """Canonical name of a unit as written, given the text around it.

    The hints are searched as plain substrings, so that "years" counts as a mention of rupees ("rs") and "order" as
    one of orders: that is the behaviour to match.
    """
    written = F.regexp_replace(F.replace(F.replace(F.lower(strip(unit)), F.lit("₹"), F.lit("")), F.lit("rs."), F.lit("rs")), r"^[ .]+|[ .]+$", "")
    around = F.lower(hint)
    usd = _any_of(around, ["$", "usd", "dollar"])
    money = usd | _any_of(around, ["₹", "rs", "inr"])
    million, billion = around.rlike(r"\bmn\b|\bmil\b|million"), around.rlike(r"\bbn\b|billion")
    currency = F.when(usd, F.lit("usd")).otherwise(F.lit("inr"))
    bare = (
        F.when(money & F.contains(around, F.lit("cr")), F.lit("inr-cr"))
        .when(money & F.contains(around, F.lit("lakh")), F.lit("inr-lakh"))
        .when(money & million, F.concat(currency, F.lit("-mn")))
        .when(money & billion, F.concat(currency, F.lit("-bn")))
        .when(money, currency)
        .otherwise(F.lit("qty"))
    )
    compound = F.regexp_extract(written, r"^(?:mn|million|bn|billion)\s+(tons?|tonnes?|shipments?)$", 1)
    other = (
        F.when(compound.startswith("ship"), F.when(written.rlike("^m"), F.lit("mn-shipments")).otherwise(F.lit("bn-shipments")))
        .when(compound != "", F.lit("mn-tons"))
        .otherwise(written)
    )
    known = _looked_up(ALIASES, written)
    shipments, tons = F.contains(around, F.lit("shipment")), around.rlike(r"\btons?\b|\btonnes?\b")
    cash = money & ~_any_of(around, COUNT_NOUNS)
    scaled = (
        F.when(known.isin("mn", "million"), F.when(shipments, F.lit("mn-shipments")).when(tons, F.lit("mn-tons")).when(cash, F.concat(currency, F.lit("-mn"))).otherwise(known))
        .when(known.isin("bn", "billion"), F.when(shipments, F.lit("bn-shipments")).when(tons, F.lit("bn")).when(cash, F.concat(currency, F.lit("-bn"))).otherwise(known))
        .otherwise(known)
    )
    return F.when(written == "", bare).when(known.isNull(), other).otherwise(scaled)


def to_base(value: Column, unit: Column) -> Column:
    """In base units; null for a unit without a multiplier."""
    return value * _looked_up({u: float(m) for units in FAMILIES.values() for u, m in units.items()}, unit)


def family(unit: Column) -> Column:
    """The family of comparable units; null if the unit isn't known."""
    return _looked_up({u: f for f, units in FAMILIES.items() for u in units}, unit)


def same_dimension(a: Column, b: Column) -> Column:
    return F.coalesce(family(a), a) == F.coalesce(family(b), b)


def cross_dimension(a: Column, b: Column) -> Column:
    """Both units are known and can't be compared."""
    return F.coalesce(family(a) != family(b), F.lit(False))


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) <= tolerance


def four_digit_year(year: Column) -> Column:
    text = strip(year)
    number = text.try_cast("int")
    return F.when(F.length(text) == 4, text).otherwise(F.concat(F.when(number < 50, F.lit("20")).otherwise(F.lit("19")), F.lpad(number.cast("string"), 2, "0")))


# Period patterns in the order in which they are tried; what is shown, the groups used and the flag.
QUARTER = r"(?i)\bQ([1-4])\s*FY\s?(\d{2,4})\b"
FISCAL_RANGE = r"(?i)\bFY\s?(\d{4})\s*[-–]\s*(\d{2,4})\b"
FISCAL_SHORT = r"(?i)\bFY\s?(\d{2,4})\b"
FISCAL_LONG = r"(?i)\bFiscal\s?(?:year\s?ended[^.]{0,30}?)?(20\d{2})\b"
NINE_MONTHS = r"(?i)nine months?(?: period)? ended[^.]{0,40}?(20\d{2})"
YEAR_ENDED = r"(?i)year ended[^.]{0,40}?(\d{1,2}\s+\w+\s+)?(20\d{2})"


def canonical_period(text: Column) -> Column:
    """struct<period string, flags array<string>>; the period is empty where none is found."""
    got = lambda pattern, k: F.regexp_extract(text, pattern, k)
    found = lambda period, *flags: F.struct(period.alias("period"), F.array(*map(F.lit, flags)).cast("array<string>").alias("flags"))
    return (
        F.when(text.rlike(QUARTER), found(F.concat(F.lit("Q"), got(QUARTER, 1), F.lit("-FY"), four_digit_year(got(QUARTER, 2)))))
        .when(text.rlike(FISCAL_RANGE), found(F.concat(F.lit("FY"), four_digit_year(got(FISCAL_RANGE, 2))), "fy-range"))
        .when(text.rlike(FISCAL_SHORT), found(F.concat(F.lit("FY"), four_digit_year(got(FISCAL_SHORT, 1)))))
        .when(text.rlike(FISCAL_LONG), found(F.concat(F.lit("FY"), got(FISCAL_LONG, 1)), "fiscal-year"))
        .when(text.rlike(NINE_MONTHS), found(F.concat(F.lit("9M-"), got(NINE_MONTHS, 1)), "nine-months"))
        .when(text.rlike(YEAR_ENDED), found(F.concat(F.lit("FY"), F.substring(got(YEAR_ENDED, 2), 3, 2), F.lit("-ish")), "year-ended-approx"))
        .otherwise(found(F.lit(""), "no-period"))
    )


def normalize_value(value_raw: Column, unit_raw: Column, context: Column) -> Column:
    """struct<value_norm, unit_norm, period, flags>. A % in the value itself beats any other unit."""
    number = parse_number(value_raw)
    unit = F.lower(strip(F.coalesce(unit_raw, F.lit(""))))
    forced = F.contains(value_raw, F.lit("%")) & ~unit.isin("%", "percent")
    name = canonical_unit(F.when(forced, F.lit("%")).otherwise(unit), F.concat(value_raw, F.lit(" "), context))
    period = canonical_period(context)
    flags = F.concat(number["flags"], F.when(forced, F.array(F.lit("pct-forced"))).otherwise(F.array().cast("array<string>")), period["flags"])
    return F.struct(to_base(number["value"], name).alias("value_norm"), name.alias("unit_norm"), period["period"].alias("period"), flags.alias("flags"))


def heuristic_confidence(period: Column, unit: Column, modality: Column) -> Column:
    points = F.lit(55) + F.when(period != "", 10).otherwise(0) + F.when(unit != "qty", 10).otherwise(0) - F.when(modality == "chart", 10).otherwise(0)
    return F.least(points, F.lit(80)) / F.lit(100.0)


def model_confidence(confidence: Column, modality: Column) -> Column:
    given = F.coalesce(F.when(confidence != 0, confidence), F.lit(0.6)).cast("double")
    return F.bround(F.when(modality.isin("chart", "infographic"), F.least(given, F.lit(0.65))).otherwise(given), 2)
