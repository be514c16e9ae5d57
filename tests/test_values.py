import pytest
from pyspark.sql import functions as F

from factloom.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,value,flags", [("(404)", -404.0, ["paren-negative"]), ("8,142", 8142.0, []), (" 12.5 ", 12.5, []), ("n/a", None, ["unparseable-number"]), ("-3", -3.0, []), ("", None, ["unparseable-number"])])
def test_parse_number(spark, raw, value, flags):
    got = one(spark, V.parse_number(F.lit(raw)))
    assert (got["value"], got["flags"]) == (value, flags)


@pytest.mark.parametrize("unit,hint,name", [("bn", "$ 5", "usd-bn"), ("Cr", "", "inr-cr"), ("crore", "", "cr"), ("", "Rs 5 crore", "inr-cr"), ("", "plain", "qty"), ("Mn", "moved shipments", "mn-shipments"), ("mn tons", "", "mn-tons"), ("per cent", "", "percent"), ("", "years", "inr"), ("widgets", "", "widgets")])
def test_canonical_unit(spark, unit, hint, name):
    assert one(spark, V.canonical_unit(F.lit(unit), F.lit(hint))) == name


@pytest.mark.parametrize("said,period", [("Q4 FY24", "Q4-FY2024"), ("FY2023-24", "FY2024"), ("FY98", "FY1998"), ("Fiscal 2022", "FY2022"), ("nine months ended 31 December 2021", "9M-2021"), ("year ended 31 March 2020", "FY20-ish"), ("2025-26", "")])
def test_canonical_period(spark, said, period):
    assert one(spark, V.canonical_period(F.lit(said)))["period"] == period


def test_percent_in_value_wins(spark):
    got = one(spark, V.normalize_value(F.lit("31%"), F.lit("Cr"), F.lit("₹ in FY24")))
    assert (got["value_norm"], got["unit_norm"], got["period"]) == (31.0, "%", "FY2024") and "pct-forced" in got["flags"]


def test_percent_and_two_words_compare(spark):
    assert one(spark, V.same_dimension(F.lit("percent"), F.lit("%")))
    assert not one(spark, V.same_dimension(F.lit("usd-bn"), F.lit("inr-cr")))
