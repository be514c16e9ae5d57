"""Inputs of the registered queries, made of the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Publications of each subject's yearly figures; who and key stand for the subject.
FACTS = """
SELECT (d * 10 + metric) * 1000000000000 + key * 10000 + y AS seq, doc || '-' || CAST(metric AS STRING) || '-' || CAST(key AS STRING) || '-' || CAST(y AS STRING) AS fact_id, doc, who AS subject, attribute,
  CASE WHEN fact_type = 'semantic' AND y % 2 = 0 THEN 'the figure was withheld' WHEN fact_type = 'semantic' THEN 'it came to ' || raw ELSE raw END AS value_raw,
  CASE WHEN fact_type = 'semantic' THEN NULL ELSE CAST(cents AS DOUBLE) / 100 END AS value_norm, unit AS unit_norm, 'FY' || CAST(y AS STRING) AS period, scope, fact_type, 0.65 AS confidence,
  CAST(y % 7 AS INT) AS page_index, CAST(y % 7 + 1 AS STRING) AS page_label, attribute || ' was ' || raw AS quote, CASE WHEN y % 5 = 0 THEN 'chart' ELSE 'text' END AS modality, CASE WHEN y % 3 = 0 THEN 'p.png' ELSE '' END AS crop, CAST(y AS INT) AS y
FROM (SELECT *, CAST(CAST(floor(cents / 100.0) AS BIGINT) AS STRING) || '.' || lpad(CAST(cents % 100 AS STRING), 2, '0') AS raw FROM (
  SELECT figures.*, p.*, CASE cents_of WHEN 'total' THEN total WHEN 'kept' THEN kept WHEN 'rounded' THEN CAST(floor((total + 500000) / 1000000.0) AS BIGINT) * 1000000 WHEN 'units' THEN units * 100 ELSE units * 101 END AS cents
  FROM figures JOIN (VALUES (0, 0, 'annual-2001', 'total revenue', 'total', 'inr', '', 'numeric'), (1, 0, 'sibling-2001', 'revenue total', 'kept', 'inr', '', 'numeric'), (2, 0, 'restated-2003', 'total revenue', 'kept', 'inr', '', 'numeric'),
    (3, 0, 'summary-2001', 'total revenue', 'rounded', 'inr-mn', '', 'numeric'), (4, 0, 'review-2001', 'adjusted revenue', 'kept', 'inr', 'adjusted', 'numeric'), (0, 1, 'annual-2001', 'shipped units', 'units', 'shipments', '', 'numeric'),
    (1, 1, 'sibling-2001', 'shipped units', 'more units', 'shipments', '', 'numeric'), (5, 2, 'press-2002', 'revenue remarks', 'total', '', '', 'semantic'), (6, 2, 'letter-2002', 'revenue remarks', 'kept', '', '', 'semantic'))
    AS p(d, metric, doc, attribute, cents_of, unit, scope, fact_type) ON p.doc <> 'restated-2003' OR y < 1998) u) v
"""
FIGURES = """
SELECT {who} AS who, CAST({key} AS BIGINT) AS key, CAST(year(o_orderdate) AS INT) AS y, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total,
  CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3
"""
NATIONS = FIGURES.format(who="n_name", key="n_nationkey")
CUSTOMERS = FIGURES.format(who="c_name", key="c_custkey")


def with_figures(figures: str, query: str = FACTS) -> str:
    return f"WITH figures AS ({figures}) {query}"


#: Texts with figures in them, one a customer and year.
SENTENCES = """
SELECT 'report-' || CAST(key % 40 AS STRING) AS doc, CAST(y % 7 AS INT) AS page_index, key, y, cents,
  CASE key % 5 WHEN 0 THEN 'Total revenue of Acme Bank was Rs ' || raw || ' Cr in FY' || CAST(y AS STRING) || ' on a consolidated basis.'
    WHEN 1 THEN 'The adjusted margin improved to ' || CAST(cents % 90 + 10 AS STRING) || '.5% in Q' || CAST(cents % 4 + 1 AS STRING) || ' FY' || CAST(y % 100 AS STRING) || ' for the group.'
    WHEN 2 THEN 'Shipments reached ' || CAST(cents % 900 + 100 AS STRING) || ' Mn tons during the year ended 31 March ' || CAST(y AS STRING) || ' in total.'
    WHEN 3 THEN 'Contents of the annual report, page ' || CAST(cents % 90 AS STRING) || ' and following'
    ELSE 'Ms Rao was appointed director of Delta Commission after the long review' END AS text
FROM (SELECT *, total AS cents, CAST(CAST(floor(total / 100.0) AS BIGINT) AS STRING) || '.' || lpad(CAST(total % 100 AS STRING), 2, '0') AS raw FROM figures) f
"""
#: Numbers, units, hints and periods as they are written.
WRITTEN = """
SELECT o_orderkey AS k,
  CASE o_orderkey % 6 WHEN 0 THEN '(' || CAST(o_custkey AS STRING) || ')' WHEN 1 THEN CAST(o_custkey AS STRING) || ',' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') WHEN 2 THEN 'none' WHEN 3 THEN CAST(o_orderkey % 1000 AS STRING) || '.25 %' WHEN 4 THEN '-' || CAST(o_custkey AS STRING) ELSE ' ' || CAST(o_custkey AS STRING) || '.5 ' END AS raw,
  CASE o_orderkey % 13 WHEN 0 THEN 'Cr' WHEN 1 THEN 'crore' WHEN 2 THEN 'Mn' WHEN 3 THEN 'billion' WHEN 4 THEN '%' WHEN 5 THEN 'per cent' WHEN 6 THEN '' WHEN 7 THEN 'mn tons' WHEN 8 THEN 'Million shipments' WHEN 9 THEN 'widgets' WHEN 10 THEN 'lakhs' WHEN 11 THEN 't' ELSE 'Bn' END AS unit,
  CASE o_orderkey % 8 WHEN 0 THEN 'about $ 5' WHEN 1 THEN 'INR 7 crore' WHEN 2 THEN 'moved shipments' WHEN 3 THEN 'of tons' WHEN 4 THEN '' WHEN 5 THEN 'rs 3 million' WHEN 6 THEN 'usd 4 bn' ELSE 'to people' END AS hint,
  CASE o_orderkey % 9 WHEN 0 THEN 'in Q' || CAST(o_orderkey % 4 + 1 AS STRING) || ' FY' || CAST(o_orderkey % 90 + 10 AS STRING) WHEN 1 THEN 'FY2023-24' WHEN 2 THEN 'during FY ' || CAST(o_orderkey % 90 + 10 AS STRING) WHEN 3 THEN 'Fiscal 2022 was' WHEN 4 THEN 'nine months ended 31 December 2021' WHEN 5 THEN 'year ended 31 March 2020' WHEN 6 THEN '2025-26' WHEN 7 THEN 'fy' || CAST(2000 + o_orderkey % 30 AS STRING) ELSE 'no date' END AS said
FROM orders
"""


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Registers the given tables that a text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    views(spark, sf_dir, text)
    return spark.sql(text)


def facts(spark: SparkSession, sf_dir: str, figures: str = NATIONS) -> DataFrame:
    rows = sql(spark, sf_dir, with_figures(figures))
    flags = F.array_compact(F.array(F.when(F.col("y") % 4 == 0, F.lit("no-period")), F.when(F.col("modality") == "chart", F.lit("chart-sourced"))))
    return rows.withColumn("flags", flags)


def documents(found: DataFrame) -> DataFrame:
    """doc and vintage of facts' documents."""
    return dated(found.select("doc").distinct())


def dated(rows: DataFrame) -> DataFrame:
    """rows with the vintage of their document."""
    return rows.withColumn("vintage", F.substring("doc", -4, 4).cast("int"))
