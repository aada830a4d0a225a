"""The rule catalogue as a small dimension table (46 rows, so broadcasting it is safe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegraph import fixed_values as fv

CATALOG_DDL = (
    "rule_id STRING, rule_name STRING, rule_type STRING, severity STRING, confidence DOUBLE, "
    "technique_id STRING, technique_name STRING, tactic STRING, kill_chain_phase STRING, "
    "tags ARRAY<STRING>, source STRING, rule_no INT"
)

RULE_NUMBER = {row[0]: number for number, row in enumerate(fv.RULE_CATALOG)}


def rule_catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (*row[:9], list(row[9]), row[10], RULE_NUMBER[row[0]]) for row in fv.RULE_CATALOG
    ]
    return spark.createDataFrame(rows, CATALOG_DDL)
