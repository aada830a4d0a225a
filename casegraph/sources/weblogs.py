"""Web-server log text: access and error lines, and the from-date filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import exprs as x

c = F.col


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("log_name"), c("value").alias("line")
    )


def parse_access(lines: DataFrame) -> DataFrame:
    """Combined-format lines as columns; other lines are dropped."""

    def part(index: int) -> Column:
        return F.regexp_extract("line", fv.ACCESS_LINE, index)

    return lines.where(c("line").rlike(fv.ACCESS_LINE)).select(
        *[n for n in lines.columns if n != "line"],
        part(1).alias("client_ip"),
        part(2).alias("timestamp"),
        part(3).alias("method"),
        part(4).alias("path"),
        part(5).cast("int").alias("status_code"),
        part(6).try_cast("bigint").alias("bytes"),
        part(7).alias("referer"),
        part(8).alias("user_agent"),
    )


def parse_error(lines: DataFrame) -> DataFrame:
    """Error-log lines as columns; the client part is optional."""

    def part(index: int) -> Column:
        return F.regexp_extract("line", fv.ERROR_LINE, index)

    return lines.where(c("line").rlike(fv.ERROR_LINE)).select(
        *[n for n in lines.columns if n != "line"],
        part(1).alias("timestamp"),
        part(2).alias("level"),
        part(3).alias("module"),
        x.non_empty(part(4)).alias("client"),
        part(5).alias("message"),
    )


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access(_lines(spark, path))


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_error(_lines(spark, path))


def line_date(line: Column, log_type: str) -> Column:
    """Date inside a line, in the log's own clock; null if there is none."""
    if log_type == "access":
        return F.try_to_timestamp(
            x.non_empty(F.regexp_extract(line, fv.ACCESS_LINE_DATE, 1)), F.lit("dd/MMM/yyyy:HH:mm:ss")
        )
    joined = F.concat_ws(
        " ",
        F.regexp_extract(line, fv.ERROR_LINE_DATE, 1),
        F.regexp_extract(line, fv.ERROR_LINE_DATE, 2),
    )
    return F.try_to_timestamp(x.non_empty(F.trim(joined)), F.lit("MMM d HH:mm:ss yyyy"))


def lines_since(lines: DataFrame, log_type: str, since: Column) -> DataFrame:
    """Lines dated ``since`` or later; undated lines are dropped."""
    return lines.where(line_date(c("line"), log_type) >= since)
