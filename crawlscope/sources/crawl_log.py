"""Readers for stored crawl data with explicit schemas (no inference).

``read_fetch_log`` (SRC1) and ``read_file_checks`` (SRC9) read Parquet or
JSON lines; filters and column selections on the result reach the scan
(``PushedFilters`` / ``ReadSchema`` in the plan), and a log partitioned by
``site`` is pruned by site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FETCH_LOG_SCHEMA = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("site_scheme", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("http_status_code", T.IntegerType()),
    T.StructField("history_codes", T.ArrayType(T.IntegerType())),
    T.StructField("redirect_url", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("load_time_ms", T.DoubleType()),
    T.StructField("page_size", T.LongType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("response_headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("html", T.StringType()),
])

FILE_CHECK_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_length", T.StringType()),
    T.StructField("content_range", T.StringType()),
])


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC1: a stored fetch log (one row per fetched URL) with a fixed schema."""
    return spark.read.format(fmt).schema(FETCH_LOG_SCHEMA).load(path)


def read_file_checks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """SRC9: logged HEAD / ranged-GET answers of file URLs."""
    return spark.read.format(fmt).schema(FILE_CHECK_SCHEMA).load(path)
