"""Registered queries: stored-log scans (SRC1, SRC9) and FLT2."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import status as S
from ..operators import files as FL
from ..session import ensure_checkpoint_dir
from ..sources import crawl_log as CL
from ..sources import fixtures as FX
from .catalog import ORACLE, SQL_F2, query, with_


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_raw_fetch_log(spark, d) -> str:
    """Store the F2 fetches the way a crawler would log them: the final
    answer's code plus the codes of the redirect hops (two hops for every
    sixth page), partitioned by site."""
    f = FX.fetch_log(spark, d)
    i = F.col("page_id")
    redirected = F.col("redirect_url") != ""
    hops = F.when(redirected & (i % 6 == 0), F.array(F.lit(301), F.lit(302))).when(
        redirected, F.array(F.lit(301))).otherwise(F.array().cast("array<int>"))
    raw = f.select(
        "site", "site_scheme", "url",
        F.when(redirected, F.lit(200)).otherwise(F.col("http_status_code")).cast("int").alias("http_status_code"),
        hops.alias("history_codes"), "redirect_url", "content_type", "error_message", "load_time_ms", "page_size",
        "last_modified", "response_headers", "html",
    )
    path = _scratch(spark, "fetch-log")
    raw.write.mode("overwrite").partitionBy("site").parquet(path)
    return path


@query("src1_fetch_log_scan", with_(SQL_F2) + """
SELECT url, http_status_code, CASE WHEN redirect_url <> '' THEN 301 ELSE http_status_code END AS rendered_status_code,
  content_type FROM f2""")
def src1_fetch_log_scan(spark, d):
    """SRC1 + FLT2: scan a stored fetch log with an explicit schema (site
    partition pruned, only four columns read) and report each page's code
    as the first redirect hop's code (static mode) or 301 (rendered mode)."""
    log = CL.read_fetch_log(spark, write_raw_fetch_log(spark, d))
    log = log.where(F.col("site") == FX.SITE)
    return log.select(
        "url", S.redirect_status_code(F.col("history_codes"), F.col("http_status_code")).alias("http_status_code"),
        S.redirect_status_code(F.col("history_codes"), F.col("http_status_code"), rendered=True)
        .alias("rendered_status_code"),
        "content_type",
    )


@query("src9_file_check_log")
def src9_file_check_log(spark, d):
    """SRC9 + J9: logged HEAD/GET answers stored as JSON lines, read back with
    an explicit schema and merged (GET replaces HEAD on 405/501)."""
    path = _scratch(spark, "file-checks")
    FX.file_check_answers(spark, d).write.mode("overwrite").json(path)
    return FL.merge_head_get(CL.read_file_checks(spark, path))


ORACLE["src9_file_check_log"] = ORACLE["j9_head_get"]
