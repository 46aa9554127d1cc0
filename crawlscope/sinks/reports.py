"""Reports: dead links with referrers, tracker tables, JSON documents, forms
list and source snippets. Every report is a row set (one line or one JSON
object per dead link), written with Spark's text writer; no report collects a
site's rows into one record, not even the JSON document of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import status as S
from ..operators.ordering import sequence_within_groups
from .sitemap_xml import named_files

# --- fixed values -----------------------------------------------------------
TRACKER_TITLES = ["URL", "HTTP", "Error", "Referring pages"]
# ---------------------------------------------------------------------------

REFERRER_TYPE = "array<struct<url:string,link_text:string>>"


def dead_links(results: DataFrame) -> DataFrame:
    """J10 input: FLT4 rows (code >= 400 or status error/timeout)."""
    return results.where(S.is_report_error(F.col("status"), F.col("http_status_code")))


def _md_cell(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\r"), F.lit("")), F.lit("\n"),
                     F.lit("<br>"))


def _refs(col: str = "referring_pages") -> Column:
    return F.coalesce(F.col(col), F.array().cast(REFERRER_TYPE))


def markdown_rows(errors: DataFrame) -> DataFrame:
    """SNK5: one Markdown table row per dead link (rows with referrers)."""
    code = F.when(F.col("http_status_code") != 0, F.col("http_status_code").cast("string")).otherwise(F.lit("-"))
    refs = F.transform(_refs(), lambda r: F.when(
        H.strip(F.coalesce(r["link_text"], F.lit(""))) != "",
        F.concat(F.lit("["), _md_cell(H.strip(r["link_text"])), F.lit("]("), r["url"], F.lit(")")),
    ).otherwise(_md_cell(r["url"])))
    referring = F.when(F.size(_refs()) > 0, F.array_join(refs, "<br>")).otherwise(F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", _md_cell(F.col("url")), code, F.col("status"), referring),
                    F.lit(" |"))
    return errors.select("site", "url", line.alias("line"))


def markdown_header() -> list[str]:
    return ["| " + " | ".join(TRACKER_TITLES) + " |", "| " + " | ".join("---" for _ in TRACKER_TITLES) + " |"]


def wiki_rows(errors: DataFrame) -> DataFrame:
    """SNK6: one wiki-markup table row per dead link."""
    code = F.when(F.col("http_status_code") != 0, F.col("http_status_code").cast("string")).otherwise(F.lit("-"))
    refs = F.transform(_refs(), lambda r: F.when(
        H.strip(F.coalesce(r["link_text"], F.lit(""))) != "",
        F.concat(F.lit('"'), H.strip(r["link_text"]), F.lit('" ['), r["url"], F.lit("]")),
    ).otherwise(F.concat(F.lit("["), r["url"], F.lit("]"))))
    referring = F.when(F.size(_refs()) > 0, F.array_join(refs, " \\\\ ")).otherwise(F.lit("-"))
    line = F.concat(F.lit("|["), F.col("url"), F.lit("]|"), code, F.lit("|"), F.col("status"), F.lit("|"), referring,
                    F.lit("|"))
    return errors.select("site", "url", line.alias("line"))


def wiki_header() -> str:
    return "||" + "||".join(TRACKER_TITLES) + "||"


def error_report_header(counters: DataFrame, runs: DataFrame, generated_at: str) -> DataFrame:
    """SNK3 header per site: generated_at, start_url and the summary (counters
    as AGG2 rebuilds them, and the run's duration). ``runs`` is (site,
    start_url, duration)."""
    c = counters.join(runs, "site", "left")
    summary = F.struct("total_crawled", "total_discovered", "total_errors", "total_2xx", "total_3xx", "total_4xx", "total_5xx",
                       F.coalesce("duration", F.lit("0s")).alias("duration"))
    return c.select("site", F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.coalesce("start_url", F.lit("")).alias("start_url"),
                                               summary.alias("summary"))).alias("json"))


def error_report_entries(errors: DataFrame) -> DataFrame:
    """SNK3: one JSON object per dead link (url, http_status, status, error_message, referring_pages)."""
    return errors.select("site", "url", F.to_json(F.struct(
        "url", F.col("http_status_code").alias("http_status"), "status", "error_message", _refs().alias("referring_pages"))).alias("json"))


def document_lines(headers: DataFrame, entries: DataFrame, name: str, order: str = "url") -> DataFrame:
    """One JSON document a site as numbered lines (site, seq, line): its header
    object with the list ``name`` of the site's entries (``json``) in ``order``.
    Line 0 opens the document and the list, each entry is a line, the last line
    closes both; entries are numbered by range, so no site is gathered to put a
    comma between its entries."""
    numbered = sequence_within_groups(entries, ["site"], [order, "json"], out_col="seq")
    body = numbered.select("site", "seq", F.concat(F.when(F.col("seq") > 1, ",").otherwise(""), "json").alias("line"))
    inner = F.regexp_extract("json", r"(?s)^\{(.*)\}$", 1)
    opened = F.concat(F.lit("{"), inner, F.when(inner != "", ",").otherwise(""), F.lit(f'"{name}":['))
    first = headers.select("site", F.lit(0).cast("bigint").alias("seq"), opened.alias("line"))
    last = headers.select("site", F.lit(2**62).cast("bigint").alias("seq"), F.lit("]}").alias("line"))
    return first.unionByName(body).unionByName(last)


def write_documents(lines: DataFrame, path: str, name: str) -> None:
    """``path/site=.../name`` for every site, its lines in order of seq. A file
    has one writer, so a site's lines stream through one task, sorted on disk
    if need be; none is collected. Files get their names by one rename each."""
    spark = lines.sparkSession
    scratch = f"{path}/_writing"
    (lines.withColumn("file", F.lit(name)).repartition("site").sortWithinPartitions("site", "file", "seq").drop("seq")
     .write.mode("overwrite").partitionBy("site", "file").text(f"{scratch}/documents"))
    named_files(spark, scratch, path)


def write_error_report(errors: DataFrame, counters: DataFrame, runs: DataFrame, generated_at: str, path: str) -> None:
    """SNK3: ``error_report.json`` of every site of counters."""
    write_documents(document_lines(error_report_header(counters, runs, generated_at), error_report_entries(errors), "dead_links"), path, "error_report.json")


def write_forms_report(results: DataFrame, path: str) -> None:
    """SNK4: ``forms.json`` of every site: the sorted URLs of its pages with a form and code 200."""
    entries = forms_rows(results).select("site", "url", F.regexp_extract(F.to_json(F.array("url")), r"(?s)^\[(.*)\]$", 1).alias("json"))
    headers = results.select("site").distinct().select("site", F.lit("{}").alias("json"))
    write_documents(document_lines(headers, entries, "urls"), path, "forms.json")


def read_documents(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """(site, document) of the JSON files written by ``write_documents``, one row a file."""
    raw = spark.read.option("pathGlobFilter", name).option("basePath", path).text(f"{path}/site=*", wholetext=True)
    return raw.select("site", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("document"))


def forms_rows(results: DataFrame) -> DataFrame:
    """SNK4: URLs of pages with a form and code 200 (sorted when written)."""
    return results.where(F.col("has_form") & (F.col("http_status_code") == 200)).select("site", "url")


def snippet(lines: Column, first_line: Column, line: Column, source_url: Column, target_url: Column) -> Column:
    """SNK12: the lines around a hit (``locate_in_source`` with context), ``>> ``
    marker and a 5-wide line number; a "not found" text when the line is 0."""
    body = F.array_join(F.transform(lines, lambda text, i: F.concat(
        F.when(first_line + i == line, F.lit(">> ")).otherwise(F.lit("   ")), F.lpad((first_line + i).cast("string"), 5, " "), F.lit(" | "),
        text)), "\n")
    head = F.concat(F.lit("Source: "), source_url, F.lit("\nBroken link: "), target_url, F.lit("\n"))
    return F.when(line > 0, F.concat(head, F.lit("Line "), line.cast("string"), F.lit(":\n\n"), body, F.lit("\n"))).otherwise(
        F.concat(head, F.lit("(link not found in the HTML)\n")))


def write_lines_per_site(lines: DataFrame, path: str, header: list[str] | None = None, order: str = "url") -> None:
    """Write one text file per site: optional header lines, then the rows in
    ``order``. Rows are range-sorted by (site, key) so no site is gathered in
    the driver; Spark's text writer puts each site's rows in its own folder."""
    rows = lines.select("site", F.lit(1).alias("_k"), F.col(order).alias("_o"), "line")
    if header:
        sites = lines.select("site").distinct()
        hdr = None
        for i, text in enumerate(header):
            h = sites.select("site", F.lit(0).alias("_k"), F.lpad(F.lit(str(i)), 8, "0").alias("_o"),
                             F.lit(text).alias("line"))
            hdr = h if hdr is None else hdr.unionByName(h)
        rows = hdr.unionByName(rows)
    (rows.repartitionByRange("site", "_k", "_o").sortWithinPartitions("site", "_k", "_o").drop("_k", "_o")
     .write.mode("overwrite").partitionBy("site").text(path))


def write_markdown_table(errors: DataFrame, path: str) -> None:
    """SNK5 file: header, separator and one row per dead link, per site; no
    file for a site without errors."""
    write_lines_per_site(markdown_rows(errors), path, markdown_header())


def write_wiki_table(errors: DataFrame, path: str) -> None:
    """SNK6 file."""
    write_lines_per_site(wiki_rows(errors), path, [wiki_header()])
