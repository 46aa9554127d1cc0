"""Page status and the predicates built on it (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U

# --- fixed values -----------------------------------------------------------
STATUSES = ["pending", "crawling", "ok", "redirect", "redirect_external", "error", "timeout", "skipped", "max_depth"]
SCANNED_STATUSES = ["ok", "redirect", "redirect_external", "error", "timeout"]
SUCCESS_STATUSES = ["ok", "redirect", "redirect_external"]
REDIRECT_STATUSES = ["redirect", "redirect_external"]
# Lower-cased message needles -> error class, first match wins.
ERROR_CLASSES = [
    (["getaddrinfo failed", "name or service not known"], "dns_not_resolved"),
    (["no address associated"], "dns_no_address"),
    (["connection refused", "errno 111"], "connection_refused"),
    (["connection reset", "errno 104"], "connection_reset"),
    (["timed out", "timeout"], "timeout"),
    (["ssl", "certificate"], "ssl"),
    (["too many redirects", "toomanyredirects"], "too_many_redirects"),
]
# Short labels of the result table (searchable text).
STATUS_LABELS = {
    "pending": "...", "crawling": ">>>", "ok": "OK", "redirect": "→", "redirect_external": "→",
    "error": "ERR", "timeout": "TO", "skipped": "IGN", "max_depth": "MAX",
}
# ---------------------------------------------------------------------------


def fetch_failed(http_status_code: Column, error_message: Column) -> Column:
    """A fetch that raised (no response): code 0 and an error message."""
    return (http_status_code == 0) & (F.coalesce(error_message, F.lit("")) != "")


def page_status(http_status_code: Column, redirect_url: Column, error_message: Column, site: Column) -> Column:
    """FLT1: status of a fetched page."""
    redirect = F.coalesce(redirect_url, F.lit(""))
    return (
        F.when(fetch_failed(http_status_code, error_message), F.lit("error"))
        .when(redirect != "", F.when(F.lower(U.url_part(redirect, "netloc")) != site, F.lit("redirect_external"))
              .otherwise(F.lit("redirect")))
        .when(http_status_code >= 400, F.lit("error"))
        .otherwise(F.lit("ok"))
    )


def redirect_status_code(history_codes: Column, final_code: Column, rendered: bool = False) -> Column:
    """FLT2: a redirected fetch reports its first hop's code, not the final
    answer's; the rendered mode cannot see hops and reports 301."""
    redirected = F.coalesce(F.size(history_codes), F.lit(0)) > 0
    first = F.element_at(history_codes, 1)
    if rendered:
        return F.when(redirected, F.lit(301)).otherwise(final_code)
    return F.when(redirected, first).otherwise(final_code)


def is_error(status: Column, http_status_code: Column) -> Column:
    """FLT3: redirects never; else code >= 400 or status error/timeout."""
    return ~status.isin(*REDIRECT_STATUSES) & ((http_status_code >= 400) | status.isin("error", "timeout"))


def is_report_error(status: Column, http_status_code: Column) -> Column:
    """FLT4: the dead-link report filter (no redirect exemption)."""
    return (http_status_code >= 400) | status.isin("error", "timeout")


def is_successful(status: Column) -> Column:
    """FLT5."""
    return status.isin(*SUCCESS_STATUSES)


def is_external_redirect(status: Column) -> Column:
    return status == "redirect_external"


def is_sitemap_html(content_type: Column) -> Column:
    """FLT6: content type contains text/html, or is empty."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return ct.contains("text/html") | (ct == "")


def error_class(error_message: Column) -> Column:
    """FLT17: class of a fetch error message ('' when there is none)."""
    msg = F.lower(F.coalesce(error_message, F.lit("")))
    out = F.when(msg == "", F.lit(""))
    for needles, name in ERROR_CLASSES:
        cond = F.lit(False)
        for n in needles:
            cond = cond | msg.contains(n)
        out = out.when(cond, F.lit(name))
    return out.otherwise(F.lit("other"))


def status_label(status: Column) -> Column:
    out = None
    for key, label in STATUS_LABELS.items():
        out = (F.when(status == key, F.lit(label)) if out is None else out.when(status == key, F.lit(label)))
    return out.otherwise(F.lit("?"))
