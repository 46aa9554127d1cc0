"""All registered queries and their oracle SQL (importing registers them)."""

from __future__ import annotations

from . import catalog
from . import queries_files, queries_live, queries_markup, queries_reports, queries_runs, queries_scan, queries_sitemap  # noqa: F401

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE
