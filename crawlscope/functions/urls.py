"""URL column expressions (normalise, resolve, host tests, file tests).

Every function takes and returns ``Column`` objects built from
``pyspark.sql.functions`` only, so they stay inside whole-stage codegen and
can be used in ``select``/``filter``/join keys on any DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters that stay literal when a path is re-encoded (besides letters,
# digits and "_.-~"); the query additionally keeps "?".
PATH_SAFE = "/:@!$&'*+,;="
QUERY_SAFE = PATH_SAFE + "?"

# Host prefixes that name another deployment environment of the same site.
ENVIRONMENT_PREFIXES = ["test", "dev", "stage", "staging", "qa", "int", "preview", "prod", "produktion", "live"]
# Prefixes that are the production site written differently.
NEUTRAL_PREFIXES = ["www"]

# File endings that are never crawled as pages (recorded as file links).
FILE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".bmp",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".gz", ".tar", ".7z",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm",
    ".css", ".js", ".json", ".xml",
    ".woff", ".woff2", ".ttf", ".eot",
    ".exe", ".dmg", ".apk", ".msi",
]
# ---------------------------------------------------------------------------

# RFC 3986 appendix B, with the scheme restricted to valid scheme characters.
URL_PARTS_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Path split into (path without params, params) the way urlparse does it:
# params start at the first ";" after the last "/".
PATH_PARAMS_RE = r"^((?:.*/)?[^/;]*)(?:;(.*))?$"
# Both in one pattern: scheme, netloc, path without params, params, query.
URL_NORM_RE = (r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?((?:[^?#]*/)?[^/;?#]*)(?:;([^?#]*))?"
               r"(?:\?([^#]*))?(?:#.*)?$")

_HEX = "0123456789ABCDEF"


def _lit(value) -> Column:
    return F.lit(value)


def url_part(url: Column, part: str) -> Column:
    """One component of a URL: scheme, netloc, path, query or fragment (raw)."""
    group = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(url, URL_PARTS_RE, group)


def _percent(ch: str) -> str:
    return "%" + "".join(_HEX[b >> 4] + _HEX[b & 15] for b in ch.encode())


def unquote(text: Column) -> Column:
    """Percent-decode like ``urllib.parse.unquote``: "+" stays "+", a lone "%"
    that does not start an escape stays literal, bad UTF-8 becomes U+FFFD."""
    guarded = F.regexp_replace(F.regexp_replace(text, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(guarded)


def quote(text: Column, safe: str) -> Column:
    """Percent-encode like ``urllib.parse.quote(text, safe)`` (UTF-8, upper hex)."""
    out = F.replace(F.url_encode(text), _lit("+"), _lit("%20"))
    out = F.replace(out, _lit("%7E"), _lit("~"))
    for ch in safe:
        if ch == "*":  # never encoded by url_encode
            continue
        out = F.replace(out, _lit(_percent(ch)), _lit(ch))
    return out


def _prefixed(prefix: str, value: Column) -> Column:
    """``prefix + value``, or '' when ``value`` is empty (value used once)."""
    pattern = "^" + "".join("\\" + c for c in prefix) + "$"
    return F.regexp_replace(F.concat(_lit(prefix), value), pattern, "")


def _normalized(url: Column, scheme: Column | None = None) -> Column:
    """``urlunparse`` of the normalised parts; every part is extracted once,
    so the expression tree stays linear in the number of parts."""
    def g(i: int) -> Column:
        return F.regexp_extract(url, URL_NORM_RE, i)

    sch = F.lower(g(1)) if scheme is None else scheme
    qpath = F.regexp_replace(quote(unquote(g(3)), PATH_SAFE), "^$", "/")
    return F.concat(
        F.regexp_replace(F.concat(sch, _lit(":")), "^:$", ""),
        _prefixed("//", F.lower(g(2))),
        qpath,
        _prefixed(";", g(4)),
        _prefixed("?", quote(unquote(g(5)), QUERY_SAFE)),
    )


def normalize(url: Column) -> Column:
    """URL1: lower-case scheme and host, re-encode path and query, empty path
    becomes "/", ";params" kept, fragment dropped. Path case is kept."""
    return _normalized(url)


def full_normalize(url: Column, site_netloc: Column, site_scheme: Column) -> Column:
    """URL2: ``normalize`` and, for links on the site's own host, the site's scheme."""
    scheme = F.lower(F.regexp_extract(url, URL_NORM_RE, 1))
    netloc = F.lower(F.regexp_extract(url, URL_NORM_RE, 2))
    chosen = F.when((scheme != site_scheme) & (netloc == site_netloc), site_scheme).otherwise(scheme)
    return _normalized(url, chosen)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def _remove_dot_segments(path: Column) -> Column:
    """Dot-segment removal as ``urljoin`` does it (".." may pop the root)."""
    segments = F.split(path, "/")
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, _lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.array_append(acc, seg)),
    )
    last = F.element_at(segments, -1)
    resolved = F.when(last.isin(".", ".."), F.array_append(resolved, _lit(""))).otherwise(resolved)
    joined = F.array_join(resolved, "/")
    # an empty result is "/", and a popped root comes back (urlunparse adds it)
    return F.regexp_replace(F.regexp_replace(joined, "^$", "/"), "^([^/])", "/$1")


_ABS_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_DOTS_RE = r"(^|/)\.\.?(/|$)"


def _resolve_parts(b_scheme: Column, b_netloc: Column, b_path: Column, b_query: Column, h: Column,
                   h_path: Column, h_rest: Column) -> Column:
    origin = F.concat(b_scheme, _lit("://"), b_netloc)
    needs_dots = h_path.rlike(_DOTS_RE)
    rooted = F.when(needs_dots, _remove_dot_segments(h_path)).otherwise(h_path)
    directory = F.regexp_replace(F.regexp_extract(b_path, r"^(.*/)", 1), "^$", "/")
    # joining drops empty segments inside the path
    merged = F.regexp_replace(F.concat(directory, h_path), "/{2,}", "/")
    merged = F.when(needs_dots, _remove_dot_segments(merged)).otherwise(merged)
    return (
        F.when(h.rlike(_ABS_RE), h)
        .when(h.startswith("//"), F.concat(b_scheme, _lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, rooted, h_rest))
        .when(h.startswith("?"), F.concat(origin, F.regexp_replace(b_path, "^$", "/"), h))
        .when(h == "", F.concat(origin, b_path, _prefixed("?", b_query)))
        .otherwise(F.concat(origin, merged, h_rest))
    )


def resolve(base: Column, href: Column) -> Column:
    """URL3: ``urljoin(base, href)`` for http(s) pages, then fragment dropped.

    Absolute and scheme-relative links keep their path; root-relative and
    relative paths get dot segments removed; "?q" keeps the base path.
    (Column form; ``resolve_df`` is the staged form for large inputs.)
    """
    h = strip_fragment(href)
    return _resolve_parts(url_part(base, "scheme"), url_part(base, "netloc"), url_part(base, "path"),
                          url_part(base, "query"), h, F.regexp_extract(h, r"^([^?]*)", 1),
                          F.regexp_extract(h, r"^[^?]*(\?.*)?$", 1))


def resolve_df(df, base_col: str, href_col: str, out_col: str):
    """URL3 as staged projections: the base parts and the cleaned href are
    computed once per row as columns, then combined (keeps the plan small)."""
    b = F.col(base_col)
    staged = df.select(
        "*",
        url_part(b, "scheme").alias("_b_scheme"), url_part(b, "netloc").alias("_b_netloc"),
        url_part(b, "path").alias("_b_path"), url_part(b, "query").alias("_b_query"),
        strip_fragment(F.col(href_col)).alias("_h"),
    )
    staged = staged.select("*", F.regexp_extract("_h", r"^([^?]*)", 1).alias("_h_path"),
                           F.regexp_extract("_h", r"^[^?]*(\?.*)?$", 1).alias("_h_rest"))
    value = _resolve_parts(F.col("_b_scheme"), F.col("_b_netloc"), F.col("_b_path"), F.col("_b_query"),
                           F.col("_h"), F.col("_h_path"), F.col("_h_rest"))
    return staged.withColumn(out_col, value).drop("_b_scheme", "_b_netloc", "_b_path", "_b_query", "_h",
                                                 "_h_path", "_h_rest")


def host_without_port(netloc: Column) -> Column:
    """URL4 helper: lower-case host, port dropped."""
    return F.split_part(F.lower(netloc), _lit(":"), _lit(1))


def same_host(a: Column, b: Column) -> Column:
    """URL4: equal hosts ignoring case and port; an empty host never matches."""
    ha = host_without_port(a)
    return (ha != "") & (ha == host_without_port(b))


_ENV_ALT = "|".join(ENVIRONMENT_PREFIXES)
_ALL_ALT = "|".join(NEUTRAL_PREFIXES + ENVIRONMENT_PREFIXES)


def environment(host: Column) -> Column:
    """URL5: environment name of a host ('' for production / www)."""
    return F.regexp_extract(host_without_port(host), rf"^({_ENV_ALT})\.", 1)


def without_environment(host: Column) -> Column:
    """URL6: host without port and without one known prefix (www first)."""
    return F.regexp_replace(host_without_port(host), rf"^({_ALL_ALT})\.", "")


def registrable_domain(host: Column) -> Column:
    """URL7: last two labels of the host without outer dots; IPs and short hosts unchanged."""
    h = F.regexp_replace(host_without_port(host), r"^\.+|\.+$", "")
    labels = F.split(h, r"\.")
    return F.when((F.size(labels) <= 2) | h.rlike(r"^[0-9.]+$"), h).otherwise(
        F.array_join(F.slice(labels, -2, 2), ".")
    )


def bare_path(url: Column) -> Column:
    """The path without ``;params`` (params start after the last "/")."""
    return F.regexp_extract(url, URL_NORM_RE, 3)


_FILE_RE = r"\.(" + "|".join(e[1:] for e in FILE_EXTENSIONS) + r")$"


def is_file(url: Column) -> Column:
    """URL8: the lower-cased path ends with a known file extension."""
    return F.lower(bare_path(url)).rlike(_FILE_RE)


def file_extension(url: Column) -> Column:
    """URL9: text after the last "." of the path, lower-case ('' if none)."""
    return F.regexp_extract(F.lower(bare_path(url)), r"\.([^./]*)$", 1)


def with_url_columns(df, url_col: str = "url", prefix: str = "") -> "DataFrame":  # noqa: F821
    """Add every URL projection of a column in one ``select``."""
    u = F.col(url_col)
    netloc = url_part(u, "netloc")
    return df.select(
        "*",
        normalize(u).alias(f"{prefix}url_norm"),
        F.lower(netloc).alias(f"{prefix}netloc"),
        host_without_port(netloc).alias(f"{prefix}host"),
        environment(netloc).alias(f"{prefix}environment"),
        without_environment(netloc).alias(f"{prefix}site_host"),
        registrable_domain(netloc).alias(f"{prefix}registrable"),
        is_file(u).alias(f"{prefix}is_file"),
        file_extension(u).alias(f"{prefix}extension"),
    )
