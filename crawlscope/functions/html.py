"""HTML column expressions: cleaning, attributes, text, SEO, tech, issues.

No HTML parser runs here. Comments and script/style bodies are removed in one
pass, whichever starts first. Tags are matched attribute by attribute, so a
``>`` or another attribute's name inside a quoted value is part of that value.
The patterns use possessive groups, so no page makes them backtrack. A page's
tags are scanned once into a tag table (``tag_table``: names and maps of
decoded attributes) that all findings read, and values that an expression needs
several times are bound (``bind``), so plans stay small and no tag is parsed twice.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Technology markers: (needle, name), tested as substrings in check order.
GENERATOR_MARKERS = [
    ("wordpress", "WordPress"),
    ("sitefinity", "Sitefinity"),
    ("typo3", "TYPO3"),
    ("drupal", "Drupal"),
    ("joomla", "Joomla"),
    ("hugo", "Hugo"),
    ("gatsby", "Gatsby"),
    ("jekyll", "Jekyll"),
    ("wix", "Wix"),
    ("squarespace", "Squarespace"),
    ("shopify", "Shopify"),
    ("webflow", "Webflow"),
]
URL_MARKERS = [
    ("jquery", "jQuery"),
    ("bootstrap", "Bootstrap"),
    ("tailwind", "Tailwind CSS"),
    ("react", "React"),
    ("vue", "Vue.js"),
    ("angular", "Angular"),
    ("svelte", "Svelte"),
    ("htmx", "htmx"),
    ("alpine", "Alpine.js"),
    ("wp-content", "WordPress"),
    ("wp-includes", "WordPress"),
    ("googletagmanager.com", "Google Tag Manager"),
    ("google-analytics.com", "Google Analytics"),
    ("gtag/js", "Google Analytics"),
    ("matomo", "Matomo"),
    ("piwik", "Matomo"),
    ("fontawesome", "Font Awesome"),
    ("cdn.jsdelivr.net", "jsDelivr CDN"),
    ("cdnjs.cloudflare.com", "cdnjs"),
]
SERVER_MARKERS = [
    ("nginx", "nginx"),
    ("apache", "Apache"),
    ("iis", "IIS"),
    ("litespeed", "LiteSpeed"),
    ("caddy", "Caddy"),
    ("cloudflare", "Cloudflare"),
]
POWERED_BY_MARKERS = [("php", "PHP"), ("asp.net", "ASP.NET"), ("express", "Express")]
# Response headers kept for the detail view, in this order.
INTERESTING_HEADERS = ["server", "x-powered-by", "content-encoding", "cache-control", "etag", "age", "x-cache", "via"]
# Open Graph properties reported, in this order.
OG_PROPERTIES = ["og:title", "og:description", "og:image"]
# Issue codes in report order, with their thresholds.
ISSUE_CODES = [
    "http_error", "no_title", "title_long", "no_description", "description_long", "no_h1", "multiple_h1",
    "no_viewport", "no_lang", "no_canonical", "noindex", "slow", "large",
]
TITLE_MAX_CHARS = 60
DESCRIPTION_MAX_CHARS = 160
SLOW_MS = 3000
LARGE_BYTES = 2_000_000
LINK_TEXT_MAX_CHARS = 200
# ---------------------------------------------------------------------------

# Named entities: the HTML 4 names (and apos) with ";", and those of them that HTML allows without it.
_NAMED = {**{n: chr(c) for n, c in name2codepoint.items()}, "apos": "'"}
_OPEN_NAMED = {n: c for n, c in _NAMED.items() if n in html5}
# Numeric references 128-159 mean Windows-1252 characters.
_WINDOWS = {str(b): bytes([b]).decode("cp1252") for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

# Unicode white space as Python's str.strip() sees it.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
ATTRIBUTE_RE = rf"""(?:[\s/]+|(?<=["']))[^\s/>="'][^\s/>=]*+(?>\s*=\s*{_VALUE}|\s*=)?"""
# one attribute: its name, and its value as written
ATTRIBUTE_PARTS_RE = rf"""(?s)(?:[\s/]+|(?<=["']))([^\s/>="'][^\s/>=]*+)(?>\s*=\s*({_VALUE})|\s*=)?"""
# attributes, up to and with the end of a tag
_REST_OF_TAG = rf"(?>{ATTRIBUTE_RE}|[\s/]+|[\"'=])*+>"
TAG_RE = rf"(?s)</?[A-Za-z][^\s/>]*+{_REST_OF_TAG}|<![^>]*>"
_COMMENT = r"<!--.*?-->"


def decomment(html: Column) -> Column:
    """Markup without comments and script/style bodies; the tags of scripts and styles stay."""
    pattern = rf"(?is){_COMMENT}|(<(script|style)(?=[\s/>]){_REST_OF_TAG}).*?(?=</\2[\s/>])"
    return F.regexp_replace(F.coalesce(html, F.lit("")), pattern, "$1")


def clean(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    pattern = rf"(?is){_COMMENT}|<(script|style)(?=[\s/>]){_REST_OF_TAG}.*?</\1\s*>"
    return F.regexp_replace(F.coalesce(html, F.lit("")), pattern, "")


def strip(text: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def _constant_map(values: dict[str, str]) -> Column:
    """A map literal out of two strings (one constant in the plan, not one for each entry)."""
    return F.map_from_arrays(F.split(F.lit(" ".join(values)), " "), F.split(F.lit("\x00".join(values.values())), "\x00"))


def _character(number: Column) -> Column:
    """The character of a decimal code point; U+FFFD for numbers that aren't characters."""
    code = number.try_cast("bigint")
    bad = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    known = F.when(bad, F.lit(0xFFFD).cast("bigint")).otherwise(code)
    plain = F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")
    return F.when(code.between(128, 159), F.coalesce(_constant_map(_WINDOWS)[code.cast("string")], plain)).otherwise(plain)


def _reference(piece: Column) -> Column:
    """A piece of text that followed "&", with the reference it starts with decoded."""
    decimal = F.regexp_extract(piece, r"^#([0-9]+)", 1)
    hexadecimal = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+)", 1)
    name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*)", 1)
    named = F.when(piece.rlike(r"^[A-Za-z0-9]+;"), _constant_map(_NAMED)[name]).otherwise(_constant_map(_OPEN_NAMED)[name])
    rest = F.regexp_replace(piece, r"^(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);?", "")
    return (
        F.when(decimal != "", F.concat(_character(decimal), rest))
        .when(hexadecimal != "", F.concat(_character(F.conv(hexadecimal, 16, 10)), rest))
        .when((name != "") & named.isNotNull(), F.concat(named, rest))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it: it
    becomes a lambda variable, which the optimizer doesn't copy."""
    return F.get(F.transform(F.array(value), body), 0)


def decode_entities(text: Column) -> Column:
    """Numeric and named character references decoded; unknown ones stay.
    ``text`` is named three times: give a column or a bound value."""
    def decoded(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), _reference)
        return F.concat(F.get(pieces, 0), F.array_join(rest, ""))

    return F.when(text.contains("&"), bind(F.split(text, "&"), decoded)).otherwise(text)


def attribute_names(tag: Column) -> Column:
    """The attribute names of an opening tag in order, in lower case."""
    return F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE_PARTS_RE), 1), F.lower)


def attribute_values(tag: Column) -> Column:
    """The attribute values of an opening tag in order, as written ('' where there is none)."""
    return F.regexp_extract_all(tag, F.lit(ATTRIBUTE_PARTS_RE), 2)


def unquoted(raw: Column) -> Column:
    """A value as written, without its quotes."""
    return F.when(raw.startswith('"') | raw.startswith("'"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def attributes(tag: Column) -> Column:
    """The attributes of an opening tag as a map of decoded values; of a name given twice the first counts."""
    def of(names: Column, values: Column) -> Column:
        def value(name: Column) -> Column:
            return bind(unquoted(F.element_at(values, F.array_position(names, name).cast("int"))), decode_entities)

        return bind(F.array_distinct(names), lambda once: F.map_from_arrays(once, F.transform(once, value)))

    return bind(attribute_names(tag), lambda names: bind(attribute_values(tag), lambda values: of(names, values)))


def tag_pattern(name: str) -> str:
    """The pattern of one opening tag."""
    return rf"(?is)<{name}(?=[\s/>]){_REST_OF_TAG}"


def any_of(names: list[str]) -> str:
    """The name pattern of tags of any of these names."""
    return f"(?:{'|'.join(names)})"


def tags(markup: Column, name: str) -> Column:
    """All opening tags ``<name ...>`` in document order."""
    return F.regexp_extract_all(markup, F.lit(tag_pattern(name)), 0)


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([^\s/>]*)", 1))


def tag_table(markup: Column, names: list[str]) -> Column:
    """The opening tags of these names in document order, found in one scan:
    ``array<struct<name, attrs map<string, string>>>``. Every job over the
    tags of a page reads this table, so no tag is scanned twice."""
    return F.transform(tags(markup, any_of(names)), lambda t: F.struct(tag_name(t).alias("name"), attributes(t).alias("attrs")))


def text_of(fragment: Column) -> Column:
    """``get_text(strip=True)``: each text node stripped, joined without separator."""
    return F.array_join(F.transform(F.split(fragment, TAG_RE), lambda n: strip(decode_entities(n))), "")


#: Tags that the SEO record and the form flag look at, and those of the technologies.
PAGE_TAGS = ["meta", "link", "html", "h1", "form"]
TECH_TAGS = ["meta", "script", "link"]


def _named(table: Column, name: str) -> Column:
    return F.filter(table, lambda t: t["name"] == name)


def _meta(table: Column, name: str) -> Column:
    """The first ``<meta>`` of this name (case-sensitive), or NULL."""
    return F.get(F.filter(table, lambda t: (t["name"] == "meta") & (t["attrs"]["name"] == name)), 0)


def has_form(markup: Column) -> Column:
    """HTML6: any ``<form>`` element."""
    return form_of(tag_table(markup, ["form"]))


def form_of(table: Column) -> Column:
    return F.exists(table, lambda t: t["name"] == "form")


def title_of(markup: Column) -> Column:
    """The text of the first ``<title>``."""
    return bind(F.regexp_extract(markup, rf"{tag_pattern('title')}(.*?)</title\s*>", 1), text_of)


def seo(markup: Column) -> Column:
    """HTML7: the SEO record as a struct (empty string / 0 / false when missing)."""
    return seo_of(tag_table(markup, PAGE_TAGS), title_of(markup))


def seo_of(table: Column, title: Column) -> Column:
    """HTML7 from a page's tag table (PAGE_TAGS) and title."""
    def record(t: Column) -> Column:
        def is_canonical(tag: Column) -> Column:
            return (tag["name"] == "link") & F.array_contains(F.split(strip(tag["attrs"]["rel"]), rf"{WS}+"), "canonical")

        props = F.transform(_named(t, "meta"), lambda tag: tag["attrs"]["property"])
        og = bind(props, lambda known: F.filter(F.array(*[F.lit(p) for p in OG_PROPERTIES]), lambda p: F.array_contains(known, p)))
        return F.struct(
            title.alias("title"),
            F.coalesce(strip(_meta(t, "description")["attrs"]["content"]), F.lit("")).alias("description"),
            F.size(_named(t, "h1")).alias("h1_count"),
            F.coalesce(F.get(F.filter(t, is_canonical), 0)["attrs"]["href"], F.lit("")).alias("canonical"),
            F.coalesce(F.get(_named(t, "html"), 0)["attrs"]["lang"], F.lit("")).alias("lang"),
            _meta(t, "viewport").isNotNull().alias("has_viewport"),
            F.coalesce(_meta(t, "robots")["attrs"]["content"], F.lit("")).alias("robots"),
            F.filter(og, lambda p: p.isNotNull()).alias("og_tags"),
        )

    return bind(table, record)


def _marker_hits(haystack: Column, markers) -> Column:
    pairs = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(v).alias("name")) for n, v in markers])
    return bind(haystack, lambda text: F.transform(F.filter(pairs, lambda m: F.contains(text, m["needle"])), lambda m: m["name"]))


def tech(decommented: Column, headers: Column) -> Column:
    """HTML8: technologies from generator meta, script/link URLs and headers."""
    return tech_of(tag_table(decommented, TECH_TAGS), headers)


def tech_of(table: Column, headers: Column) -> Column:
    """HTML8 from the tag table (TECH_TAGS) of a page whose scripts' tags are still there."""
    def urls(t: Column, name: str, attribute: str) -> Column:
        own = F.filter(t, lambda tag: (tag["name"] == name) & tag["attrs"][attribute].isNotNull())
        return F.transform(own, lambda tag: F.lower(tag["attrs"][attribute]))

    def found(t: Column) -> Column:
        generator = F.lower(F.coalesce(_meta(t, "generator")["attrs"]["content"], F.lit("")))
        haystack = F.array_join(F.concat(urls(t, "script", "src"), urls(t, "link", "href")), " ")
        return F.concat(_marker_hits(generator, GENERATOR_MARKERS), _marker_hits(haystack, URL_MARKERS))

    server = F.lower(F.coalesce(headers["server"], F.lit("")))
    powered = F.lower(F.coalesce(headers["x-powered-by"], F.lit("")))
    return F.array_distinct(F.concat(bind(table, found), _marker_hits(server, SERVER_MARKERS), _marker_hits(powered, POWERED_BY_MARKERS)))


def interesting_headers(headers: Column) -> Column:
    """HTML9: keep the eight display headers with non-empty values (keys lower-cased)."""
    lowered = F.transform_keys(headers, lambda k, v: F.lower(k))
    keep = F.array(*[F.lit(h) for h in INTERESTING_HEADERS])
    return F.map_filter(lowered, lambda k, v: F.array_contains(keep, k) & (v != ""))


def headers_text(headers: Column) -> Column:
    """The kept headers as ``k=v;k=v`` in display order (for reports and checks)."""
    pairs = F.transform(
        F.array(*[F.lit(h) for h in INTERESTING_HEADERS]),
        lambda k: F.when(F.coalesce(headers[k], F.lit("")) != "", F.concat(k, F.lit("="), headers[k])),
    )
    return F.array_join(pairs, ";")


def issues(http_status_code: Column, content_type: Column, seo_col: Column,
           load_time_ms: Column, page_size: Column) -> Column:
    """HTML10: issue codes in fixed order (strict thresholds, lengths in characters)."""
    is_html = F.lower(content_type).contains("html")
    title = seo_col["title"]
    desc = seo_col["description"]
    h1 = seo_col["h1_count"]
    codes = [
        F.when(http_status_code >= 400, F.lit("http_error")),
        F.when(is_html & (title == ""), F.lit("no_title")),
        F.when(is_html & (F.char_length(title) > TITLE_MAX_CHARS), F.lit("title_long")),
        F.when(is_html & (desc == ""), F.lit("no_description")),
        F.when(is_html & (F.char_length(desc) > DESCRIPTION_MAX_CHARS), F.lit("description_long")),
        F.when(is_html & (h1 == 0), F.lit("no_h1")),
        F.when(is_html & (h1 > 1), F.lit("multiple_h1")),
        F.when(is_html & ~seo_col["has_viewport"], F.lit("no_viewport")),
        F.when(is_html & (seo_col["lang"] == ""), F.lit("no_lang")),
        F.when(is_html & (seo_col["canonical"] == ""), F.lit("no_canonical")),
        F.when(is_html & F.lower(seo_col["robots"]).contains("noindex"), F.lit("noindex")),
        F.when(load_time_ms > SLOW_MS, F.lit("slow")),
        F.when(page_size > LARGE_BYTES, F.lit("large")),
    ]
    return F.array_compact(F.array(*codes))
