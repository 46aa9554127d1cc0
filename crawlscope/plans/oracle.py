"""SQL text builders for the DuckDB oracle of every registered query.

Each builder returns a DuckDB SQL expression over column names, written from
the same rules as the Spark column functions (RE2-compatible patterns only),
so the driver can compare the Spark result with an independent SQL engine.
"""

from __future__ import annotations

# --- fixed values of the oracle ----------------------------------------------
# Written out here, apart from the implementation's, so that a slip in one of
# the two shows as a difference.
PATH_SAFE = "/:@!$&'*+,;="
QUERY_SAFE = "/:@!$&'*+,;=?"
URL_PARTS_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PATH_PARAMS_RE = r"^((?:.*/)?[^/;]*)(?:;(.*))?$"
COMMENT_RE = r"(?s)<!--.*?-->"
SCRIPT_STYLE_RE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAG_RE = r"<[^>]*>"
# The entities that the stored pages have.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]
LINK_TEXT_MAX_CHARS, TITLE_MAX_CHARS, DESCRIPTION_MAX_CHARS, SLOW_MS, LARGE_BYTES = 200, 60, 160, 3000, 2_000_000
MAX_REFERRERS = 50
SKIP_HREF_PREFIXES = ["#", "javascript:", "mailto:", "tel:", "data:"]
SKIP_EMBED_PREFIXES = ["#", "javascript:", "data:", "about:"]
ENVIRONMENT_PREFIXES = [
    'test', 'dev', 'stage', 'staging', 'qa', 'int', 'preview', 'prod', 'produktion', 'live',
]
NEUTRAL_PREFIXES = [
    'www',
]
FILE_EXTENSIONS = [
    '.jpg', '.jpeg', '.png', '.gif', '.svg', '.webp', '.ico', '.bmp', '.pdf', '.doc', '.docx', '.xls', '.xlsx',
    '.ppt', '.pptx', '.zip', '.rar', '.gz', '.tar', '.7z', '.mp3', '.mp4', '.avi', '.mov', '.wmv', '.flv',
    '.webm', '.css', '.js', '.json', '.xml', '.woff', '.woff2', '.ttf', '.eot', '.exe', '.dmg', '.apk', '.msi',
]
OG_PROPERTIES = [
    'og:title', 'og:description', 'og:image',
]
GENERATOR_MARKERS = [
    ('wordpress', 'WordPress'),
    ('sitefinity', 'Sitefinity'),
    ('typo3', 'TYPO3'),
    ('drupal', 'Drupal'),
    ('joomla', 'Joomla'),
    ('hugo', 'Hugo'),
    ('gatsby', 'Gatsby'),
    ('jekyll', 'Jekyll'),
    ('wix', 'Wix'),
    ('squarespace', 'Squarespace'),
    ('shopify', 'Shopify'),
    ('webflow', 'Webflow'),
]
URL_MARKERS = [
    ('jquery', 'jQuery'),
    ('bootstrap', 'Bootstrap'),
    ('tailwind', 'Tailwind CSS'),
    ('react', 'React'),
    ('vue', 'Vue.js'),
    ('angular', 'Angular'),
    ('svelte', 'Svelte'),
    ('htmx', 'htmx'),
    ('alpine', 'Alpine.js'),
    ('wp-content', 'WordPress'),
    ('wp-includes', 'WordPress'),
    ('googletagmanager.com', 'Google Tag Manager'),
    ('google-analytics.com', 'Google Analytics'),
    ('gtag/js', 'Google Analytics'),
    ('matomo', 'Matomo'),
    ('piwik', 'Matomo'),
    ('fontawesome', 'Font Awesome'),
    ('cdn.jsdelivr.net', 'jsDelivr CDN'),
    ('cdnjs.cloudflare.com', 'cdnjs'),
]
SERVER_MARKERS = [
    ('nginx', 'nginx'),
    ('apache', 'Apache'),
    ('iis', 'IIS'),
    ('litespeed', 'LiteSpeed'),
    ('caddy', 'Caddy'),
    ('cloudflare', 'Cloudflare'),
]
POWERED_BY_MARKERS = [
    ('php', 'PHP'),
    ('asp.net', 'ASP.NET'),
    ('express', 'Express'),
]
# ------------------------------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def part(e: str, name: str) -> str:
    g = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[name]
    return f"regexp_extract({e}, {lit(URL_PARTS_RE)}, {g})"


def _pct(ch: str) -> str:
    return "%" + "".join(f"{b:02X}" for b in ch.encode())


def quote(e: str, safe: str) -> str:
    out = f"url_encode({e})"
    for ch in safe:
        out = f"replace({out}, {lit(_pct(ch))}, {lit(ch)})"
    return out


def normalize(e: str) -> str:
    sc = f"lower({part(e, 'scheme')})"
    nl = f"lower({part(e, 'netloc')})"
    fp = part(e, "path")
    path = f"regexp_extract({fp}, {lit(PATH_PARAMS_RE)}, 1)"
    params = f"regexp_extract({fp}, {lit(PATH_PARAMS_RE)}, 2)"
    qp0 = quote(f"url_decode({path})", PATH_SAFE)
    qp = f"(CASE WHEN {qp0} = '' THEN '/' ELSE {qp0} END)"
    qq = quote(f"url_decode({part(e, 'query')})", QUERY_SAFE)
    head = (f"(CASE WHEN {nl} <> '' THEN (CASE WHEN {sc} <> '' THEN {sc} || ':' ELSE '' END) || '//' || {nl} "
            f"ELSE (CASE WHEN {sc} <> '' THEN {sc} || ':' ELSE '' END) END)")
    return (f"({head} || {qp} || (CASE WHEN {params} <> '' THEN ';' || {params} ELSE '' END) "
            f"|| (CASE WHEN {qq} <> '' THEN '?' || {qq} ELSE '' END))")


def full_normalize(e: str, site: str, site_scheme: str) -> str:
    n = normalize(e)
    return (f"(CASE WHEN {part(n, 'scheme')} <> {site_scheme} AND {part(n, 'netloc')} = {site} "
            f"THEN {site_scheme} || substr({n}, length({part(n, 'scheme')}) + 1) ELSE {n} END)")


def _dots(path: str) -> str:
    segs = f"string_split({path}, '/')"
    red = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] "
           f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    fixed = f"(CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({red}, '') ELSE {red} END)"
    j = f"array_to_string({fixed}, '/')"
    return f"regexp_replace((CASE WHEN {j} = '' THEN '/' ELSE {j} END), '^([^/])', '/\\1')"


def resolve(base: str, href: str) -> str:
    bs = part(base, "scheme")
    bn = part(base, "netloc")
    bp = part(base, "path")
    bq = part(base, "query")
    origin = f"({bs} || '://' || {bn})"
    h = f"regexp_replace({href}, '#.*$', '')"
    hp = f"regexp_extract({h}, '^([^?]*)', 1)"
    hr = f"regexp_extract({h}, '^[^?]*(\\?.*)?$', 1)"
    dots = f"regexp_matches({hp}, '(^|/)\\.\\.?(/|$)')"
    rooted = f"(CASE WHEN {dots} THEN {_dots(hp)} ELSE {hp} END)"
    d = f"regexp_extract({bp}, '^(.*/)', 1)"
    merged0 = f"regexp_replace((CASE WHEN {d} = '' THEN '/' ELSE {d} END) || {hp}, '//+', '/', 'g')"
    merged = f"(CASE WHEN {dots} THEN {_dots(merged0)} ELSE {merged0} END)"
    return (f"(CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {bs} || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {rooted} || {hr} "
            f"WHEN starts_with({h}, '?') THEN {origin} || (CASE WHEN {bp} = '' THEN '/' ELSE {bp} END) || {h} "
            f"WHEN {h} = '' THEN {origin} || {bp} || (CASE WHEN {bq} <> '' THEN '?' || {bq} ELSE '' END) "
            f"ELSE {origin} || {merged} || {hr} END)")


def host(e: str) -> str:
    return f"split_part(lower({e}), ':', 1)"


_ENV = "|".join(ENVIRONMENT_PREFIXES)
_ALL = "|".join(NEUTRAL_PREFIXES + ENVIRONMENT_PREFIXES)


def environment(netloc: str) -> str:
    return f"regexp_extract({host(netloc)}, {lit('^(' + _ENV + ')[.]')}, 1)"


def without_environment(netloc: str) -> str:
    return f"regexp_replace({host(netloc)}, {lit('^(' + _ALL + ')[.]')}, '')"


def registrable(netloc: str) -> str:
    h = f"trim({host(netloc)}, '.')"
    labels = f"string_split({h}, '.')"
    return (f"(CASE WHEN len({labels}) <= 2 OR regexp_matches({h}, '^[0-9.]+$') THEN {h} "
            f"ELSE array_to_string({labels}[-2:], '.') END)")


FILE_RE = r"\.(" + "|".join(e[1:] for e in FILE_EXTENSIONS) + r")$"


def bare_path(url: str) -> str:
    return f"regexp_extract({part(url, 'path')}, {lit(PATH_PARAMS_RE)}, 1)"


def is_file(url: str) -> str:
    return f"regexp_matches(lower({bare_path(url)}), {lit(FILE_RE)})"


def extension(url: str) -> str:
    return f"regexp_extract(lower({bare_path(url)}), '\\.([^./]*)$', 1)"


# --- HTML -------------------------------------------------------------------

def decomment(html: str) -> str:
    return f"regexp_replace(coalesce({html}, ''), {lit(COMMENT_RE)}, '', 'g')"


def clean(html: str) -> str:
    return f"regexp_replace({decomment(html)}, {lit(SCRIPT_STYLE_RE)}, '', 'g')"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def decode(e: str) -> str:
    out = e
    for ent, ch in ENTITIES:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


def attr(tag: str, name: str) -> str:
    pat = lit(rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    return decode(f"(regexp_extract({tag}, {pat}, 1) || regexp_extract({tag}, {pat}, 2) || "
                  f"regexp_extract({tag}, {pat}, 3))")


def has_attr(tag: str, name: str) -> str:
    return f"regexp_matches({tag}, {lit(rf'(?is)\s{name}(\s*=|[\s/>]|$)')})"


def tags(markup: str, name: str) -> str:
    return f"regexp_extract_all({markup}, {lit(rf'(?is)<{name}(?:\s[^>]*)?/?>')}, 0)"


def text_of(fragment: str) -> str:
    return (f"array_to_string(list_transform(regexp_split_to_array({fragment}, {lit(TAG_RE)}), "
            f"lambda n: {strip(decode('n'))}), '')")


def first_tag_where(markup: str, name: str, attr_name: str, value: str) -> str:
    return f"list_filter({tags(markup, name)}, lambda t: {attr('t', attr_name)} = {lit(value)})[1]"
