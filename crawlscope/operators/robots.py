"""robots.txt: rule table, sitemap lines and the URL permission join.

Parsing explodes each file into numbered lines; the agent block a line
belongs to is the last ``User-agent`` line before it (a running ``last``
over the lines of one file). The permission test joins each URL with its
site's rules, held as one hash table by literal prefix (broadcast behind a size
check), and looks the path's prefixes up in it: no row per rule, no
aggregation, no match per rule. A site with more rules than a row should carry
has them joined by prefix instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from .joins import broadcast_if_small

# A site's table goes with each of its URLs, so sites above these bounds have their rules joined by prefix.
TABLE_RULES = 1_000
TABLE_BYTES = 128 << 10

_META = r"([\\.+?^${}()|\[\]])"


def robots_lines(robots: DataFrame) -> DataFrame:
    """(site, text) -> (site, line_no, line, key, value): stripped lines without
    comments; ``key`` is the lower-cased directive name."""
    lines = robots.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("line_no", "raw"))
    line = H.strip(F.regexp_replace(H.strip(F.col("raw")), "#.*$", ""))
    lines = lines.select("site", "line_no", line.alias("line")).where(F.col("line") != "")
    key = F.lower(F.regexp_extract("line", r"^([^:]*):", 1))
    value = H.strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    return lines.select("site", "line_no", "line", key.alias("key"), value.alias("value"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """SRC6: ``Sitemap:`` entries anywhere in the file, file order, duplicates kept."""
    lines = robots_lines(robots)
    return lines.where(F.lower("line").startswith("sitemap:") & (F.col("value") != "")).select(
        "site", "line_no", F.col("value").alias("sitemap_url"))


def pattern_regex(pattern: Column) -> Column:
    """Robots path pattern -> anchored regex: ``*`` any text, final ``$`` end."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    escaped = F.regexp_replace(body, _META, r"\\$1")
    escaped = F.replace(escaped, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), escaped, F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def robots_rules(robots: DataFrame, rfc_groups: bool = False) -> DataFrame:
    """SRC5: Allow/Disallow rules of the ``User-agent: *`` block (site,
    line_no, pattern, regex, length, allow). By default the last agent line
    before a rule decides (a named agent line ends the ``*`` block), as in the
    reference; ``rfc_groups=True`` groups consecutive agent lines as RFC 9309
    does (a group applies when any of its agent lines is ``*``). An empty path
    is no rule."""
    lines = robots_lines(robots)
    is_agent = F.lower("line").startswith("user-agent:")
    order = Window.partitionBy("site").orderBy("line_no")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    if rfc_groups:
        starts = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
        lines = lines.withColumn("_group", F.sum(starts.cast("int")).over(w))
        star = F.max(is_agent & (F.col("value") == "*")).over(Window.partitionBy("site", "_group"))
        lines = lines.withColumn("_agent", F.when((F.col("_group") > 0) & star, F.lit("*")).otherwise(F.lit("")))
    else:
        lines = lines.withColumn("_agent", F.last(F.when(is_agent, F.col("value")), ignorenulls=True).over(w))
    lower = F.lower("line")
    is_rule = lower.startswith("disallow:") | lower.startswith("allow:")
    rules = lines.where(~is_agent & (F.col("_agent") == "*") & is_rule & (F.col("value") != ""))
    rules = rules.select("site", "line_no", F.col("value").alias("pattern"), lower.startswith("allow:").alias("allow"))
    return rules.withColumn("regex", pattern_regex(F.col("pattern"))).withColumn(
        "length", F.char_length("pattern").cast("int"))


def robots_path(url: Column) -> Column:
    """Path (without ;params, '/' when empty) plus ``?query`` when present."""
    path = F.regexp_extract(U.url_part(url, "path"), U.PATH_PARAMS_RE, 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = U.url_part(url, "query")
    return F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path)


def literal_prefix(pattern: Column) -> Column:
    """The text of a pattern before its first wildcard."""
    return F.regexp_extract(F.regexp_replace(pattern, r"\$$", ""), r"^([^*]*)", 1)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """The rules in the form that ``allowed`` uses. A rule without wildcard has
    no regex: a path with its prefix matches.

    If no site has more than ``TABLE_RULES`` rules and ``TABLE_BYTES`` of text,
    one row a site, broadcast when these are provably few and small: ``_table``
    is an array with a place for each rule, a rule is in the place its prefix
    hashes to, ``_lengths`` are the lengths such prefixes have. The join copies
    that row for each URL, so with longer files it is one row a rule."""
    wild = F.col("pattern").contains("*") | F.col("pattern").endswith("$")
    rules = rules.select("site", literal_prefix(F.col("pattern")).alias("prefix"), "length", "allow", F.when(wild, F.col("regex")).alias("regex"))
    size = F.coalesce(F.octet_length("prefix"), F.lit(0)) + F.coalesce(F.octet_length("regex"), F.lit(0))
    most = rules.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).agg(F.max("n"), F.max("bytes")).first()
    if (most[0] or 0) > TABLE_RULES or (most[1] or 0) > TABLE_BYTES:
        return rules.distinct()
    sites = rules.groupBy("site").agg(F.count(F.lit(1)).alias("_places"), F.sort_array(F.collect_set(F.char_length("prefix"))).alias("_lengths"))
    kept = rules.join(sites.select("site", "_places"), "site").select(
        "site", _place(F.col("prefix"), F.col("_places")).alias("_at"), F.struct("prefix", "length", "allow", "regex").alias("rule"))
    every = sites.select("site", F.explode(F.sequence(F.lit(0), (F.col("_places") - 1).cast("int"))).alias("_at"), F.lit(None).cast(kept.schema["rule"].dataType).alias("rule"))
    places = kept.unionByName(every).groupBy("site", "_at").agg(F.collect_list("rule").alias("_rules"))
    tables = places.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("_at", "_rules"))).alias("_t"))
    return broadcast_if_small(tables.select("site", F.col("_t._rules").alias("_table")).join(sites.select("site", "_lengths"), "site"))


def _place(prefix: Column, places: Column) -> Column:
    return F.pmod(F.xxhash64(prefix), places).cast("int")


def allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url", prepared: bool = False) -> DataFrame:
    """``allowed`` per row of urls (site, url). The longest matching
    pattern wins, Allow wins ties, no match means allowed. The path's prefixes
    of the lengths that the site's rules have are looked up in its table, so a
    URL meets the rules that begin like it and no others, and a regex runs for
    those of them with a wildcard; a row stays one row. ``prepared`` = rules
    already passed through ``prepare_rules``."""
    r = rules if prepared else prepare_rules(rules)
    if "_table" not in r.columns:
        return _allowed_by_prefix(urls, r, url_col)
    probe = urls.withColumn("_path", robots_path(F.col(url_col))).join(r, "site", "left")
    path, table = F.col("_path"), F.col("_table")

    def at(length: Column) -> Column:
        return H.bind(F.substring(path, F.lit(1), length), lambda prefix: F.filter(
            F.get(table, _place(prefix, F.size(table))),
            lambda rule: (rule["prefix"] == prefix) & (rule["regex"].isNull() | F.rlike(path, rule["regex"]))))

    lengths = F.filter(F.col("_lengths"), lambda n: n <= F.char_length(path))
    hits = F.flatten(F.transform(lengths, at))
    best = F.array_max(F.transform(hits, lambda rule: F.struct(rule["length"].alias("length"), rule["allow"].alias("allow"))))["allow"]
    return probe.withColumn("allowed", F.coalesce(best, F.lit(True))).drop("_path", "_table", "_lengths")


def _allowed_by_prefix(urls: DataFrame, rules: DataFrame, url_col: str) -> DataFrame:
    """``allowed`` with one row a rule: each different path meets the rules of
    its prefixes in a join on (site, prefix), and the best of them goes back to
    the rows that have the path."""
    probe = urls.withColumn("_path", robots_path(F.col(url_col)))
    lengths = rules.where(F.col("prefix").isNotNull()).groupBy("site").agg(F.collect_set(F.char_length("prefix")).alias("_lengths"))
    paths = probe.select("site", "_path").distinct().join(broadcast_if_small(lengths), "site")
    prefixes = paths.select("site", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.char_length("_path"))).alias("_n"))
    met = prefixes.select("site", "_path", F.substring("_path", F.lit(1), F.col("_n")).alias("prefix")).join(rules, ["site", "prefix"])
    met = met.where(F.col("regex").isNull() | F.rlike(F.col("_path"), F.col("regex")))
    best = met.groupBy("site", "_path").agg(F.max(F.struct("length", "allow"))["allow"].alias("_best"))
    return probe.join(best, ["site", "_path"], "left").select(
        "site", *[c for c in urls.columns if c != "site"], F.coalesce("_best", F.lit(True)).alias("allowed"))
