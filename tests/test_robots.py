"""SRC5, SRC6 and J2: the reference's robots cases restated as tables."""

from pyspark.sql import functions as F

from crawlscope.operators import robots as R

ROBOTS = "\n".join([
    "User-agent: Googlebot",
    "Disallow: /private-for-google/",
    "",
    "User-agent: *",
    "Disallow: /admin/",
    "Disallow: /tmp",
    "Allow: /admin/public/",
    "Disallow: /*/print",
    "Disallow: /*.pdf$",
    "Disallow: /same",
    "Allow: /same",
    "Sitemap: https://s.example/sitemap.xml",
])


def _allowed(spark, text, paths, site="s.example"):
    robots = spark.createDataFrame([(site, text)], "site string, text string")
    urls = spark.createDataFrame([(site, f"https://{site}{p}") for p in paths], "site string, url string")
    out = R.allowed(urls, R.robots_rules(robots)).select("url", "allowed").collect()
    got = {r.url: r.allowed for r in out}
    return [got[f"https://{site}{p}"] for p in paths]


def test_longest_match_and_ties(spark):
    paths = ["/admin/x", "/admin/public/page", "/tmp", "/tmpfile", "/ok", "/same", "/private-for-google/x"]
    assert _allowed(spark, ROBOTS, paths) == [False, True, False, False, True, True, True]


def test_wildcards_and_end_anchor(spark):
    paths = ["/a/print", "/a/b/print/x", "/doc.pdf", "/doc.pdf?x=1", "/doc.pdfx"]
    assert _allowed(spark, ROBOTS, paths) == [False, False, False, True, True]


def test_empty_robots_and_empty_disallow(spark):
    assert _allowed(spark, "", ["/x"]) == [True]
    assert _allowed(spark, "User-agent: *\nDisallow:", ["/x"]) == [True]


def test_other_agent_only(spark):
    assert _allowed(spark, "User-agent: Bing\nDisallow: /", ["/x"]) == [True]


def test_sitemap_lines_kept_in_order(spark):
    text = "Sitemap: https://a/1.xml\nUser-agent: x\nsitemap: https://a/2.xml\nSitemap: https://a/1.xml"
    robots = spark.createDataFrame([("a", text)], "site string, text string")
    got = [r.sitemap_url for r in R.robots_sitemaps(robots).orderBy("line_no").collect()]
    assert got == ["https://a/1.xml", "https://a/2.xml", "https://a/1.xml"]


def test_rules_keep_query_and_ignore_params(spark):
    text = "User-agent: *\nDisallow: /p?x=1"
    assert _allowed(spark, text, ["/p?x=1", "/p;params?x=1", "/p"]) == [False, False, True]
    rules = R.robots_rules(spark.createDataFrame([("a", text)], "site string, text string"))
    assert rules.select(F.col("regex")).first()[0] == r"^/p\?x=1"


def test_agent_grouping_default_and_rfc(spark):
    text = "User-agent: *\nUser-agent: Bing\nDisallow: /x\n\nUser-agent: Other\nDisallow: /y"
    robots = spark.createDataFrame([("a", text)], "site string, text string")
    default = {r.pattern for r in R.robots_rules(robots).collect()}
    rfc = {r.pattern for r in R.robots_rules(robots, rfc_groups=True).collect()}
    assert default == set()      # the last agent line before the rule (Bing) decides
    assert rfc == {"/x"}         # the group "*, Bing" applies to everyone


def test_permission_equals_every_rule_tried(spark):
    import random
    import re

    rng = random.Random(4)
    parts = ["/", "a", "b", "*", "$", ".", "/a", "?x", "é", ""]
    rows = [("s" + str(k % 3), "".join(rng.choice(parts) for _ in range(rng.randint(1, 5))), rng.random() < 0.4) for k in range(150)]
    rows = [(s, "/" + p, a) for s, p, a in rows]
    urls = [("s" + str(k % 4), f"https://h.example/{''.join(rng.choice('ab/.?x') for _ in range(rng.randint(0, 6)))}") for k in range(200)]
    rules = spark.createDataFrame(rows, "site string, pattern string, allow boolean").select(
        "site", "pattern", "allow", R.pattern_regex(F.col("pattern")).alias("regex"), F.char_length("pattern").alias("length"))
    frame = spark.createDataFrame(urls, "site string, url string")
    regex = {r.pattern: r.regex for r in rules.collect()}
    path = {r.url: r.p for r in frame.select("url", R.robots_path(F.col("url")).alias("p")).collect()}
    for row in R.allowed(frame, rules).collect():
        hits = [(len(p), a) for s, p, a in rows if s == row.site and re.match(regex[p], path[row.url])]
        assert row.allowed == (max(hits)[1] if hits else True), row


def test_long_robots_files_are_joined_by_prefix(spark):
    rows = [("s", f"/d{k}/", False) for k in range(R.TABLE_RULES)] + [("s", "/d7/*/open", True), ("s", "/d8/x$", True), ("t", "/", False), ("t", "/*a", True), ("s", "/d7/", False)]
    rules = spark.createDataFrame(rows, "site string, pattern string, allow boolean").select(
        "site", "pattern", "allow", R.pattern_regex(F.col("pattern")).alias("regex"), F.char_length("pattern").alias("length"))
    assert "_table" not in R.prepare_rules(rules).columns  # a row a site would be copied for each URL
    assert "_table" in R.prepare_rules(rules.where("site = 't'")).columns
    want = [("s", "/d7/q", False), ("s", "/d7/q", False), ("s", "/d7/q/open", True), ("s", "/d8/x", True), ("s", "/d8/xy", False), ("s", "/e", True),
            ("t", "/b", False), ("t", "/ba", True), ("other", "/d7/", True), (None, "/d7/", True), ("s", None, True)]
    urls = spark.createDataFrame([(k, s, p and f"https://h.example{p}") for k, (s, p, _) in enumerate(want)], "k int, site string, url string")
    out = R.allowed(urls, rules)
    assert out.columns == ["site", "k", "url", "allowed"]
    assert {r.k: r.allowed for r in out.collect()} == {k: a for k, (_, _, a) in enumerate(want)} and out.count() == len(want)
