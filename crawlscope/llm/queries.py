"""The queries of the operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import bag_minhash, decontamination, embedding_dups, heap_clusters, huffman, language_mixture, packing, revisits, secret_ledger, source_divergence, token_counts, toxicity, url_filter
from .shared import shared_path, table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    """Register a query; its session's workers get the package first."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over documents: bytes and tokens of every whole text, and whether it has more than 512."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over documents: ids written in Huffman blocks and read back; start, count and checksum of each document."""
    path = shared_path(spark, "huffman")
    huffman.write(table(spark, sf_dir, "documents"), path, VOCABULARY, END_ID)
    return huffman.crc32_of(huffman.read(spark, path))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over documents: every piece with its sequence, offset and checksum."""
    return huffman.crc32_of(packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, END_ID))


#: Fixed values of the task: rules (host, path) with their verdicts.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over pages: host, path, longest fitting rule and verdict of every URL."""
    rules = [url_filter.host_rule(*r) for r in URL_RULES]
    return url_filter.judge(table(spark, sf_dir, "pages", ["page_id", "url"]), rules, default="allow")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
ORACLE["op9_url_filter"] = f"""
WITH rules(verdict, rh, rp) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a,
             row_number() OVER () AS k FROM pages),
hp AS (SELECT k, page_id, lower(regexp_extract(a, '^[^/?#]*')) AS host,
              regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
best AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
         FROM hp JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hp LEFT JOIN best USING (k)
"""


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures in the schema of ``revisits`` that stand for a crawl of pages: two rows a page, a fetch and a later check.

    Times, validators and status codes vary with page_id so that every resolution occurs.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    at = lambda seconds: F.timestamp_seconds(1_600_000_000 + seconds)
    day = F.date_format(at(86_400 * (p % 50)), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    fetch = F.struct(
        (2 * p).alias("capture_id"), F.col("url"), at(60 * p).alias("ts"), F.lit("response").alias("kind"),
        F.when(p % 11 == 0, 404).otherwise(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("ETag"), F.when(p % 3 != 0, tag), F.lit("Last-Modified"), day).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    check = F.struct(
        (2 * p + 1).alias("capture_id"), F.when(p % 2 == 0, F.concat("url", F.lit("#again"))).otherwise(F.regexp_replace("url", "^http", "HTTP")).alias("url"),
        at(60 * (p + p * 37 % 101 - 20)).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=900"), F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close, X-Hop"), F.lit("x-hop"), F.lit("1"), F.lit("ETag"), F.when(p % 5 == 0, F.lit('"changed"')).when(p % 5 < 3, F.concat(F.lit("W/"), tag)), F.lit("last-modified"), F.when(p % 5 == 3, day)).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return pages.select(F.explode(F.array(fetch, check)).alias("c")).select("c.*")


@query
def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over captures of pages: every revisit with the response it stands for and the merged headers."""
    found = revisits.resolve(captures_of_pages(table(spark, sf_dir, "pages", ["page_id", "url", "html"])))
    return found.withColumn("ts", F.unix_seconds("ts")).withColumn("headers", revisits.header_lines(F.col("headers")))


ORACLE["op5_revisit_resolution"] = """
WITH base AS (
  SELECT page_id AS p, url, '"' || substr(md5(html), 1, 12) || '"' AS tag, length(html) AS n,
         strftime(make_timestamp((1600000000 + 86400 * (page_id % 50)) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS day,
         lower(regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', ''), '^[^/?]*')) AS host,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*', '') AS rest
  FROM pages),
keyed AS (
  SELECT *, host || CASE WHEN split_part(rest, '?', 1) = '' THEN '/' ELSE split_part(rest, '?', 1) END
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS url_key
  FROM (SELECT *, list_filter(string_split(CASE WHEN contains(rest, '?') THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END, '&'),
                              lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)(=|$)')) AS q FROM base)),
resp AS (SELECT url_key, 1600000000 + 60 * p AS ts, max(2 * p) AS id FROM keyed WHERE p % 11 <> 0 GROUP BY ALL),
rev AS (SELECT *, 2 * p + 1 AS capture_id, 1600000000 + 60 * (p + p * 37 % 101 - 20) AS ts,
               CASE WHEN p % 5 = 0 THEN '"changed"' WHEN p % 5 < 3 THEN 'W/' || tag END AS etag,
               CASE WHEN p % 5 = 3 THEN day END AS modified FROM keyed),
joined AS (SELECT rev.*, resp.id AS response_id FROM rev ASOF LEFT JOIN resp ON rev.url_key = resp.url_key AND rev.ts > resp.ts),
full_rows AS (
  SELECT j.*, r.n AS r_n, r.day AS r_day, CASE WHEN r.p % 3 <> 0 THEN r.tag END AS r_tag
  FROM joined j LEFT JOIN keyed r ON r.p * 2 = j.response_id),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
                 WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = r_tag THEN 'resolved' ELSE 'mismatch' END
                 WHEN modified IS NOT NULL THEN CASE WHEN modified = r_day THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'assumed' END AS resolution
  FROM full_rows)
SELECT capture_id, url_key, ts, response_id, resolution,
  CASE WHEN resolution IN ('resolved', 'assumed') THEN concat_ws(chr(10), 'cache-control: max-age=900', 'content-length: ' || r_n,
       'content-type: text/html', 'etag: ' || coalesce(etag, r_tag), 'last-modified: ' || coalesce(modified, r_day))
  ELSE concat_ws(chr(10), 'cache-control: max-age=900', 'connection: close, X-Hop', 'content-length: 0',
       'etag: ' || etag, 'last-modified: ' || modified, 'x-hop: 1') END AS headers
FROM judged
"""


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over documents: secret spans of every document, through a ledger of its blobs."""
    documents = table(spark, sf_dir, "documents", ["doc_id", "text"])
    empty = spark.createDataFrame([], secret_ledger.LEDGER_SCHEMA)
    ledger = written(secret_ledger.scan(documents, empty), "ledger")
    found = secret_ledger.at_paths(documents, ledger)
    number = lambda rule: F.coalesce(F.size(F.col("found")[rule]), F.lit(0)).cast("long")
    spans = found.select("doc_id", *[F.when(number(r.name) > 0, number(r.name)).otherwise(0).cast("long").alias(f"n_{r.name}") for r in secret_ledger.RULES], secret_ledger.span_texts(F.col("found")).alias("spans"))
    return spans.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op8_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over embeddings: links, component and whether a vector stands for its component."""
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over documents: score of every text by a model that never saw the held-out fifth's labels."""
    documents = table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = toxicity.fit(documents, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over documents: the class of near duplicates of every document."""
    return bag_minhash.document_classes(table(spark, sf_dir, "documents"))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over documents and benchmark: every contaminated document with item, distance and span."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _spans_sql() -> str:
    """CTE ``spans`` (rid, start, k, stop, name): the task's three patterns, written for DuckDB."""
    rules = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
    ]
    each = []
    for k, (name, pattern, group, least) in enumerate(rules):
        each.append(f"""
  SELECT rid, {k} AS k, '{name}' AS name, length(tested[i]) >= {least} AS good,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
         length(hits[i]) AS n
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
           regexp_extract_all(t, '{pattern}', {group}) AS tested FROM d WHERE regexp_matches(t, '{pattern}')))""")
    return "spans AS (" + " UNION ALL ".join(each) + ")"


ORACLE["op6_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
{_spans_sql()},
found AS (
  SELECT rid, count_if(k = 0) AS a, count_if(k = 1) AS b, count_if(k = 2) AS c,
         string_agg(name || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + n AS BIGINT) AS VARCHAR), ',' ORDER BY start, k) AS s
  FROM spans WHERE good GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access,
       CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN found USING (rid)
"""

ORACLE["op8_embedding_dups"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
         ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT near.b, reach.other FROM reach JOIN near ON near.a = reach.node),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.node = e.vec_id LEFT JOIN links ON links.a = e.vec_id
"""


@query
def op11_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over documents: language of every whole text by a model that never saw the held-out fifth."""
    held_out = toxicity.held_out(F.col("doc_id"))
    model = language_mixture.fit(table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]), ~held_out)
    found = language_mixture.identify(table(spark, sf_dir, "documents", ["doc_id", "text"]), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over documents: divergence of the sources of each language, and the terms that set each apart."""
    return source_divergence.audit(table(spark, sf_dir, "documents", ["text", "lang", "source"]))


ORACLE["op12_source_divergence"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (
  SELECT rid, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)),
k AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
counts AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
           FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size FROM counts),
shares AS MATERIALIZED (
  SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000 * (s.n + 2)) // (s.size::HUGEINT + 2 * l.v) AS p,
         1 + (1000000000 * (s.total + 2)) // (l.n + 2 * l.v) AS q
  FROM sized s JOIN l ON l.lang = s.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over embeddings: exact k-means (8 centroids, 10 rounds) in whole numbers."""
    return heap_clusters.cluster(table(spark, sf_dir, "embeddings"))


def _clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds of k-means one after another: c<r> the centroids, a<r> the assignment to them."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.rid, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY rid)"""
    means = """c{next} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS x FROM (
      SELECT a.cluster, u.i, CASE WHEN sum(u.y) >= 0 THEN sum(u.y) // count(*) ELSE -((count(*) - 1 - sum(u.y)) // count(*)) END::BIGINT AS x
      FROM a{r} a JOIN u USING (rid) GROUP BY ALL) GROUP BY cluster) m ON m.cluster = c.cluster)"""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0)""",
             f"u AS MATERIALIZED (SELECT rid, unnest(range(1, {dims + 1})) AS i, unnest(x) AS y FROM v)",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v) ORDER BY h, x LIMIT {k})"]
    for r in range(rounds):
        parts += [nearest.format(r=r), means.format(r=r, next=r + 1)]
    parts.append(nearest.format(r=rounds))
    return "WITH " + ", ".join(parts) + f"""
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.cluster = a.cluster
"""


ORACLE["op13_heap_clusters"] = _clusters_sql()
