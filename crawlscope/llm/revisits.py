"""Operator 5: resolve "not modified" revisit records of web captures.

A capture is ``capture_id``, ``url``, ``ts`` (timestamp), ``kind`` (``response``
or ``revisit``), ``status``, ``headers`` (map), ``payload_digest``. Every
revisit is joined as of its time to the latest earlier full response (kind
``response``, status 200) of the same canonical URL. Its validators are then
checked against that response, and the permitted headers are merged.

As-of join without gathering a URL: captures are dealt by (URL, slice of time).
Within a slice a window finds the latest earlier response; the last response of
every slice is carried to later slices of its URL by a window over one row a
slice, and joined back. So a URL that is captured very often is split by time.
Payloads never move: the result names the response record that holds it.

``resolution`` of a revisit:

* ``resolved``: the revisit's strongest validator (payload digest, else ETag by
  weak comparison, else Last-Modified) equals the response's;
* ``assumed``: the revisit has none of them;
* ``mismatch``: it has one and the response's differs or is missing;
* ``no_response``: there is no earlier full response, or the revisit's URL or
  time is null.

For the first two, ``headers`` are the response's updated by the revisit's, but
for hop-by-hop fields, fields that the revisit's Connection names, and those
that describe the stored payload; else they are the revisit's own. Header names
are compared and given in lower case; null values are dropped, of equal names
in different case the last in the map's order wins.

Other defined results: a response at the very time of a revisit is not earlier;
of responses at the same time the one with the highest id counts; repeated
revisit rows each give a row; an empty table gives no rows; other columns are
ignored; captures of other kinds play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 6 * 3600

# Fixed values -----------------------------------------------------------------
#: Query parameters that don't change a page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid)(=|$)"
#: Fields of a 304 that never replace those of the stored response.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
# ------------------------------------------------------------------------------


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path, sorted query without tracking parameters; no scheme, no fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _lower_names(headers: Column) -> Column:
    """Headers with lower-case names and without nulls; the last of equal names wins."""
    entries = F.filter(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve(captures: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row for each revisit: capture_id, url_key, ts, response_id, resolution, headers."""
    rows = captures.filter(F.col("kind").isin("response", "revisit")).select(
        "capture_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "status",
        _lower_names(F.col("headers")).alias("headers"), "payload_digest",
    )
    full = (F.col("kind") == "response") & F.coalesce(F.col("status") == 200, F.lit(False))
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    lost = rows.filter((F.col("kind") == "revisit") & ~known).withColumn("found", F.lit(None).cast(_found_type(rows)))
    response = F.struct("ts", "capture_id", "headers", "payload_digest")
    timed = rows.filter(known & (full | (F.col("kind") == "revisit"))).select(
        "*", F.floor(F.unix_micros("ts") / (slice_seconds * 1_000_000)).alias("slice"), F.when(full, response).alias("own"),
    )

    # equal times: responses in order of id, revisits before them
    place = [F.col("ts"), F.col("own").isNotNull(), F.col("capture_id")]
    within = Window.partitionBy("url_key", "slice").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    near = timed.withColumn("near", F.last("own", ignorenulls=True).over(within))
    slices = timed.groupBy("url_key", "slice").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.struct("ts", "capture_id"))).alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("url_key", "slice", F.last("last", ignorenulls=True).over(earlier).alias("carried")).filter(F.col("carried").isNotNull())
    revisits = near.filter(F.col("kind") == "revisit").join(carried, ["url_key", "slice"], "left")
    found = revisits.withColumn("found", F.coalesce("near", "carried")).select(*lost.columns)
    return _checked(found.unionByName(lost))


def _found_type(rows: DataFrame):
    return rows.select(F.struct("ts", "capture_id", "headers", "payload_digest").alias("x")).schema["x"].dataType


def _checked(found: DataFrame) -> DataFrame:
    mine, theirs = F.col("headers"), F.col("found.headers")
    same = (
        F.when(F.col("payload_digest").isNotNull(), F.coalesce(F.col("payload_digest") == F.col("found.payload_digest"), F.lit(False)))
        .when(mine["etag"].isNotNull(), F.coalesce(_opaque(mine["etag"]) == _opaque(theirs["etag"]), F.lit(False)))
        .when(mine["last-modified"].isNotNull(), F.coalesce(mine["last-modified"] == theirs["last-modified"], F.lit(False)))
    )
    resolution = F.when(F.col("found").isNull(), "no_response").when(same.isNull(), "assumed").when(same, "resolved").otherwise("mismatch")
    named = F.transform(F.split(F.lower(F.coalesce(mine["connection"], F.lit(""))), ","), lambda x: F.trim(x))
    kept = F.array_union(F.array(*map(F.lit, KEPT_FIELDS)), named)
    update = F.map_filter(mine, lambda k, v: ~F.array_contains(kept, k))
    stored = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k))
    merged = F.when(F.col("resolution").isin("resolved", "assumed"), F.map_concat(stored, update)).otherwise(mine)
    return found.withColumn("resolution", resolution).select(
        "capture_id", "url_key", "ts", F.col("found.capture_id").alias("response_id"), "resolution", merged.alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in order of name."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")
