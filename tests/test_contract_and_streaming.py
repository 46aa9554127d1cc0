"""Driver contract, exact-HTML mode agreement, streaming live views."""

import __spark_entry__ as E
from pyspark.sql import functions as F

from crawlscope.operators import exact_html as X
from crawlscope.operators import links as L
from crawlscope.operators import pages as P
from crawlscope.streaming import live as LV
from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["site", "target_norm", "n_sources", "referrers"]
    assert df.count() > 0


def test_oracle_keys_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_exact_mode_agrees_with_regex_mode(spark):
    pages = P.stored_pages_as_fetches(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))
    a = L.extract_links(pages)
    b = X.extract_links_exact(pages)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_counters_equal_batch(spark):
    reqs = LV.request_stream(LV.event_stream(spark, SF_SMALL))
    live = LV.run_to_table(LV.live_counters(reqs), "update", ["host"])
    batch = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        (F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"), F.lit(".example"))).alias("host"))
    want = {r.host: r["count"] for r in batch.groupBy("host").count().collect()}
    assert {r.host: r.total_crawled for r in live.collect()} == want


def test_referrer_buffer_caps_and_releases(spark):
    reqs = LV.request_stream(LV.event_stream(spark, SF_SMALL))
    plain = LV.cap_referrers(LV.run_to_table(LV.referrer_buffer(LV.link_and_page_events(reqs)), "append"))
    reqs = LV.request_stream(LV.event_stream(spark, SF_SMALL))
    out = LV.cap_referrers(LV.run_to_table(LV.referrer_buffer(LV.link_and_page_events(reqs), salts=4), "append"))
    assert out.exceptAll(plain).count() == 0 and plain.exceptAll(out).count() == 0
    per_target = out.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_url").alias("d"))
    assert per_target.where("n > 50 OR n <> d").count() == 0
    assert out.count() > 0


def test_referrer_state_holds_many_targets_and_takes_the_first_sources():
    import pandas as pd

    class State:
        get = None
        exists = property(lambda self: self.get is not None)

        def update(self, value):
            self.get = value

    def batch(*rows):
        return pd.DataFrame(rows, columns=["target", "kind", "source_url", "link_text", "micros"])

    def released(*chunks):
        return sorted((r.target, r.source_url, r.micros) for out in LV._referrer_state((0, 0), iter(chunks), state) for r in out.itertuples())

    state, n = State(), LV.MAX_REFERRERS
    late = batch(*[("a", "link", f"s{k}", "x", k) for k in range(10, n + 30)])
    early = batch(*[("a", "link", f"s{k}", "x", k) for k in range(10)], ("a", "link", "s0", "again", 5), ("b", "link", "s1", "x", 7))
    assert released(late, early) == []
    assert released(batch(("a", "page", "", "", 100))) == sorted(("a", f"s{k}", k) for k in range(n))
    assert released(batch(("b", "link", "s1", "x", 200), ("b", "link", "s2", "x", 201), ("a", "link", "new", "x", 202))) == []
    assert released(batch(("b", "page", "", "", 300), ("b", "link", "s3", "x", 301))) == [("b", "s1", 7), ("b", "s2", 201), ("b", "s3", 301)]
    assert released(batch(("b", "page", "", "", 400), ("b", "link", "s4", "x", 401))) == [("b", "s4", 401)]
