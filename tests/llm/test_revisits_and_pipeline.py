"""Operator 5 against a plain loop, and the pipeline against its operators' brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crawlscope.llm import revisits

SCHEMA = "capture_id long, url string, ts timestamp, kind string, status int, headers map<string,string>, payload_digest string, slice int"
START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def test_resolutions_and_headers(spark):
    stored = {"ETag": '"a"', "Last-Modified": "L", "Content-Length": "9", "X-Keep": "k", "x-null": None}
    rows = [
        (1, "http://Example.org:80/p?b=2&a=1&utm_source=q#f", at(0), "response", 200, stored, "d1", 0),
        (2, "https://example.org/p?a=1&b=2", at(1), "response", 404, {"etag": '"z"'}, None, 0),
        (3, "https://example.org/p?a=1&b=2", at(90), "revisit", 304, {"ETAG": 'W/"a"', "Content-Length": "0", "Connection": "X-Hop", "X-Hop": "1", "Date": "now"}, None, 0),
        (4, "https://example.org/p?a=1&b=2", at(91), "revisit", 304, {"etag": '"b"'}, None, 0),
        (5, "https://example.org/p?a=1&b=2", at(92), "revisit", 304, {}, None, 0),
        (6, "https://example.org/p?a=1&b=2", at(93), "revisit", 304, {"etag": '"b"'}, "d1", 0),
        (7, "https://example.org/p?a=1&b=2", at(0), "revisit", 304, None, None, 0),
        (8, None, at(1), "revisit", 304, {"a": "b"}, None, 0), (9, "http://example.org/p?a=1&b=2", None, "revisit", 304, None, None, 0),
        (10, "http://example.org", at(5), "revisit", 304, None, None, 0), (11, "http://example.org/", at(4), "response", 200, None, None, 0),
        (12, "http://example.org/", at(4), "response", 200, {"A": "1"}, None, 0), (10, "http://example.org", at(5), "revisit", 304, None, None, 0), (13, "x", at(9), "other", 200, None, None, 0),
    ]
    found = revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r["capture_id"]: r for r in found}
    assert len(found) == 9
    assert {k: (r["response_id"], r["resolution"]) for k, r in by.items()} == {
        3: (1, "resolved"), 4: (1, "mismatch"), 5: (1, "assumed"), 6: (1, "resolved"), 7: (None, "no_response"), 8: (None, "no_response"), 9: (None, "no_response"), 10: (12, "assumed")}
    assert by[3]["headers"] == {"etag": 'W/"a"', "last-modified": "L", "content-length": "9", "x-keep": "k", "date": "now"}
    assert by[4]["headers"] == {"etag": '"b"'} and by[8]["headers"] == {"a": "b"} and by[10]["headers"] == {"a": "1"}
    assert by[3]["url_key"] == "example.org/p?a=1&b=2"
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("slice_seconds", [3600, 10**9])
def test_as_of_join_of_a_hot_url(spark, slice_seconds):
    rnd = random.Random(2)
    rows = [(k, rnd.choice(["http://h.org/"] * 5 + ["http://h.org/a", "http://h.org/b"]), at(rnd.randrange(40)), rnd.choice(["response", "revisit"]), rnd.choice([200, 200, 500]), None, None, 1) for k in range(300)]
    found = {r["capture_id"]: r["response_id"] for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA), slice_seconds).collect()}
    full = [r for r in rows if r[3] == "response" and r[4] == 200]
    wanted = {r[0]: max(((x[2], x[0]) for x in full if x[1] == r[1] and x[2] < r[2]), default=(None, None))[1] for r in rows if r[3] == "revisit"}
    assert found == wanted


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    docs, toxic = [], set()
    for k in range(120):
        body = text(40)
        if k % 4 == 1:
            body, _ = f"{body} hatefulword {text(5)}", toxic.add(k)
        docs.append([k, body, "en", "s", 0])
    docs[8][1] = docs[2][1] + " extra"
    docs[12][1] = f"{text(20)} {item} {text(20)}"
    docs[16][1] = f"{text(20)} password=abcdef123 {text(20)}"
    docs += [[200, None, None, None, None], [201, "", "en", "s", 0], [3, docs[3][1], "en", "s", 0]]
    docs = [[i, t, la, s, None if t is None else len(t)] for i, t, la, s, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now
    ids = lambda name: sorted(r["doc_id"] for r in seen[name].select("doc_id").collect())
    clean = sorted(d[0] for d in docs if d[0] not in toxic)
    assert ids("toxicity") == clean
    once = sorted(set(clean) - {8, 201})
    assert ids("near_duplicates") == once
    assert ids("decontamination") == sorted(set(once) - {12})
    assert ids("secrets") == ids("decontamination")
    changed = {r["doc_id"]: r for r in seen["secrets"].collect()}
    before = {r["doc_id"]: r for r in seen["decontamination"].collect()}
    assert [k for k in changed if changed[k] != before[k]] == [16]
    assert "<assign>" in changed[16]["text"] and changed[16]["n_chars"] == len(changed[16]["text"])
    assert all(seen[name].columns == seen["toxicity"].columns for name, _ in corpus_pipeline.STAGES[:-1])
    assert sorted({r["doc_id"] for r in seen["packing"].collect()}) == ids("secrets")
    whole = seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 1024 for r in whole)
    assert len(whole) == -(-sum(r["n"] for r in whole) // 1024)
