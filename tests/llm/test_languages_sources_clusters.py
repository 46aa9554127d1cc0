"""Operators 11 to 13 against plain restatements."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import heap_clusters, language_mixture, queries, source_divergence
from crawlscope.llm.toxicity import held_out

from .conftest import TEXTS

SMALL = "/root/testdata/sf0.001"


# --- operator 11


def words(text):
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [run[i : i + 32] for run in runs for i in range(0, len(run), 32)]


def chain_model(rows):
    """P(word | language) from dictionaries of whole contexts, as the docstring states it."""
    grams = {lang: [Counter() for _ in range(3)] for lang, _ in rows}
    for lang, text in rows:
        for word in words(text):
            marked = "^^" + word + "$"
            for i in range(2, len(marked)):
                for order in range(3):
                    grams[lang][order][marked[i - order : i + 1]] += 1
    prior = Counter(lang for lang, _ in rows)

    def log_p(word, lang):
        one, two, three = grams[lang]
        total, out, marked = sum(one.values()), 0.0, "^^" + word + "$"
        after = lambda table, context: sum(n for g, n in table.items() if g[:-1] == context)
        for i in range(2, len(marked)):
            c, b, a = marked[i], marked[i - 1], marked[i - 2]
            p = (one[c] + 1) / (total + 4096)
            p = (two[b + c] + 4 * p) / (after(two, b) + 4)
            p = (three[a + b + c] + 4 * p) / (after(three, a + b) + 4)
            out += math.log(p)
        return out

    return sorted(grams), {lang: math.log(n / len(rows)) for lang, n in prior.items()}, log_p


def mixture(text, languages, prior, log_p):
    """Forward selection with expectation-maximisation, one document at a time."""
    bag = Counter(words(text))
    if not bag:
        return {}
    logs = {w: {lang: log_p(w, lang) for lang in languages} for w in bag}
    top = {w: max(x.values()) for w, x in logs.items()}
    p = {w: {lang: math.exp(v - top[w]) for lang, v in x.items()} for w, x in logs.items()}
    total = sum(bag.values())
    single = {lang: prior[lang] + sum(n * logs[w][lang] for w, n in bag.items()) for lang in languages}
    pi = {max(languages, key=lambda lang: single[lang]): 1.0}
    likelihood = lambda pi: sum(n * math.log(sum(pi[lang] * p[w][lang] for lang in pi)) for w, n in bag.items())
    while True:
        mixed = {w: sum(pi[lang] * p[w][lang] for lang in pi) for w in bag}
        rest = {lang: sum(n * p[w][lang] / mixed[w] for w, n in bag.items()) / total for lang in languages if lang not in pi}
        if not rest:
            return pi
        new = max(rest, key=lambda lang: rest[lang])
        trial = {**{lang: x / 2 for lang, x in pi.items()}, new: 0.5}
        for _ in range(50):
            moved = {lang: sum(n * trial[lang] * p[w][lang] / sum(trial[k] * p[w][k] for k in trial) for w, n in bag.items()) / total for lang in trial}
            change, trial = max(abs(moved[k] - trial[k]) for k in trial), moved
            if change < 1e-4:
                break
        if likelihood(trial) - likelihood(pi) <= 2 * math.log(total + 1):
            return pi
        pi = trial


WORDS = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing elit".split(), "bb": "über straße zwölf schön grün können heißt müde".split(), "cc": "the quick brown fox jumps over lazy dogs".split()}


def test_mixtures_equal_a_plain_restatement(spark):
    rng = random.Random(3)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    training = [(lang, say(lang, 12)) for lang in WORDS for _ in range(8)]
    texts = [say("aa", 20), say("bb", 20) + " " + say("cc", 9), say("cc", 3), "fox", say("aa", 10) + say("bb", 10) + " " + say("cc", 12), "", "123 _ ²½ Ⅷ!", "ünter dolorem foxes"]
    languages, prior, log_p = chain_model(training)
    wanted = [mixture(t, languages, prior, log_p) for t in texts]
    assert [len(w) for w in wanted[:7]] == [1, 2, 1, 1, 3, 0, 0]
    rows = [(i, t, lang, "train") for i, (lang, t) in enumerate(training)] + [(100 + i, t, None, "test") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    model = language_mixture.fit(docs, F.col("source") == "train")
    found = {r["doc_id"]: r for r in language_mixture.identify(docs.where("source = 'test'"), model).collect()}
    for i, own in enumerate(wanted):
        row = found[100 + i]
        assert row["lang_pred"] == (max(sorted(own), key=own.get) if own else "und")
        assert set(row["languages"]) == set(own) and all(abs(row["languages"][k] - v) < 1e-3 for k, v in own.items())
        assert row["score"] == 0 if not own else (0 < row["score"] <= 1 and (len(own) == 1 or abs(row["score"] - max(own.values())) < 1e-3))


def test_languages_of_odd_rows_and_long_texts(spark, odd_docs, no_docs, monkeypatch):
    nothing = language_mixture.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language_mixture.identify(odd_docs, nothing).collect()} == {"und"}
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") == 7, "xx").when(F.col("doc_id") != 2, "yy"))
    model = language_mixture.fit(docs, F.lit(True))
    assert model.languages == ["xx", "yy"]
    found = language_mixture.identify(docs, model).collect()
    assert len(found) == len(TEXTS) and {r["lang_pred"] for r in found if r["doc_id"] in (2, 3, 4)} >= {"und"}
    assert all(0 <= r["score"] <= 1 for r in found)
    assert language_mixture.identify(no_docs, model).count() == 0
    assert language_mixture.fit(docs.limit(0), F.lit(True)).languages == []
    whole = language_mixture.words("Ab cd, ab. " * 500)
    monkeypatch.setattr(language_mixture.tokens, "BATCH_CHARS", 64)
    assert language_mixture.words("Ab cd, ab. " * 500) == whole == {"ab": 1000, "cd": 500}
    assert max(map(len, language_mixture.words("語" * 100))) == language_mixture.LONGEST_WORD


def test_languages_that_hold_many_buckets(spark, monkeypatch):
    rows = [(i, f"word{'abcdefgh'[i % 8]} text", f"l{i % 8}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    whole = language_mixture.fit(docs, F.lit(True))
    monkeypatch.setattr(language_mixture, "HELD_LANGUAGES", 1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [r[2] for r in rows], "text": [r[1] for r in rows]})
    total = Counter()
    for out in language_mixture._count(iter([batch, batch])):
        for row in out.to_pylist():
            total[row["lang"], row["bucket"]] += row["n"]
    assert total["l3", language_mixture._DOCUMENTS] == 16 and len(whole.languages) == 8
    assert total["l3", language_mixture._LETTERS] == 2 * whole.letters[3]


def test_held_out_accuracy_of_the_query(spark):
    found = queries.QUERIES["op11_language_mixture"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in own) >= 0.95 * len(own) > 0
    held = spark.range(50).select(F.col("id"), held_out(F.col("id")).alias("h")).collect()
    import zlib

    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in held)


# --- operator 12


def audited(rows, least_docs, top):
    """The contract of operator 12, term by term."""
    rows = [(lang or "", source or "", Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, c in own for t in c)
        kept = sorted(t for t, n in docs.items() if n >= least_docs)
        sums = defaultdict(Counter)
        for _, source, c in own:
            sums[source].update(c)
            sums[None].update(c)
        share = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept} for s, c in sums.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in set(sums) - {None}:
            pairs = sorted(((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in set(sums) - {None, s}))
            terms = sorted((-f(share[s][t], share[None][t]), t.encode()) for t in kept if sums[s][t] and share[s][t] > share[None][t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows(n=150):
    rng = random.Random(8)
    pool = ["The", "the", "Straße", "a" * 8, "b" * 9, "c" * 16, "d" * 17, "d" * 16 + "e", "é" * 20, "日本語", "x" * 300, "x" * 299 + "y", "Éa", "word", "rare", "z" * 33]
    rows = [(rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "ß3", None]), rng.choice([None, "", "12 - 3", " ".join(rng.choice(pool[: 4 + i % 13]) + rng.choice(["", ",", "7", "'s"]) for _ in range(rng.randint(1, 30)))])) for i in range(n)]
    rows += [("en", "empty", ""), ("only", "one", "few words"), ("only", "two", None)] + [("en", "s1", "the the copy copy")] * 40
    return rows


@pytest.mark.parametrize("chunk, values", [(8 << 20, 1 << 20), (200, 4)])
def test_divergence_equals_a_plain_restatement(spark, monkeypatch, chunk, values):
    rows = divergence_rows() + [("en", "s2", "the end of " * 200 + "x" * 500)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string").repartition(4)
    if chunk < 1000:  # workers import the module anew, so small chunks run here
        monkeypatch.setattr(source_divergence, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(source_divergence, "MATRIX_VALUES", values)
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({k: pa.array([r[i] or "" for r in rows], pa.string()) for i, k in enumerate(["lang", "source", "text"])})
        found = Counter()
        for out in source_divergence._count(iter([batch.slice(3), batch.slice(0, 3)])):
            for r in out.to_pylist():
                found[r["lang"], r["source"], r["term"], "n"] += r["n"]
                found[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        wanted = Counter()
        for lang, source, text in rows:
            terms = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
            for t, n in terms.items():
                wanted[lang or "", source or "", t, "n"] += n
                wanted[lang or "", source or "", t, "docs"] += 1
        assert found == wanted
        return
    found = sorted(tuple(r) for r in source_divergence.audit(docs, least_docs=10, top=3).collect())
    assert found == audited(rows, 10, 3)
    assert {r[2] for r in found} == {"pair", "term"} and ("only", "one", "pair", "two", 0, 1) in found


def test_values_of_a_batch_in_small_matrices(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    p0 = [7, 11, 13, 40]
    rows = [{"lang": "ab"[t % 2], "at": [{"number": k, "p": int(rng.integers(1, 90)), "p0": p0[k]} for k in range(4) if rng.random() < 0.6]} for t in range(50)]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("at", pa.list_(pa.struct([("number", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())])))]))

    def total():
        out = Counter()
        for b in source_divergence._together(iter([batch])):
            for r in b.to_pylist():
                out[r["lang"], r["a"], r["b"]] += r["value"]
        return {k: v for k, v in out.items() if v}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    wanted = Counter()
    for r in rows:
        for x in r["at"]:
            for y in r["at"]:
                if x["number"] != y["number"]:
                    wanted[r["lang"], x["number"], y["number"]] += f(x["p"], y["p"]) - f(x["p"], y["p0"]) - f(x["p0"], y["p"]) + f(x["p0"], y["p0"])
    whole = total()
    monkeypatch.setattr(source_divergence, "MATRIX_VALUES", 4)
    assert whole == total() == {k: v for k, v in wanted.items() if v}


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 3, 500).astype(np.uint32), rng.integers(0, 2**63, 500).astype(np.uint64) % np.uint64(7) << np.uint64(50), rng.integers(0, 2, 500).astype(np.uint64)]
    assert source_divergence.radix_order(keys).tolist() == np.lexsort(keys[::-1]).tolist()


def test_divergence_of_nothing(spark, no_docs):
    docs = no_docs.withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    assert source_divergence.audit(docs).count() == 0
    rows = spark.createDataFrame([(None, None, None)], "lang string, source string, text string")
    assert source_divergence.audit(rows).count() == 0


# --- operator 13


def clustered(rows, dims, k, rounds):
    """Plain k-means in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in seeds]
    if not centroids:
        return []
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (distance(v, centroids[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, c, distance(v, centroids[c])) for (i, v), c in zip(kept, map(nearest, (v for _, v in kept)))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, c, d, sum(x[2] for x in out if x[1] == c), sum(x[2] for x in out), hashes[c]) for i, c, d in out)


def vectors(n, dims, kind, seed=2):
    rng = random.Random(seed)
    if kind == "grid":  # many ties
        rows = [(i, [float(rng.randint(0, 2)) / 1024 for _ in range(dims)]) for i in range(n)]
    elif kind == "copies":
        rows = [(i, [0.25] * dims if i % 3 else [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    else:
        rows = [(i, [rng.gauss(i % 5, 1) for _ in range(dims)]) for i in range(n)]
    odd = [(None, [0.5] * dims), (1, [0.5] * dims), (2, None), (3, [1.0]), (4, [float("nan")] * dims), (5, [None] * dims), (6, [float("inf")] * dims), (7, [0.0] * dims)]
    return rows + odd + rows[:3]


@pytest.mark.parametrize("kind", ["grid", "copies", "blobs"])
def test_clusters_equal_plain_k_means(spark, kind):
    rows = vectors(120, 4, kind)
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, block string").repartition(3)
    trace = []
    found = heap_clusters.cluster(df, dims=4, k=5, rounds=6, trace=trace)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found.collect()) == clustered(exact, 4, 5, 6)
    assert trace[0] == found.count() and (kind != "blobs" or sum(trace[1:]) < (len(trace) - 1) * trace[0])


def test_clusters_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in heap_clusters.cluster(df, dims=2).collect()) == clustered([tuple(r) for r in df.collect()], 2, 8, 10)
    assert heap_clusters.cluster(df.limit(1), dims=2).count() == 1
    none = heap_clusters.cluster(df, dims=3)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        heap_clusters.cluster(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>"), dims=2).count()


def test_blocks_stay_where_they_are(spark):
    df = spark.createDataFrame([(i, v) for i, v in vectors(40, 4, "blobs")], "vec_id long, embedding array<double>").repartition(3)
    blocks = heap_clusters.checkpoint_by_key(heap_clusters._blocks(heap_clusters.integer_vectors(df, "vec_id", "embedding", 4, 1024), 4), ["block"])
    seeds, drift = np.zeros((2, 4), np.int64), np.zeros(2)
    heaps = heap_clusters.written(heap_clusters.assign(blocks, None, seeds, drift), "heaps")
    plan = heap_clusters.assign(blocks, heaps, seeds, drift)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ShuffledHashJoin" in plan


def test_heaps_give_back_what_is_used_up():
    heaps = heap_clusters.Heaps(2)
    heaps.push(np.array([0, 1, 2, 3]), np.array([0, 1, 0, 0]), np.array([3.0, 1.0, 2.0, 9.0]))
    heaps = heap_clusters.Heaps(2, **heaps.packed())
    rows, clusters = heaps.pop(np.array([3.0, 0.5]))
    assert rows.tolist() == [2, 0] and clusters.tolist() == [0, 0]
    assert [x.tolist() for x in heaps.rows] == [[3], [1]]
