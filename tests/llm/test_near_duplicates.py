"""Operators 4 and 8 against brute force over all pairs."""

import contextlib
import math
import os
import random
import threading
from collections import Counter

import numpy as np
import pytest

from crawlscope.llm import bag_minhash, embedding_dups
from crawlscope.llm import components as comps
from crawlscope.llm.components import components

from .conftest import TEXTS


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("links_of_task", [1_000_000, 8])
def test_components_of_a_long_path(spark, monkeypatch, links_of_task):
    monkeypatch.setattr(comps, "LINKS_OF_TASK", links_of_task)
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100), (100, 150)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100}
    assert components(links.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(150):
        shingle = rng.integers(0, 2**48, 25).astype(np.uint64)
        a = rng.integers(0, 12, 25)
        b = np.maximum(a + rng.integers(-4, 5, 25) * (rng.random(25) < 0.6), 0)
        one, two = (bag_minhash.signatures(np.zeros((w > 0).sum(), np.int64), shingle[w > 0], w[w > 0], 1)[0] for w in (a, b))
        errors.append((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5 + 1e-3
    assert np.std(errors) < 0.07


def bag(text):
    words = "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def overlap(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for size in (1, 1, 2, 5, 30):
        base = [word() for _ in range(rnd.randint(40, 120))]
        for k in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, 5) if k else 0):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [texts[7], texts[7].upper() + "!", "a few", "A few.", "same line here now ok " * 30, "same line here now ok " * 31, "same line here now ok " * 12]
    return texts


@pytest.mark.parametrize("block", [512, 4])
def test_classes_are_those_of_all_pairs(spark, copies, monkeypatch, block):
    monkeypatch.setattr(bag_minhash, "BLOCK", block)
    bags = [bag(t) for t in copies]
    wanted = groups(len(copies), lambda a, b: overlap(bags[a], bags[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["class_id"] for r in bag_minhash.document_classes(docs).collect()}
    assert [found[k] for k in range(len(copies))] == wanted


def test_dense_blocks_are_compared_by_products(copies):
    sets = [np.unique([hash(x) & 0xFFFFFFFF for x in bag(t)]).astype(np.uint32) for t in copies]
    both = bag_minhash._overlaps(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i))


def test_odd_documents(spark, odd_docs, no_docs):
    found = Counter((r["doc_id"], r["class_id"]) for r in bag_minhash.document_classes(odd_docs).collect())
    assert found == Counter({(1, 1): 2, (5, 1): 1, (2, 2): 2, (3, 2): 1, (None, 2): 1, (4, 4): 1, (None, None): 1, (7, 7): 1, (8, 8): 1, (9, 9): 1, (10, 10): 1})
    assert bag_minhash.document_classes(no_docs).count() == 0
    kept = bag_minhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 4, None, 7, 8, 9, 10])
    assert len(TEXTS) == odd_docs.count()


@pytest.mark.parametrize("task", [16, 1])
def test_links_are_those_of_all_pairs(spark, monkeypatch, task):
    monkeypatch.setattr(embedding_dups, "BLOCK", 16)
    monkeypatch.setattr(embedding_dups, "BLOCKS_OF_TASK", task)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 24))
    noise = rng.standard_normal((160, 24)) * rng.uniform(0, 0.45, (160, 1))
    vectors = np.concatenate([base, base[rng.integers(0, 6, 160)] + noise, np.repeat(base[:1], 30, axis=0), base[2:3] * 3e20]).astype(np.float64)
    unit = vectors / np.linalg.norm(vectors / 1e20, axis=1, keepdims=True) / 1e20
    near = unit @ unit.T >= 0.95
    wanted = groups(len(vectors), lambda a, b: near[a, b])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)]
    found = {r["vec_id"]: r for r in embedding_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int").repartition(3)).collect()}
    assert len(found) == len(vectors)
    assert all(found[i]["n_links"] == near[i].sum() - 1 for i in found)
    assert all(found[i]["component_id"] == wanted[i] and found[i]["kept"] == (wanted[i] == i) for i in found)


def shuffle_bytes(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    total = 0
    for folder, _, names in (x for d in dirs for x in os.walk(d.getPath())):
        for name in (n for n in names if n.startswith("shuffle_")):
            with contextlib.suppress(OSError):  # a file may go meanwhile
                total += os.path.getsize(os.path.join(folder, name))
    return total


def test_disk_follows_the_vectors(spark, monkeypatch):
    """Small blocks stand for many vectors; sending each block to each block near it took 38 times their bytes."""
    monkeypatch.setattr(embedding_dups, "BLOCK", 16)
    monkeypatch.setattr(embedding_dups, "BLOCKS_OF_TASK", 2)
    rng = np.random.default_rng(18)
    base = rng.standard_normal((2400, 64))
    vectors = np.concatenate([base, base[:400] + rng.standard_normal((400, 64)) * 0.2, base[:1] + rng.standard_normal((200, 64)) * 0.05])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    wanted = groups(len(vectors), lambda a, b: near[a, b])
    frame = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>").repartition(3).localCheckpoint()
    seen, over = [shuffle_bytes(spark)], threading.Event()

    def watch():
        while not over.wait(0.02):
            seen.append(shuffle_bytes(spark))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = {r["vec_id"]: r for r in embedding_dups.near_duplicates(frame).collect()}
    finally:
        over.set()
        watcher.join()
    assert all(found[i]["n_links"] == near[i].sum() - 1 for i in range(len(vectors)))
    assert all(found[i]["component_id"] == wanted[i] for i in range(len(vectors)))
    assert max(seen) - seen[0] < 6 * vectors.nbytes


def test_cells_miss_a_pair_no_more_than_the_first_window():
    window = math.erfc(embedding_dups.FIRST_WINDOW_SD / math.sqrt(2))
    rng = np.random.default_rng(3)
    u = rng.standard_normal((4000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    other = rng.standard_normal(u.shape)
    other -= (other * u).sum(axis=1, keepdims=True) * u
    v = 0.95 * u + (1 - 0.95**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    assert embedding_dups.cells_for(10_000, 0.95) == embedding_dups.ONE_CELL
    for number in (200_000, 20_000_000):
        cells = embedding_dups.cells_for(number, 0.95)
        p = embedding_dups.shared_part(0.95)[cells.parts] ** cells.levels
        assert (1 - p) ** cells.tables <= window
        shared = embedding_dups._cells_of(u, cells) == embedding_dups._cells_of(v, cells)
        assert shared.mean() > p - 0.01 and shared.any(axis=1).all()


@pytest.mark.parametrize("needed", [16, 14, 13, 9])
def test_collisions_are_counted(needed):
    rng = np.random.default_rng(needed)
    q, y = (rng.integers(-63, 64, (16, n)).astype(np.int8) // spread for n, spread in ((50, 3), (70, 3)))
    words = embedding_dups._collided(q, embedding_dups._missed(y), needed)
    hit = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(bool)
    count = (abs(q[:, :, None].astype(int) - y[:, None, :]) <= embedding_dups.QUANTA + 1).sum(axis=0)
    assert (hit[:, :70] == (count >= needed)).all() and not hit[:, 70:].any()
    assert sorted(zip(*(x.tolist() for x in embedding_dups._set_bits(words)))) == list(zip(*(x.tolist() for x in np.nonzero(hit))))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, float("nan")]), (7, [1.0, None]), (8, [float("inf"), 1.0]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-30, 0.0]), (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = Counter(map(tuple, embedding_dups.near_duplicates(vectors).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert found == Counter([*alone, (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (11, 3, 1, False), (12, 1, 12, True), (13, 1, 12, False), (None, 0, None, False)])
    assert embedding_dups.near_duplicates(vectors.limit(0)).count() == 0


def test_calibrated_count():
    assert embedding_dups.needed_collisions(0.9999) >= embedding_dups.needed_collisions(0.999999)
    rng = np.random.default_rng(2)
    u = rng.standard_normal((4000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    other = rng.standard_normal(u.shape)
    other -= (other * u).sum(axis=1, keepdims=True) * u
    v = 0.95 * u + (1 - 0.95**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    window = embedding_dups.WINDOW_SD * (2 - 2 * 0.95) ** 0.5
    hits = (abs((u - v) @ embedding_dups.directions(32).T) <= window).sum(axis=1)
    assert (hits >= embedding_dups.needed_collisions()).mean() > 0.998
