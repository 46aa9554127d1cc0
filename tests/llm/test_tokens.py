"""Operators 2, 3 and 10: ids against the library, whole round trips, packing."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlscope.llm import huffman, packing, token_counts, tokens
from crawlscope.llm.shared import shared_path

from .conftest import TEXTS, VOCABULARY

LIBRARY = Tokenizer.from_file(VOCABULARY)
ENCODER = tokens.ByteLevelEncoder(open(VOCABULARY, encoding="utf-8").read())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ODD = [*" \x01\x02\n\t\r\x0b\x1c\x85\xa0\u2003ab'sé日.,!1²ªſ<|>", "<|endoftext|>", "  ", "it's"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=25).map("".join), max_size=4))
def test_ids_equal_the_library(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


def test_long_texts_are_cut_at_sure_borders(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_CHARS", 50)
    text = "Some words, 12 marks\nand lines  with   spaces \n " * 9 + "y" * 120 + " end"
    assert [x.tolist() for x in ENCODER.encode([text, None, "a b"])] == [ids_of(text), [], ids_of("a b")]


def test_token_counts(spark, odd_docs, no_docs):
    found = token_counts.count_tokens(odd_docs, VOCABULARY).collect()
    assert Counter(map(tuple, found)) == Counter((i, len((t or "").encode()), len(ids_of(t))) for i, t in TEXTS)
    assert token_counts.count_tokens(no_docs, VOCABULARY).count() == 0


def test_common_words_are_dealt_by_block(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 40)
    rows = [(i, "the same words " * (i % 7) + f"and number{i} " + "z " * (300 if i == 3 else 0)) for i in range(200)]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in found} == {(i, len(ids_of(t))) for i, t in rows}


@pytest.mark.parametrize("counts", [[0, 5], [1, 1], [3, 0, 0, 9, 1], [1 << k for k in range(30)], [1] * 300])
def test_code_lengths(counts):
    counts = np.array(counts)
    bits = huffman.code_lengths(counts, 12)
    used = bits[counts > 0].astype(int)
    assert used.max() <= 12 and (bits[counts == 0] == 0).all()
    assert len(used) < 2 or (2.0 ** -used).sum() == 1
    ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 40))
    np.random.default_rng(0).shuffle(ids)
    payload, at = huffman.encode_ids(ids, huffman.canonical_codes(bits), bits)
    marks = at[::7]
    lanes = np.full(len(marks), 7)
    lanes[-1] = len(ids) - 7 * (len(marks) - 1)
    assert (huffman.Decoder(bits).decode(payload, marks, lanes) == ids).all()


def test_length_limit_is_optimal():
    # brute force over all length vectors of at most 3 bits that a prefix code can have
    counts = np.array([1, 1, 2, 4, 8])
    best = min(sum(n * b for n, b in zip(counts, bits)) for bits in itertools.product((1, 2, 3), repeat=5) if sum(2.0 ** -b for b in bits) <= 1)
    assert (huffman.code_lengths(counts, 3) * counts).sum() == best


def test_huffman_files(spark, odd_docs, no_docs):
    path = shared_path(spark, "test-huffman")
    huffman.write(odd_docs, path, VOCABULARY, 2)
    found = sorted(huffman.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in found] == sorted((r["doc_id"] is None for r in found), reverse=True)
    ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert ids == sorted(ids)
    at = 0
    for r in found:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    whole = Counter((i, np.array(ids_of(t) + [2], "<u4").tobytes()) for i, t in TEXTS)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == whole
    crc = huffman.crc32_of(huffman.read(spark, path)).filter("doc_id = 9").first()["ids_crc32"]
    assert crc == zlib.crc32(np.array(ids_of("x" * 5000) + [2], "<u4").tobytes())
    empty = shared_path(spark, "test-huffman")
    huffman.write(no_docs, empty, VOCABULARY, 2)
    assert huffman.read(spark, empty).count() == 0


def laid_out(steps):
    sequences = defaultdict(list)
    for length, lo, hi, first, offset in steps:
        for k in range(hi - lo):
            sequences[first + k].append((offset, length))
    return sequences


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=33, max_size=33))
def test_plan_packs_every_piece_once(counts):
    counts = np.array([0, *counts[1:]])
    sequences = laid_out(packing.plan(counts))
    assert Counter(length for s in sequences.values() for _, length in s) == Counter({n: c for n, c in enumerate(counts) if c})
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 32
    assert len(sequences) <= best_fit_decreasing(counts, 32)


def best_fit_decreasing(counts, capacity):
    """Sequences of plain best fit, piece by piece."""
    gaps = []
    for length in range(capacity, 0, -1):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            gap = min(fits) if fits else capacity
            if fits:
                gaps.remove(gap)
            gaps.append(gap - length)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=257, max_size=257), st.integers(0, 10**6))
def test_all_plans_pack_every_piece(counts, seed):
    rng = np.random.default_rng(seed)
    counts = np.array([0, *counts[1:]]) * (rng.random(257) < rng.choice([0.05, 0.3, 0.9]))
    least = min(p.sequences for p in packing.plans(counts))
    assert least <= best_fit_decreasing(counts, 256)
    for p in packing.plans(counts):
        assert not p.left.any() and (p.used == counts).all()
        sequences = laid_out(p.steps)
        assert len(sequences) == p.sequences and max((sum(n for _, n in s) for s in sequences.values()), default=0) <= 256


def test_sums_of_the_index():
    rng = np.random.default_rng(6)
    for _ in range(200):
        left = rng.integers(0, 3, 25)
        index = packing.SumIndex(left, 1, bool(rng.integers(2)))
        total = int(rng.integers(3, 24))
        for find, parts in ((index.single, 1), (index.pair, 2), (index.triple, 3)):
            every = [c for c in itertools.combinations_with_replacement(range(1, 25), parts) if sum(c) == total and all(left[x] >= c.count(x) for x in c)]
            found = find(total)
            assert (found is None) == (not every) and (found is None or tuple(sorted(found)) in every)


def test_documents_need_few_sequences(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    counts = np.zeros(1025, np.int64)
    for ids in ENCODER.encode(texts):
        counts[(len(ids) + 1) % 1024 or 1024] += 1
        counts[1024] += len(ids) // 1024
    steps = packing.plan(counts)
    assert max(first + hi - lo for _, lo, hi, first, _ in steps) <= best_fit_decreasing(counts, 1024) == 193


@pytest.mark.parametrize("lengths", [[7, 3], [6, 2, 2], [5, 2, 2, 1]])
def test_exact_complements_fill_sequences(lengths):
    counts = np.bincount(lengths, minlength=11) * 50
    assert len(laid_out(packing.plan(counts))) == 50


def test_pack(spark, odd_docs, no_docs):
    found = packing.pack(odd_docs, VOCABULARY, 2, capacity=64).collect()
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in found:
        pieces[r["doc_id"], r["start"] + r["length"], r["piece"]].append(bytes(r["ids"]))
        places[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    wanted = Counter()
    for i, t in TEXTS:
        ids = ids_of(t) + [2]
        first = len(ids) % 64 or 64
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            b = first if k == 0 else a + 64
            wanted[i, b, k, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert Counter((*k, x) for k, v in pieces.items() for x in v) == wanted
    for s in places.values():
        at = 0
        for offset, length, ids in sorted(s):
            assert offset == at and len(ids) == 4 * length
            at += length
        assert at <= 64
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pack(odd_docs, VOCABULARY, 2, capacity=64)).collect()}
    assert sorted(map(len, whole.values())) == sorted(4 * sum(n for _, n, _ in s) for s in places.values())
    assert packing.pack(no_docs, VOCABULARY, 2).count() == 0
