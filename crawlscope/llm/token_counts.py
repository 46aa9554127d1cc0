"""Operator 3: token counts from distinct pre-tokens.

A task reduces a block of documents to pre-token frequencies: for each distinct
pre-token its postings (place of the document in the block, frequency). They
are dealt by a hash of the pre-token into as many shares as the session has
shuffle partitions. The task of a share encodes each distinct pre-token in it
once, for its number of pieces only, joins the numbers to the postings, and
adds up (frequency x pieces) for each document that its share touches. A second
shuffle by block brings these sums home. No ids are kept anywhere.

Scale: the first shuffle carries about three bytes for each (document, distinct
pre-token) and the second at most as much (one sum for each document and share,
if that is less). The postings of a pre-token that ``COMMON_DOCS`` documents of
a block have are dealt by pre-token and block, so pre-tokens like " the" are
spread over all shares (and counted once in each). Of a rarer one, a share gets
less than ``COMMON_DOCS`` postings a block. A block holds at most
``BLOCK_DOCS`` documents or ``tokens.BATCH_CHARS`` characters (or one longer
document), which bounds a task's memory; a share is the whole divided by the
number of shuffle partitions.

Defined results: null and empty texts have 0 bytes and 0 tokens; every input
row gives one output row, so repeated rows and repeated or null ids stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .shared import picked

BLOCK_DOCS = 8_000
COMMON_DOCS = 16
_SPLIT = regex.compile(tokens.SPLIT_PATTERN)


def _pre_tokens(encoder: tokens.ByteLevelEncoder, units: list[str]) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of units that start and end at sure borders, and how many each has.

    Units below U+0250 are split by the tokenizer's pattern all at once, other
    units by the library; a unit with a special string stays whole.
    """
    plain = encoder.plain(units)
    at = np.flatnonzero(plain)
    chosen = [units[i] for i in at]
    found = _SPLIT.findall("".join(chosen))
    ends = np.cumsum([len(u) for u in chosen])
    stop = np.searchsorted(np.cumsum([len(p) for p in found]), ends) + 1
    counts = np.diff(stop, prepend=0)
    if len(at) == len(units):
        return found, counts
    out: list[list[str]] = [[]] * len(units)
    for i, a, b in zip(at.tolist(), (stop - counts).tolist(), stop.tolist()):
        out[i] = found[a:b]
    for i in np.flatnonzero(~np.array(plain)).tolist():
        unit = units[i]
        if any(s in unit for s in encoder.specials):
            out[i] = [unit]
        else:
            out[i] = [unit[a:b] for _, (a, b) in encoder.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]
    return [p for parts in out for p in parts], np.array([len(p) for p in out], np.int64)


def _blocks(batches, names=("id", "text")) -> Iterator[tuple[list, list[str]]]:
    """Rows of Arrow batches in blocks of bounded size."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(names[0]).to_pylist(), batch.column(names[1]).to_pylist()):
            t = t or ""
            if ids and (size + len(t) > tokens.BATCH_CHARS or len(ids) >= BLOCK_DOCS):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


def _frequencies(encoder: tokens.ByteLevelEncoder, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a block; and by pre-token: its number, the place of a text, and how often it is there."""
    parts = [(i, p) for i, t in enumerate(texts) for p in tokens.parts(t)]
    owner, units, numbers = encoder.units(pa.array([p for _, p in parts], pa.large_string()))
    found, counts = _pre_tokens(encoder, units)
    coded = pa.array(found, pa.large_string()).dictionary_encode()
    code = np.asarray(coded.indices).astype(np.int64)
    starts = np.cumsum(counts) - counts
    each = counts[numbers]
    place = np.repeat(np.array([i for i, _ in parts], np.int64)[owner], each)
    key, often = np.unique(code[tokens.ragged(starts[numbers], each)] * len(texts) + place, return_counts=True)
    return coded.dictionary.to_pylist(), key // len(texts), key % len(texts), often


def _text_blob(words: pa.Array) -> bytes:
    """Strings as one compressed binary: byte lengths, then the bytes."""
    lengths = pc.binary_length(words).to_numpy().astype("<u4").tobytes()
    return len(words).to_bytes(4, "little") + zlib.compress(lengths + "".join(words.to_pylist()).encode(), 1)


def _strings(blob: bytes) -> pa.Array:
    n, raw = int.from_bytes(blob[:4], "little"), zlib.decompress(blob[4:])
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[4 * n :]))


def _shares(number: int, texts: list[str], encoder: tokens.ByteLevelEncoder, shares: int) -> Iterator[tuple]:
    """Of a block: (share, words, postings of each word, places, frequencies) by share."""
    words, code, place, often = _frequencies(encoder, texts)
    docs_of = np.bincount(code, minlength=len(words))
    home = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
    home = np.where(docs_of >= COMMON_DOCS, home ^ (number * 2654435761 & 0xFFFFFFFF), home) % shares
    in_order = pc.sort_indices(pa.array(words, pa.large_string())).to_numpy().astype(np.int64)
    in_order = in_order[docs_of[in_order] > 0]  # a text's first word may stand here with a space that it doesn't have
    order = in_order[np.argsort(home[in_order], kind="stable")]
    starts = np.cumsum(docs_of) - docs_of
    at = tokens.ragged(starts[order], docs_of[order])
    place, often = place[at], often[at]
    # a frequency has one byte; higher ones take several postings
    split = (often + 254) // 255
    byte = np.full(int(split.sum()), 255, np.uint8)
    byte[np.cumsum(split) - 1] = often - 255 * (split - 1)
    place = np.repeat(place, split).astype("<u2")
    if not len(order):
        return
    docs_of = np.add.reduceat(split, np.cumsum(docs_of[order]) - docs_of[order])
    ends = np.cumsum(docs_of)
    sorted_words = pa.array(words, pa.large_string()).take(pa.array(order))
    cuts = np.flatnonzero(np.diff(home[order], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        lo, hi = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
        yield int(home[order[a]]), _text_blob(sorted_words.slice(a, b - a)), docs_of[a:b].astype("<u4").tobytes(), place[lo:hi].tobytes(), byte[lo:hi].tobytes()


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` of every row of docs."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokens.read_vocabulary(spark, vocabulary_path))
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = picked(docs, id=id_col, text=text_col)
    id_type = docs.schema["id"].dataType
    ids = [T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_bytes", T.ArrayType(T.LongType()))]
    dealt = T.StructType([T.StructField("share", T.LongType()), T.StructField("block", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("words", "docs_of", "places", "often")), *ids])
    summed = T.StructType([T.StructField("block", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("sums", T.BinaryType()), *ids])
    dealt_arrow, summed_arrow = (pa.schema([(f.name, to_arrow_type(f.dataType)) for f in s]) for s in (dealt, summed))

    def deal(batches):
        from pyspark import TaskContext

        encoder = tokens.worker_encoder(vocabulary)
        number = TaskContext.get().partitionId() << 33
        for own, texts in _blocks(batches):
            rows = [(share, number, *x, None, None) for share, *x in _shares(number, texts, encoder, shares)]
            rows.append((zlib.crc32(number.to_bytes(8, "little")) % shares, number, None, None, None, None, own, [len(t.encode()) for t in texts]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), dealt_arrow)], schema=dealt_arrow)
            number += 1

    def add(share: pa.Table) -> pa.Table:
        own = share.filter(pc.is_valid(share["ids"]))
        rows = share.filter(pc.is_valid(share["words"])).sort_by("block")
        encoder = tokens.worker_encoder(vocabulary)
        blobs = [_strings(b) for b in rows["words"].to_pylist()]
        blocks, places, sums = [], [], []
        if blobs:
            coded = pa.concat_arrays(blobs).dictionary_encode()
            pieces = encoder.unit_counts(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
            at = 0
            for block, words, docs_of, place, often in zip(rows["block"].to_pylist(), blobs, *(rows[c].to_pylist() for c in ("docs_of", "places", "often"))):
                n = np.repeat(pieces[at : at + len(words)], np.frombuffer(docs_of, "<u4")) * np.frombuffer(often, np.uint8)
                at += len(words)
                total = np.bincount(np.frombuffer(place, "<u2"), n)
                hit = np.flatnonzero(total)
                blocks.append(block)
                places.append(hit.astype("<u2").tobytes())
                sums.append(total[hit].astype("<u4").tobytes())
        none = [None] * own.num_rows
        return pa.Table.from_arrays([
            pa.array(blocks + own["block"].to_pylist(), pa.int64()), pa.array(places + none, pa.binary()), pa.array(sums + none, pa.binary()),
            *(pa.array([None] * len(blocks) + own[c].to_pylist(), summed_arrow.field(c).type) for c in ("ids", "n_bytes")),
        ], schema=summed_arrow)

    out = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out_arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def home(block: pa.Table) -> pa.Table:
        own = block.filter(pc.is_valid(block["ids"]))
        ids, n_bytes = own["ids"].to_pylist()[0], own["n_bytes"].to_pylist()[0]
        places = np.frombuffer(b"".join(x for x in block["places"].to_pylist() if x), "<u2")
        sums = np.frombuffer(b"".join(x for x in block["sums"].to_pylist() if x), "<u4")
        total = np.bincount(places, sums, len(ids)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(ids, out_arrow.field(0).type), pa.array(n_bytes, pa.int64()), pa.array(total)], schema=out_arrow)

    postings = docs.mapInArrow(deal, dealt)
    return postings.groupBy("share").applyInArrow(add, summed).groupBy("block").applyInArrow(home, out)
