"""Operator 10: token ids in canonical length-limited Huffman code.

Writing (``write``): each whole text is tokenized once, where it lies, and gets
the end id; the ids go to a table in the shared folder, together with the counts
of the ids that each task met. The summed counts (one row a distinct id) give
optimal code lengths of at most ``MAX_BITS`` bits (package-merge on the driver:
its size is the vocabulary's), and the canonical code follows from the lengths
alone. Then the ids, a third of the text's size, are range-partitioned by
document id, sorted, and packed into blocks as they come out of the sort.

File format, a folder with three Parquet tables that any Hadoop file system holds:

* ``codebook``: ``id``, ``bits``;
* ``parts``: ``part``, ``base`` (ids of all parts before);
* ``blocks``: ``part``, ``block``, ``start`` (ids of the part before the block),
  ``doc_ids``, ``doc_lengths``, ``checkpoints`` (little-endian unsigned 64-bit
  bit offsets of every ``CHECKPOINT_IDS``-th id), ``payload`` (codes, most
  significant bit first, in big-endian 32-bit words). A block holds whole
  documents in ascending id order: it is closed when it has ``BLOCK_IDS`` ids.

Reading (``read``): each block is decoded by itself with one table of
``2 ** MAX_BITS`` entries; the checkpoints of a batch of blocks are so many
lanes that step together through numpy, so decoding is a few vector
operations an id position, not a Python step an id.

Scale: one pass of tokenizing, one shuffle (ids by range; document ids with many
rows are split by text hash); nothing but the codebook and one number per
partition passes through the driver. Ids of a document larger than a block
make a block of their own.

Defined results: a null or empty text is the end id alone; rows with equal or
null ids stay, nulls first, and equal ids are ordered by text hash; an empty
table writes no blocks; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .shared import frugal, picked, written

MAX_BITS = 18
BLOCK_IDS = 32_768
CHECKPOINT_IDS = 512
#: ids that are decoded together
DECODE_IDS = 1_000_000


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most max_bits; 0 for symbols that don't occur."""
    bits = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols have no code of {max_bits} bits")
    if len(used) < 2:
        bits[used] = 1
        return bits
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, items = [], leaves
    is_leaf = np.ones(len(leaves), bool)
    levels.append(is_leaf)
    for _ in range(max_bits - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        items, is_leaf = both[by], by < len(leaves)
        levels.append(is_leaf)
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    bits[order] = lengths
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: by length, then by symbol."""
    codes = np.zeros(len(bits), np.uint64)
    used = np.flatnonzero(bits)
    order = used[np.lexsort((used, bits[used]))]
    widths = bits[order].astype(np.uint64)
    top = int(widths[-1]) if len(widths) else 0
    step = np.uint64(1) << (np.uint64(top) - widths)
    codes[order] = (np.cumsum(step) - step) >> (np.uint64(top) - widths)
    return codes


def encode_ids(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed codes of ids, and the bit offset of each."""
    if not len(ids):
        return b"", np.empty(0, np.int64)
    width = bits[ids].astype(np.int64)
    end = np.cumsum(width)
    at = end - width
    word = at >> 5
    shifted = codes[ids] << (64 - (at & 31) - width).astype(np.uint64)
    # a code is shorter than a word, so a code starts in every word
    first = np.flatnonzero(np.diff(word, prepend=-1))
    both = np.bitwise_or.reduceat(shifted, first)
    out = np.zeros(int(word[-1]) + 2, np.uint32)
    out[:-1] |= (both >> np.uint64(32)).astype(np.uint32)
    out[1:] |= both.astype(np.uint32)
    return out[: int(-(-end[-1] // 32))].astype(">u4").tobytes(), at


class Decoder:
    """Decodes many lanes (bit offset, number of ids) of one buffer together."""

    def __init__(self, bits: np.ndarray):
        self.top = int(bits.max(initial=1))
        codes = canonical_codes(bits)
        used = np.flatnonzero(bits)
        order = used[np.lexsort((used, bits[used]))]
        spans = 1 << (self.top - bits[order].astype(np.int64))
        size = 1 << self.top
        self.symbol = np.zeros(size, np.uint32)
        self.width = np.zeros(size, np.uint8)
        starts = codes[order].astype(np.int64) << (self.top - bits[order].astype(np.int64))
        where = tokens.ragged(starts, spans)
        self.symbol[where] = np.repeat(order, spans)
        self.width[where] = np.repeat(bits[order], spans)

    def decode(self, payload: bytes, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """ids of the lanes, one lane after another."""
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-4] << 24 | raw[1:-3] << 16 | raw[2:-2] << 8 | raw[3:-1]
        by = np.argsort(-counts, kind="stable")  # lanes that go on longest come first
        at, left = offsets[by].astype(np.int64), counts[by]
        steps = int(left[0]) if len(left) else 0
        out = np.zeros((steps, len(by)), np.uint32)
        mask = np.uint32((1 << self.top) - 1)
        shift = 32 - self.top
        alive = np.searchsorted(-left, -np.arange(steps), side="left")  # lanes with more than s ids
        for s in range(steps):
            n = alive[s]
            p = at[:n]
            code = (window[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            out[s, :n] = self.symbol[code]
            p += self.width[code]
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        lane = np.repeat(back, counts)
        step = tokens.ragged(np.zeros(len(counts), np.int64), counts)
        return out[step, lane]


def tokenized(docs: DataFrame, vocabulary, end_id: int, dtype: str, size: int) -> DataFrame:
    """id, hash (of the text), n, ids (binary of dtype, with the end id) of docs; a task's last row has only
    ``counts``, how often each of its ids occurs (binary: pairs of 64-bit numbers)."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    arrow = pa.schema([("id", to_arrow_type(id_type)), ("hash", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def encode(batches):
        encoder = tokens.worker_encoder(vocabulary)
        total = np.zeros(size, np.int64)
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                found = [np.append(x, end_id).astype(dtype) for x in encoder.encode(rows.column("text").to_pylist())]
                n = np.array([len(x) for x in found], np.int64)
                whole = np.concatenate(found)
                total += np.bincount(whole, minlength=size)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("hash"), pa.array(n), binary(whole, n), pa.nulls(len(n), pa.binary())], schema=arrow)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_pylist([{"counts": np.stack([used, total[used]]).astype("<i8").tobytes()}], schema=arrow)

    return docs.mapInArrow(frugal(encode), schema)


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of values, counts[i] each, as binary strings, without a copy of the values."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
    return pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1] // values.itemsize, ends[1:] // values.itemsize)], pa.binary())


def binary_values(column: pa.Array, dtype: str) -> np.ndarray:
    """The values of all binary strings of a column, one after another, as they lie in its buffer."""
    if not len(column):
        return np.empty(0, dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if raw is not None else np.empty(0, dtype)


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs: the tasks' counts summed by Spark; one row a distinct id reaches the driver."""

    def unpack(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                used, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"id": pa.array(used), "n": pa.array(n)})

    rows = ids.where("counts IS NOT NULL").select("counts").mapInArrow(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of docs in ascending id order to a new folder in the format above."""
    spark = docs.sparkSession
    text = tokens.read_vocabulary(spark, vocabulary_path)
    vocabulary = spark.sparkContext.broadcast(text)
    size = max(tokens.vocabulary_size(text), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    ids = written(tokenized(picked(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("hash"), "text"), vocabulary, end_id, dtype, size), "ids", compression="zstd")

    bits = code_lengths(id_counts(ids, size), max(MAX_BITS, size.bit_length() + 1))
    codes = canonical_codes(bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((codes, bits))
    id_type = ids.schema["id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_lengths", T.ArrayType(T.LongType())), T.StructField("checkpoints", T.BinaryType()), T.StructField("payload", T.BinaryType())])
    arrow = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(id_type))), ("doc_lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])

    def pack(batches):
        from pyspark import TaskContext

        codes, bits = book.value
        part, start, block = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # document ids, lengths, ids
        size = 0

        def close():
            nonlocal held, size, start, block
            doc_ids, lengths = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
            payload, offsets = encode_ids(np.concatenate([x[2] for x in held]), codes, bits)
            one = pa.array([0, len(doc_ids)], pa.int32())
            row = [pa.array([part], pa.int32()), pa.array([block]), pa.array([start]), pa.array([size]), pa.ListArray.from_arrays(one, doc_ids), pa.ListArray.from_arrays(one, pa.array(lengths)),
                   pa.array([offsets[::CHECKPOINT_IDS].astype("<u8").tobytes()], pa.binary()), pa.array([payload], pa.binary())]
            held, size, start, block = [], 0, start + size, block + 1
            return pa.RecordBatch.from_arrays(row, schema=arrow)

        for batch in batches:
            lengths = batch.column("n").to_numpy()
            ends = np.cumsum(lengths)
            values = binary_values(batch.column("ids"), dtype)
            row = 0
            while row < len(lengths):
                before = int(ends[row - 1]) if row else 0
                # up to the first document that fills the block
                stop = min(int(np.searchsorted(ends, before + BLOCK_IDS - size)) + 1, len(lengths))
                held.append((batch.column("id").slice(row, stop - row), lengths[row:stop], values[before : ends[stop - 1]]))
                size += int(ends[stop - 1]) - before
                row = stop
                if size >= BLOCK_IDS:
                    yield close()
            held = [(pa.concat_arrays([a]), n.copy(), v.copy()) for a, n, v in held]  # the batch's memory goes
        if held:
            yield close()

    in_order = ids.where("ids IS NOT NULL").select("id", "hash", "n", "ids").repartitionByRange(F.col("id").asc_nulls_first(), F.col("hash"), F.monotonically_increasing_id()).sortWithinPartitions("id", "hash")
    in_order.select("id", "n", "ids").mapInArrow(frugal(pack), schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    # one row a partition
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toPandas()
    bases = list(zip(parts["part"].tolist(), (parts["n"].cumsum() - parts["n"]).tolist()))
    spark.createDataFrame(bases, "part int, base long").coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) of every document in the files."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    bits = np.zeros(int(book["id"].max() + 1) if len(book) else 1, np.uint8)
    bits[book["id"].to_numpy(np.int64)] = book["bits"].to_numpy()
    base = dict(map(tuple, spark.read.parquet(f"{path}/parts").collect()))
    shared = spark.sparkContext.broadcast((bits, base))
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([("doc_id", to_arrow_type(id_type)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches):
        bits, base = shared.value
        decoder = Decoder(bits)
        for batch in batches:
            lengths = batch.column("n").to_numpy()
            group = (np.cumsum(lengths) - lengths) // DECODE_IDS
            for a, b in zip(*(lambda x: (x, [*x[1:], len(group)]))(np.flatnonzero(np.diff(group, prepend=-1)).tolist())):
                yield _documents(decoder, batch.slice(a, b - a), base, arrow)

    return blocks.mapInArrow(frugal(decode), schema)


def _documents(decoder: Decoder, blocks: pa.RecordBatch, base: dict[int, int], arrow: pa.Schema) -> pa.RecordBatch:
    """The documents of some blocks that are decoded together."""
    offsets, counts, payload, before = [], [], [], 0
    for n, raw, codes in zip(blocks.column("n").to_pylist(), blocks.column("checkpoints"), blocks.column("payload")):
        own = np.frombuffer(raw.as_buffer(), "<u8").astype(np.int64)
        offsets.append(own + 8 * before)
        lane = np.full(len(own), CHECKPOINT_IDS, np.int64)
        if len(lane):
            lane[-1] = n - CHECKPOINT_IDS * (len(lane) - 1)
        counts.append(lane)
        payload.append(codes.as_buffer())
        before += len(codes.as_buffer())
    ids = decoder.decode(b"".join(payload), np.concatenate(offsets), np.concatenate(counts)).astype(tokens.IDS)
    lengths = blocks.column("doc_lengths").flatten().to_numpy()
    per_block = np.diff(np.asarray(blocks.column("doc_lengths").offsets))
    # a block's documents start where it does, in its part
    first = np.repeat([base[p] + s for p, s in zip(blocks.column("part").to_pylist(), blocks.column("start").to_pylist())], per_block)
    ends = np.cumsum(lengths)
    opening = np.repeat((ends - lengths)[np.cumsum(per_block) - per_block], per_block)
    return pa.RecordBatch.from_arrays([blocks.column("doc_ids").flatten(), pa.array(first + ends - lengths - opening), pa.array(lengths), binary(ids, lengths)], schema=arrow)


def crc32_of(ids: DataFrame) -> DataFrame:
    """ids replaced by ``ids_crc32``, the unsigned CRC-32 of the bytes."""
    return ids.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
