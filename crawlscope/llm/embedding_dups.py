"""Operator 8: near-duplicate vectors by collision-counting projections.

Every distinct vector, scaled to length 1, gets ``PROJECTIONS`` numbers: its
products with fixed random directions. Vectors that share a cell (below) are
sorted by the first one and cut into blocks; two blocks are compared if their
ranges come within the first projection's window. For each pair of vectors of
such blocks the other windows count: a window is centred on the query's number
and is as wide as two vectors at the threshold differ in ``WINDOW_SD`` standard
deviations. Pairs with at least ``needed`` collisions are verified by their
cosine in double precision. ``needed`` is the highest count that a pair at the
threshold reaches with probability ``RECALL`` (closer pairs reach it more
often), so it follows from the threshold, not from the data. Numbers are
compared as whole quanta, which can only widen a window.

Cells: the projections of unrelated vectors differ by only a few windows, so
windows alone leave a constant share of all pairs. Many vectors are therefore
dealt into cells first, in several tables: a vector's cell in a table is the
one of its random directions that it is nearest to. A pair is compared in the
first table in which it shares a cell, so it is counted once. There are so many
tables that a pair at the threshold shares no cell with at most the probability
with which it leaves the first projection's window of ``FIRST_WINDOW_SD`` (one
in 1.7 million; closer pairs far less often). That holds for any data, as the
directions are drawn without it. The number of cells grows with the number of
vectors; few vectors, or those that cells don't part, are one cell.

Copies: identical vectors are one vector with a weight, so a huge group of
copies costs nothing more. Links aren't listed: a task adds up each vector's
weighted links and keeps only a spanning forest of them for the components, so
a huge group of near copies gives rows in proportion to its vectors.

Scale: a round sends each vector once, to its cell of one table, and its shuffle
files go with it, so the disk holds the vectors and about one copy of them; the
number of rounds grows with the logarithm of the number of vectors. A cell of
more vectors than a task takes is cut into parts, which meet pair by pair, in as
many rounds as keep to about two copies of the vectors at a time. Comparing takes a
byte-wide vector operation for a pair of a cell and projection. What stays
quadratic are the vectors of one cell: groups of near copies, and data in which
unrelated vectors are close, which cells part badly (see README).

Vectors are told apart by two 64-bit hashes where their rows are given results.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components have no links and are their own component, as are vectors without an
id (component null); vectors of different lengths don't link; repeated ids and
rows stay rows, each counted as a vector; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, spanning_forest
from .shared import picked, shuffles_dropped, written

PROJECTIONS = 16
WINDOW_SD = 2.6
FIRST_WINDOW_SD = 5.0
RECALL = 0.9999
SEED = 20
BLOCK = 1024
BLOCKS_OF_TASK = 16
#: of the vectors of one part of a cell, as numbers of 8 bytes; wide vectors make smaller parts
TASK_BYTES = 1 << 25
#: sending a vector costs about as much as comparing it with the vectors of a cell of so many blocks
DEALT_BLOCKS = 16
#: numbers of directions that part the vectors of a table
PARTS = (2, 4, 8, 16, 32, 64, 128, 256)
#: bytes of a packed row at most, and its columns
PACK_BYTES = 1 << 20
PACKED = ("nodes", "weights", "vectors", "earlier")
#: quanta of half a window, and the last one that is told apart
QUANTA = 12
LAST_QUANTUM = 63


def directions(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((PROJECTIONS, size))


def needed_collisions(recall: float = RECALL) -> int:
    """The highest count that a pair at the threshold reaches with probability recall."""
    p = math.erf(WINDOW_SD / math.sqrt(2))
    reached = 0.0
    for count in range(PROJECTIONS, 0, -1):
        reached += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if reached >= recall:
            return count
    raise ValueError("no count has this recall")


def _missed(quanta: np.ndarray) -> np.ndarray:
    """Of quanta (projections x vectors): for each projection and value of a query's quantum, a bit for each vector that
    its window doesn't hold, in words of 64; the bits after the last vector are set."""
    number = quanta.shape[1]
    missed = np.ones((len(quanta), 2 * LAST_QUANTUM + 1, -(-number // 64) * 64), bool)
    values = np.arange(-LAST_QUANTUM, LAST_QUANTUM + 1, dtype=np.int8)
    for of_projection, y in zip(missed, quanta):
        of_projection[:, :number] = np.abs(values[:, None] - y[None, :]) > QUANTA + 1
    return np.packbits(missed, axis=-1, bitorder="little").view("<u8")


def _collided(quanta: np.ndarray, missed: np.ndarray, needed: int) -> np.ndarray:
    """For each query of quanta, a bit for each vector of missed that at least needed of its windows hold.

    Misses are counted for 64 pairs at once: a counter's digits are words of their own, and what it carries over is a miss too many."""
    allowed = PROJECTIONS - needed
    shape = quanta.shape[1], missed.shape[2]
    digits = [np.full(shape, -((((1 << allowed.bit_length()) - 1 - allowed) >> k) & 1), np.int64).view("<u8") for k in range(allowed.bit_length())]
    over, spare = np.zeros(shape, "<u8"), np.empty(shape, "<u8")
    for q, of_projection in zip(quanta, missed):
        carry = of_projection[q.astype(np.intp) + LAST_QUANTUM]
        for digit in digits:
            np.bitwise_and(digit, carry, out=spare)
            np.bitwise_xor(digit, carry, out=digit)
            carry, spare = spare, carry
        np.bitwise_or(over, carry, out=over)
    return ~over


@functools.lru_cache(maxsize=4)
def _after(number: int) -> np.ndarray:
    """For each of so many vectors, a bit for each one after it."""
    later = np.zeros((number, -(-number // 64) * 64), bool)
    later[:, :number] = np.triu(np.ones((number, number), bool), 1)
    return np.packbits(later, axis=-1, bitorder="little").view("<u8")


def _set_bits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in its row of each bit that is set."""
    at = np.flatnonzero(words)
    left, row, first = words.ravel()[at], at // words.shape[1], at % words.shape[1] << 6
    rows, places = [row[:0]], [first[:0]]
    while len(left):
        rest = left & (left - np.uint64(1))  # without the lowest bit
        rows.append(row), places.append(first + np.frexp((left ^ rest).astype(np.float64))[1] - 1)
        more = rest != 0
        left, row, first = rest[more], row[more], first[more]
    return np.concatenate(rows), np.concatenate(places)


def _unit(flat: np.ndarray) -> np.ndarray:
    flat = flat.astype(np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # squares of tiny or huge components stay in range
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


class Cells(NamedTuple):
    """``tables`` of cells; a cell is the nearest of ``parts`` directions, ``levels`` times."""

    tables: int
    levels: int
    parts: int


ONE_CELL = Cells(1, 1, 1)


@functools.lru_cache
def shared_part(threshold: float) -> dict[int, float]:
    """By a number of random directions: how often two vectors at the threshold have the same nearest one, at least.

    The products of two such vectors with a direction are normal numbers that correlate by the threshold, for vectors
    of any size; so pairs of numbers are drawn, and three standard errors taken off."""
    rng, draws, shared = np.random.default_rng(SEED), 1 << 14, dict.fromkeys(PARTS, 0)
    for _ in range(16):
        a = rng.standard_normal((draws // 16, PARTS[-1]))
        b = threshold * a + math.sqrt(1 - threshold**2) * rng.standard_normal(a.shape)
        for parts in PARTS:
            shared[parts] += int((a[:, :parts].argmax(axis=1) == b[:, :parts].argmax(axis=1)).sum())
    return {parts: max(0.0, min(1 - 3 / draws, n / draws - 3 * math.sqrt(n / draws * (1 - n / draws) / draws))) for parts, n in shared.items()}


def cells_for(number: int, threshold: float) -> Cells:
    """The cheapest cells for so many vectors: a table costs its sending, and comparing as much again for each DEALT_BLOCKS of a cell."""
    most, dealt = BLOCK * BLOCKS_OF_TASK, DEALT_BLOCKS * BLOCK
    cost = lambda cells: cells.tables * (max(1, number / most / cells.parts**cells.levels) + number / dealt / cells.parts**cells.levels)
    if number <= most or not 0 < threshold < 1:
        return ONE_CELL
    missed = math.log(math.erfc(FIRST_WINDOW_SD / math.sqrt(2)))
    found = [ONE_CELL]
    for levels in (1, 2, 3):
        for parts, p in shared_part(threshold).items():
            if p > 0:
                found.append(Cells(math.ceil(missed / math.log1p(-(p**levels))), levels, parts))
    return min(found, key=cost)


@functools.lru_cache(maxsize=2)
def _cell_directions(size: int, cells: Cells) -> np.ndarray:
    return np.random.default_rng([SEED, size, 1]).standard_normal((cells.tables, cells.levels, cells.parts, size), np.float32)


def _cells_of(unit: np.ndarray, cells: Cells) -> np.ndarray:
    """The cell of each vector in each table."""
    found = np.zeros((len(unit), cells.tables), np.int32)
    if cells.parts > 1:
        unit = unit.astype(np.float32)
        for table, levels in enumerate(_cell_directions(unit.shape[1], cells)):
            for parts in levels:
                found[:, table] = found[:, table] * cells.parts + (unit @ parts.T).argmax(axis=1)
    return found


def _in_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows with their embedding as bytes (``vector``) and its ``size``, and the vector's cell in each table, as ``cells`` and as bytes (``where``)."""
    kept = [f for f in rows.schema.fields if f.name != "embedding"]
    schema = T.StructType([*kept, T.StructField("vector", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("where", T.BinaryType())])
    kind, block = _kind(rows), BLOCK

    def find(batches):
        for batch in (b.slice(lo, block) for b in batches for lo in range(0, b.num_rows, block)):
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                flat = pc.list_flatten(part.column("embedding")).to_numpy(zero_copy_only=False).reshape(-1, size)
                found, each = _cells_of(_unit(flat), cells), np.arange(len(flat) + 1)
                lists = pa.ListArray.from_arrays(pa.array((each * cells.tables).astype(np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), _packed(flat.astype(kind), each), pa.array(np.full(len(flat), size, np.int32)), lists, _packed(found, each)], names=schema.names)

    return rows.mapInArrow(find, schema)


def _kind(rows: DataFrame) -> np.dtype:
    """The type of the components as they are sent."""
    return np.dtype(np.float32 if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else np.float64)


def _bytes(values: pa.Array) -> np.ndarray:
    """The bytes of binary values, one after the other."""
    values = values.cast(pa.binary())
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(values) else np.zeros(0, np.uint8)


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary value for the rows of values from each edge to the next one."""
    width = values.itemsize * math.prod(values.shape[1:])
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _dealt(rows: DataFrame, kind: np.dtype, table: int, cut: dict[tuple[int, int], int], wave: int, waves: int) -> DataFrame:
    """The vectors packed by their cell of a table, and by the two parts of it that a task compares.

    cut: the number of parts of each (size, cell) that has several. A vector goes to the tasks of its own part with each
    part of its cell, those of this wave."""
    arrow = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("one", pa.int32()), ("other", pa.int32()), ("own", pa.int32()), *((c, pa.binary()) for c in PACKED)])
    schema = "size int, cell int, one int, other int, own int, nodes binary, weights binary, vectors binary, earlier binary"
    pack_bytes = PACK_BYTES

    def deal(batches):
        for whole in batches:
            sizes = whole.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                batch = whole if (sizes == size).all() else whole.filter(pa.array(sizes == size))
                nodes, weights = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
                vectors = _bytes(batch.column("vector")).view(f"V{size * kind.itemsize}")
                cells = _bytes(batch.column("where")).view(np.int32).reshape(len(nodes), -1)
                known, place = np.unique(cells[:, table], return_inverse=True)
                parts = np.array([cut.get((size, c), 1) for c in known.tolist()])[place]
                own = ((nodes & 0xFFFFFFFF) + (nodes >> 33)) % parts
                row = np.repeat(np.arange(len(nodes)), parts)
                partner = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                now = (own[row] + partner) % waves == wave
                row, partner = row[now], partner[now]
                keys = np.stack([cells[row, table], np.minimum(own[row], partner), np.maximum(own[row], partner), own[row]]).astype(np.int32)
                order = np.lexsort(keys[::-1])
                step = max(1, pack_bytes // (size * kind.itemsize + 16 + 4 * table))
                for lo in range(0, len(order), step):
                    part = order[lo:lo + step]
                    key, at = keys[:, part], row[part]
                    edges = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(edges) - 1, size, np.int32)), *(pa.array(k) for k in key[:, edges[:-1]]),
                        *(_packed(values, edges) for values in (nodes[at], weights[at], vectors[at], cells[at, :table])),
                    ], schema=arrow)

    return rows.select("node", "weight", "size", "vector", "where").mapInArrow(deal, schema)


class _Part:
    """The vectors of one part of a cell, in order of the first projection."""

    def __init__(self, task: pa.Table, size: int, table: int, kind: np.dtype, window: float):
        nodes, weights, vectors, earlier = (np.frombuffer(b"".join(task[c].to_pylist()), t) for c, t in zip(PACKED, (np.int64, np.int64, kind, np.int32)))
        unit = _unit(vectors.reshape(-1, size))
        numbers = unit @ directions(size).T
        order = np.argsort(numbers[:, 0], kind="stable")
        self.first, self.unit, self.nodes, self.weights = numbers[order, 0], unit[order], nodes[order], weights[order]
        self.earlier = earlier.reshape(len(nodes), table)[order]
        self.quanta = np.ascontiguousarray(np.clip(np.floor(numbers[order] * (QUANTA / window)), -LAST_QUANTUM, LAST_QUANTUM).astype(np.int8).T)
        self.known: dict[int, np.ndarray] = {}

    def missed(self, block: slice) -> np.ndarray:
        if block.start not in self.known:
            self.known[block.start] = _missed(self.quanta[:, block])
        return self.known[block.start]


def _near(a: _Part, b: _Part, x: slice, y: slice, needed: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of vectors of two blocks that are near and share no cell of an earlier table."""
    words = _collided(a.quanta[:, x], b.missed(y), needed)
    unit, unit_b, earlier, earlier_b = a.unit[x], b.unit[y], a.earlier[x], b.earlier[y]
    if a is b and x == y:
        words &= _after(len(unit))
    i, j = _set_bits(words)
    if len(i) > words.size * 2:  # many near copies: by products of the blocks
        hit = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :len(unit_b)].view(bool)
        for cell, cell_b in zip(earlier.T, earlier_b.T):
            hit &= cell[:, None] != cell_b[None, :]
        return np.divmod(np.flatnonzero(hit & (unit @ unit_b.T >= threshold)), len(unit_b))
    near = np.zeros(len(i), bool)
    for lo in range(0, len(i), 512):
        part = slice(lo, lo + 512)
        near[part] = np.einsum("ij,ij->i", unit.take(i[part], 0), unit_b.take(j[part], 0)) >= threshold
    i, j = i[near], j[near]
    new = (earlier[i] != earlier_b[j]).all(axis=1)
    return i[new], j[new]


def _links(dealt: DataFrame, table: int, kind: np.dtype, threshold: float) -> DataFrame:
    """``node``, ``links`` (weighted), ``hook`` (a node of its group) of the vectors of each task."""
    needed, block = needed_collisions(), BLOCK
    scale = math.sqrt(2 - 2 * threshold)
    window, width = WINDOW_SD * scale, FIRST_WINDOW_SD * scale
    out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("hook", pa.int64())])

    def compare(task: pa.Table) -> pa.Table:
        size, one, other = (task[c][0].as_py() for c in ("size", "one", "other"))
        parts = [_Part(task if one == other else task.filter(pc.equal(task["own"], own)), size, table, kind, window) for own in sorted({one, other})]
        a, b = parts[0], parts[-1]
        at = 0 if a is b else len(a.nodes)  # where those of b begin
        nodes = np.concatenate([p.nodes for p in parts])
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for lo in range(0, len(a.nodes), block):
            x = slice(lo, min(lo + block, len(a.nodes)))
            for lo_b in range(lo if a is b else 0, len(b.nodes), block):
                y = slice(lo_b, min(lo_b + block, len(b.nodes)))
                if b.first[y.start] > a.first[x.stop - 1] + width:
                    break
                if b.first[y.stop - 1] < a.first[x.start] - width:
                    continue
                i, j = _near(a, b, x, y, needed, threshold)
                if not len(i):
                    continue
                links[x] += np.bincount(i, b.weights[y][j], x.stop - x.start).astype(np.int64)
                links[at + y.start:at + y.stop] += np.bincount(j, a.weights[x][i], y.stop - y.start).astype(np.int64)
                i, j = root[x.start + i], root[at + y.start + j]
                apart = i != j
                if apart.any():
                    root = spanning_forest(len(nodes), i[apart], j[apart])[root]
        hit = links > 0
        return pa.Table.from_arrays([pa.array(nodes[hit]), pa.array(links[hit]), pa.array(nodes[root[hit]])], schema=out)

    return dealt.groupBy("size", "cell", "one", "other").applyInArrow(compare, "node long, links long, hook long")


def near_links(vectors: DataFrame, kind: np.dtype, threshold: float, cells: Cells) -> DataFrame:
    """``node``, ``links`` (weighted), ``hook`` (a node of its group) parts of distinct vectors (node, weight, and those of _in_cells)."""
    number = vectors.count()
    counts = written(vectors.select("size", F.posexplode("cells").alias("table", "cell")).groupBy("size", "table", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    if cells.tables > 1 and counts.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] > float(number) ** 2:
        # the cells hold more pairs than there are: one cell is cheaper
        vectors, cells = vectors.withColumn("where", F.unhex(F.lit("00000000"))), ONE_CELL
        counts = vectors.groupBy("size").agg(F.lit(0).alias("table"), F.lit(0).alias("cell"), F.count(F.lit(1)).alias("n"))
    of_task = F.greatest(F.lit(1), F.least(F.lit(BLOCKS_OF_TASK), F.floor(F.lit(TASK_BYTES) / (F.col("size") * (8 * BLOCK))))) * BLOCK
    wide = counts.select("table", "size", "cell", "n", F.ceil(F.col("n") / of_task).alias("parts")).filter("parts > 1").collect()
    found = []
    for table in range(cells.tables):
        large = [r for r in wide if r["table"] == table]
        cut = {(r["size"], r["cell"]): r["parts"] for r in large}
        # the vectors of the other cells go with the first wave
        waves = max(1, math.ceil(sum(r["n"] * r["parts"] for r in large) / (number + sum(r["n"] for r in large) or 1)))
        for wave in range(waves):
            found.append(written(_links(_dealt(vectors, kind, table, cut, wave, waves), table, kind, threshold), "near-links"))
    return functools.reduce(DataFrame.unionByName, found)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept`` of every row."""
    rows = picked(vectors, id=id_col, embedding=vector_col)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    hashes = [F.xxhash64("embedding").alias("hash"), F.xxhash64(F.lit(SEED), "embedding").alias("hash_b")]
    with shuffles_dropped(rows.sparkSession):
        good = rows.filter(usable)
        rows = written(rows.select("id", *(F.when(usable, h).alias(c) for h, c in zip(hashes, ("hash", "hash_b")))), "rows")
        cells = cells_for(rows.filter("hash IS NOT NULL").select("hash", "hash_b").distinct().count(), threshold)
        distinct = good.groupBy("embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
        distinct = written(_in_cells(distinct.select(F.monotonically_increasing_id().alias("node"), "*", *hashes), cells), "vectors")
        parts = near_links(distinct, _kind(good), threshold, cells)
        labels = components(parts.filter("node != hook").select(F.col("node").alias("a"), F.col("hook").alias("b")))
        links = parts.groupBy("node").agg(F.sum("links").alias("links"))
        nodes = distinct.select("node", "least", "weight", "hash", "hash_b").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
        found = nodes.join(least, "component").select("hash", "hash_b", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
        found = written(found, "found")
    linked = rows.join(found, ["hash", "hash_b"]).select("id", "n_links", "component_id")
    alone = rows.filter("hash IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
