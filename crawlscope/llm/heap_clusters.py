"""Operator 13: exact k-means on integer vectors with heap-ordered bounds.

Vectors become integers (``floor(scale * x)``), distances are exact integers and
a mean is rounded down, so every round has one right result. What the bounds
save is work, never exactness:

A vector of cluster a at distance u from its centroid and l from the next one
keeps its cluster until the centroids have moved by l - u together: by the
movement of a's centroid and by the largest movement of another one. Each
cluster adds these movements up as its *drift*, and keeps a heap of its vectors
ordered by the gap l - u at their last scan plus the drift at that time. In a
round only the vectors whose entry is not above the drift are popped; they are
scanned against all centroids in whole numbers (ties: the smaller number) and
pushed on the heap of their cluster. Entries are made smaller by ``SLACK`` of
all they are made from, far more than floating point can lose, so a vector that
could have changed its cluster is always popped, a tie included.

A heap is held as an ascending array, which is a binary heap whose pops are a
prefix: a round pops by one binary search and merges the pushed entries.

On Spark: vectors are dealt into blocks of at most ``BLOCK_VECTORS`` (one binary
matrix a row), hash-partitioned by block and checkpointed once. The heaps of a
block are a row of a small table (12 bytes a vector against 256 for 64
components), written anew each round in the shared folder and joined to the
blocks in place: only heaps are shuffled. Each block returns the change of the
sums and counts of the clusters, from the vectors that moved alone; k rows of
sums reach the driver. A lost executor repeats its blocks from the tables.

Defined results: vectors that are null, of another length, or with null or
non-finite components are left out; repeated rows count each; of equal hashes
the smaller vector comes first; with fewer vectors than k there are as many
centroids as vectors; an empty centroid stays; no vectors give no rows; other
columns are ignored. Components of ``scale * x`` too large for distances in 64
bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpoint_by_key
from .shared import picked, written

BLOCK_VECTORS = 4096
SLACK = 1e-9


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id`` and ``ints`` (array of long) of the vectors with dims finite components."""
    rows = picked(df, vec_id=id_col, v=vec_col)
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where((F.size("v") == dims) & ~odd)
    most = int((2**62 / dims) ** 0.5) // 2
    too_large = F.exists("v", lambda x: F.abs(x.cast("double") * scale) >= most)
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    return rows.select("vec_id", F.when(too_large, F.raise_error(F.lit("a component is too large for distances of 64 bits"))).otherwise(ints).alias("ints"))


def seed_hash(seed: str) -> Column:
    """Lower-case hexadecimal SHA-256 of ``seed:vec_id``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)


def _blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """``block``, ``ids``, ``matrix`` (little-endian 32-bit integers, row by row)."""
    id_type = vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("matrix", T.BinaryType())])
    arrow = pa.schema([("block", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), ("matrix", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def block(rows: pa.Table) -> pa.RecordBatch:
            values = rows.column("ints").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), pa.concat_arrays(rows.column("vec_id").chunks))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), ids, pa.array([values.astype("<i4").tobytes()], pa.binary())], schema=arrow)

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            while rows.num_rows >= BLOCK_VECTORS:
                yield block(rows.slice(0, BLOCK_VECTORS))
                rows, seq = rows.slice(BLOCK_VECTORS), seq + 1
            held = rows.to_batches()
        if held and sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return vectors.mapInArrow(deal, schema)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids) of 64-bit integers."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        gap = x - centroid
        out[:, c] = np.einsum("ij,ij->i", gap, gap)
    return out


class Heaps:
    """The heap of each cluster of one block: ascending entries and the vectors they belong to."""

    def __init__(self, k: int, keys: bytes = b"", rows: bytes = b"", sizes: list[int] | None = None):
        cuts = np.cumsum(sizes or [0] * k)[:-1]
        self.keys = np.split(np.frombuffer(keys, "<f8"), cuts)
        self.rows = np.split(np.frombuffer(rows, "<i4"), cuts)

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take the vectors whose gap is used up, with the cluster each was in."""
        rows, clusters = [], []
        for c, limit in enumerate(drift):
            n = int(np.searchsorted(self.keys[c], limit, side="right"))
            rows.append(self.rows[c][:n])
            clusters.append(np.full(n, c))
            self.keys[c], self.rows[c] = self.keys[c][n:], self.rows[c][n:]
        return np.concatenate(rows), np.concatenate(clusters)

    def push(self, rows: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> None:
        for c in np.unique(clusters).tolist():
            own = clusters == c
            both = np.concatenate([self.keys[c], keys[own]])
            order = np.argsort(both, kind="stable")
            self.keys[c], self.rows[c] = both[order], np.concatenate([self.rows[c], rows[own]])[order]

    def packed(self) -> dict:
        return {"keys": np.concatenate(self.keys).astype("<f8").tobytes(), "rows": np.concatenate(self.rows).astype("<i4").tobytes(), "sizes": [len(x) for x in self.rows]}


def rescan(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the first), and its heap entry."""
    d = distances(x, centroids)
    nearest = d.argmin(axis=1)
    if len(centroids) == 1:
        return nearest, np.full(len(x), np.inf)
    own, following = np.sqrt(np.partition(d, 1, axis=1)[:, :2].T.astype(np.float64))
    return nearest, following - own + drift[nearest] - SLACK * (following + own + drift[nearest])


HEAPS = "block long, keys binary, rows binary, sizes array<int>, change array<long>, scanned long"
_HEAPS = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary()), ("sizes", pa.list_(pa.int32())), ("change", pa.list_(pa.int64())), ("scanned", pa.int64())])


def _matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)


def assign(blocks: DataFrame, heaps: DataFrame | None, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The heaps after a round, with the change of counts and sums (k rows of 1 + dims) and the vectors scanned."""
    k, dims = centroids.shape
    first = heaps is None

    def round_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                x = _matrix(row["matrix"], dims)
                change = np.zeros((k, 1 + dims), np.int64)
                if first:
                    held, at, before = Heaps(k), np.arange(len(x)), None
                else:
                    held = Heaps(k, row["keys"], row["rows"], row["sizes"])
                    at, before = held.pop(drift)
                now, entries = rescan(x[at], centroids, drift)
                held.push(at, now, entries)
                moved = np.ones(len(at), bool) if before is None else now != before
                each = np.concatenate([np.ones((int(moved.sum()), 1), np.int64), x[at[moved]]], axis=1)
                np.add.at(change, now[moved], each)
                if before is not None:
                    np.subtract.at(change, before[moved], each)
                out = {"block": row["block"], **held.packed(), "change": change.ravel().tolist(), "scanned": len(at)}
                yield pa.RecordBatch.from_pylist([out], schema=_HEAPS)

    rows = blocks.select("block", "matrix")
    if not first:  # the heaps are the small side and are dealt like the blocks, which stay where they are
        rows = rows.join(heaps.select("block", "keys", "rows", "sizes").hint("shuffle_hash"), "block")
    return rows.mapInArrow(round_of, HEAPS)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", trace: list[int] | None = None) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every vector.

    rounds times all vectors are assigned and non-empty centroids become their floored means; then they are
    assigned once more. trace, if given, gets the number of vectors scanned in each assignment.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vec_col, dims, scale)
    seeds = vectors.orderBy(seed_hash(seed), "ints").limit(k).collect()
    blocks = checkpoint_by_key(_blocks(vectors, dims), ["block"])
    centroids = np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), dims)
    k, heaps = len(seeds), None
    drift, totals = np.zeros(k), np.zeros((k, 1 + dims), np.int64)
    for done in range(rounds + 1):
        if not k:
            break
        heaps = written(assign(blocks, heaps, centroids, drift), "heaps")
        if trace is not None:
            trace.append(heaps.agg(F.sum("scanned")).first()[0])
        if done == rounds:
            break
        # k * (1 + dims) rows
        for pos, change in heaps.select(F.posexplode("change").alias("pos", "x")).groupBy("pos").agg(F.sum("x")).collect():
            totals[divmod(pos, 1 + dims)] += change
        means = centroids.copy()
        filled = totals[:, 0] > 0
        means[filled] = totals[filled, 1:] // totals[filled, :1]
        moves = np.sqrt(((means - centroids) ** 2).sum(axis=1).astype(np.float64))
        if not moves.any():
            break  # the rounds that are left would change nothing
        others = np.array([np.delete(moves, c).max(initial=0) for c in range(k)])
        centroids, drift = means, drift + (moves + others) * (1 + SLACK)
    return _result(spark, blocks, heaps, centroids)


def _result(spark, blocks: DataFrame, heaps: DataFrame | None, centroids: np.ndarray) -> DataFrame:
    k, dims = centroids.shape
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    arrow = pa.schema([("vec_id", to_arrow_type(id_type)), ("cluster", pa.int32()), ("distance", pa.int64())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _matrix(batch.column("matrix")[i].as_py(), dims)
                own = np.empty(len(x), np.int32)
                own[np.frombuffer(batch.column("rows")[i].as_py(), "<i4")] = np.repeat(np.arange(k), batch.column("sizes")[i].as_py())
                gap = x - centroids[own]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(own), pa.array(np.einsum("ij,ij->i", gap, gap))], schema=arrow)

    hashes = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    if heaps is None:
        rows = spark.createDataFrame([], schema)
        inertia: dict[int, int] = {}
    else:
        rows = written(blocks.join(heaps.select("block", "rows", "sizes").hint("shuffle_hash"), "block").select("ids", "matrix", "rows", "sizes").mapInArrow(rows_of, schema), "clusters")
        inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())
    # k rows: always small enough to broadcast
    found = [(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in hashes]
    return rows.join(F.broadcast(spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
