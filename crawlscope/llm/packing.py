"""Operator 2: best-fit packing by exact complements.

``cut`` tokenizes every whole document once, appends the end id and cuts
documents longer than ``capacity`` into pieces of ``capacity`` ids, the
remainder first. ``plan`` packs the histogram of piece lengths (at most
``capacity`` numbers, whatever the size of the corpus): single lengths, pairs
and triples are indexed by their sums (``SumIndex``), and longest first the gap
beside a piece is filled by a combination that is exactly as long, as often as
the counts allow; what finds no exact complement is packed best-fit, longest
first. Greedy exact fills can use up pieces that later gaps need, so several
plans are made (``plans``, plain best fit among them) and the one with the fewest
sequences is kept. A step of the plan covers ranks ``[lo, hi)`` of one length,
so a piece needs only its rank among the pieces of its length to know its
sequence and offset.

Scale: ranks are counted within each task and shifted by the counts of the
tasks before (one row for each task and length), so no length, however common,
gathers in one task; ids are never shuffled. The driver holds one histogram
and one plan, both bounded by ``capacity``. The shifts are broadcast only below
``MAX_SHIFT_ROWS`` rows, else joined by a shuffle.

Defined results: a null or empty text is the end id alone (one piece); every
input row is packed, so repeated rows and repeated or null ids stay; equal
lengths are interchangeable; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.joins import broadcast_if_small
from . import tokens
from .shared import frugal, picked, shared_path

CAPACITY = 1024
#: pieces below these parts of a sequence are held back from pairs and triples in some plans
HELD_BACK = (64, 16, 8)
MAX_SHIFT_ROWS = 250_000


def cut(docs: DataFrame, vocabulary, end_id: int, capacity: int, dtype: str) -> DataFrame:
    """Pieces of docs: id, piece, start, length, task, rank (among the task's pieces of this length), ids (binary of dtype)."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([("id", to_arrow_type(id_type)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("task", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])

    def pieces(batches):
        from pyspark import TaskContext

        encoder = tokens.worker_encoder(vocabulary)
        task, met = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                out = []
                for i, ids in zip(rows.column("id").to_pylist(), encoder.encode(rows.column("text").to_pylist())):
                    ids = np.append(ids, end_id).astype(dtype)
                    first = len(ids) % capacity or capacity
                    for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                        stop = first if k == 0 else start + capacity
                        out.append((i, k, start, stop - start, task, met[stop - start], ids[start:stop].tobytes()))
                        met[stop - start] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.mapInArrow(frugal(pieces), schema)


class SumIndex:
    """The combinations of one, two and three lengths by their sum, under the counts that are left.

    For a sum the larger parts of its pairs are listed once, when it is first asked for, in the order of
    preference. Counts only fall, so a pair whose parts are used up is passed by for good; a triple is a
    first part, the largest ones first, and a pair of the rest."""

    def __init__(self, left: np.ndarray, least: int, equal: bool):
        self.left, self.least, self.equal = left, least, equal
        self.pairs: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        self.heads: dict[int, int] = {}

    def single(self, total: int) -> list[int] | None:
        return [total] if self.left[total] > 0 else None

    def _live(self, a: int, b: int) -> bool:
        return self.left[a] > (a == b) and self.left[b] > 0

    def pair(self, total: int, held: int = 0) -> list[int] | None:
        """The first pair of this sum; one piece of length held is spoken for."""
        if total not in self.pairs:
            big = np.arange((total + 1) // 2, total - self.least + 1)
            big = big[(self.left[big] > 0) & (self.left[total - big] > 0)] if len(big) else big
            self.pairs[total], self.first[total] = big if self.equal else big[::-1], 0
        found = self.pairs[total]
        while self.first[total] < len(found) and not self._live(int(found[self.first[total]]), total - int(found[self.first[total]])):
            self.first[total] += 1
        for a in found[self.first[total] :].tolist():
            b = total - a
            if held not in (a, b) and self._live(a, b) or held in (a, b) and self.left[a] > (a == b) + (held == a) and self.left[b] > (held == b):
                return [a, b]
        return None

    def triple(self, total: int) -> list[int] | None:
        head = self.heads.get(total, total - 2 * self.least)
        while 3 * head >= total:
            if self.left[head] > 0:
                two = self.pair(total - head, head)
                if two:
                    self.heads[total] = head
                    return [head, *two]
            head -= 1
        self.heads[total] = -1
        return None


class _Plan:
    """Sequences as steps (length, lo, hi, first sequence, offset) over the ranks of each length."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros(len(counts), np.int64)
        self.sequences = 0
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # gap -> (first sequence, how many, filled)

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.steps.append((length, int(self.used[length]), int(self.used[length]) + n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def fill(self, lengths: list[int], n: int) -> None:
        """n new sequences of these lengths each."""
        offset = 0
        for length in lengths:
            self.put(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def exact(self, parts: int, least: int, equal: bool) -> None:
        """Longest first, fill the gap beside a piece exactly with this many pieces of at least least ids, as often as the counts allow."""
        index, capacity = SumIndex(self.left, least, equal), len(self.left) - 1
        find = (index.single, index.pair, index.triple)[parts - 1]
        for length in range(capacity - parts * least, 0, -1):
            while self.left[length] > 0:
                self.left[length] -= 1
                others = find(capacity - length)
                self.left[length] += 1
                if others is None:
                    break
                lengths = [length, *others]
                self.fill(lengths, min(int(self.left[x]) // lengths.count(x) for x in lengths))

    def best_fit(self, length: int) -> None:
        """All pieces of this length: into the smallest gaps that take them, else into new sequences."""
        while self.left[length]:
            gap = min((g for g, x in self.open.items() if g >= length and x), default=None)
            n = int(self.left[length])
            if gap is None:
                first, filled = self.sequences, 0
                gap = len(self.left) - 1
                per = gap // length  # of one length, as many as fit
                if per > 1 and n >= per:
                    n //= per
                    self.fill([length] * per, n)
                    self.open[gap - per * length].append((first, n, per * length))
                    continue
                self.sequences += 1 if per > 1 else n
                n = 1 if per > 1 else n
                self.open[gap - length].append((first, n, length))
            else:
                first, many, filled = self.open[gap].pop()
                n = min(n, many)
                if many > n:
                    self.open[gap].append((first + n, many - n, filled))
                self.open[gap - length].append((first, n, filled + length))
            self.put(length, n, first, filled)


def plans(counts: np.ndarray) -> Iterator[_Plan]:
    """Ways to pack counts: exact fills by up to 3, 2, 1 and 0 other pieces, the rest best-fit, longest first.

    Small pieces that go into pairs and triples are missed by later gaps, so each number of pieces is planned
    with small ones held back for best fit too, and with the most unequal or the most equal pairs first."""
    capacity = len(counts) - 1
    for parts in (3, 2, 1, 0):
        choices = [(1, False)] if parts < 2 else [(least, equal) for least in dict.fromkeys((1, *(max(1, capacity // k) for k in HELD_BACK))) for equal in (False, True)]
        for least, equal in choices:
            p = _Plan(counts)
            if p.left[capacity]:
                p.fill([capacity], int(p.left[capacity]))
            for n in range(1, parts + 1):
                p.exact(n, least if n > 1 else 1, equal)
            for length in np.flatnonzero(p.left)[::-1].tolist():
                p.best_fit(length)
            yield p


def plan(counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Steps that pack counts[length] pieces of each length into sequences of at most len(counts) - 1 ids: the plan
    with the fewest sequences, of equal ones the first."""
    capacity = len(counts) - 1
    least = -(-int((counts * np.arange(len(counts))).sum()) // max(capacity, 1))
    best = None
    for p in plans(counts):
        if best is None or p.sequences < best.sequences:
            best = p
        if best.sequences == least:
            break
    return best.steps


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its place: id_col, piece, start, length, sequence_id, offset, ids (binary, little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    text = tokens.read_vocabulary(spark, vocabulary_path)
    vocabulary = spark.sparkContext.broadcast(text)
    dtype = "<u2" if max(tokens.vocabulary_size(text), end_id + 1) <= 1 << 16 else "<u4"
    made = cut(picked(docs, id=id_col, text=text_col), vocabulary, end_id, capacity, dtype)
    folder = shared_path(spark, "pieces")
    made.write.option("compression", "zstd").parquet(folder)
    pieces = spark.read.schema(made.schema).parquet(folder)

    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    lengths = by_task.groupBy("length").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[lengths["length"].to_numpy()] = lengths["n"].to_numpy()
    steps = np.array(sorted(plan(counts)), np.int64).reshape(-1, 5)
    steps_by = spark.sparkContext.broadcast(steps)

    id_type = pieces.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])
    top = int(counts.max(initial=0)) + 1

    def place(batches):
        length, lo, _, first, offset = steps_by.value.T
        key = length * top + lo
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            rank = rank + batch.column("shift").to_numpy()
            step = np.searchsorted(key, n * top + rank, side="right") - 1
            ids = [np.frombuffer(x, dtype).astype(tokens.IDS).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("piece"), batch.column("start"), batch.column("length"), pa.array(first[step] + rank - lo[step]), pa.array(offset[step]), pa.array(ids, pa.binary())],
                names=schema.names,
            )

    return pieces.join(broadcast_if_small(shifts, MAX_SHIFT_ROWS), ["task", "length"]).select("id", "piece", "start", "length", "rank", "shift", "ids").mapInArrow(frugal(place), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: the packed sequences themselves, at most ``capacity`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts["ids"], F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(whole.alias("ids"))
