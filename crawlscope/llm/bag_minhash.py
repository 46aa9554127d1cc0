"""Operator 4: near-duplicate documents by BagMinHash.

A document is the multiset of its shingles of ``SHINGLE`` lower-case words (a
shorter text is one shingle; a text without words has none). ``signatures``
gives ``SIZE`` values whose agreement between two documents has the weighted
Jaccard similarity of their multisets as its expectation. The weight axis of a
shingle is discretised into [0,1), [1,2), [2,4), [4,8), ...; on each interval a
Poisson process of points (time, component, place in the interval) is drawn
from the shingle's hash, and a document of weight w sees the points below w: in
the interval that w cuts, points belong to it or not by their place. A
component's value is the time of its first point. All components share one
process of ``SIZE`` times the rate, which is followed only until its time
passes the latest first point of the document: about one point a shingle and
``SIZE ln SIZE`` more for each document, instead of ``SIZE`` a shingle.

``BANDS`` bands of ``ROWS`` values make bucket keys. Links are verified by the
overlap of the multisets (32-bit hashes of shingle and occurrence):

1. equal multisets are one node;
2. each node of a bucket is verified against the bucket's first node;
3. where a bucket still holds nodes of several groups, the pairs across groups
   are verified inside tasks that hold two blocks of about ``BLOCK`` nodes or
   ``BLOCK_BYTES`` of multisets, each pair in its first common bucket only; a
   task gives a spanning forest of the links it found, not the pairs. A group of
   several blocks has its blocks to itself, and two blocks of one group are
   never dealt together, so an unlinked node beside 100,000 linked ones meets
   each of them once;
4. classes are the connected components of all verified links.

So no link between nodes that share a bucket is lost to the classes. Step 3
grows with the product of the groups' sizes where a bucket holds several large
groups that are alike but not linked (their rows are copied to one task for each
block of the others), and with nothing else. A pair at the threshold shares a
bucket with probability 0.9996. Two shingles of one text share a hash of 32
bits once in some 4 * 10^9 pairs; sizes and overlaps count distinct hashes.

Defined results: texts without words are of one class if they are equal (null
is empty); repeated rows are of one class; null ids stay, the class id is the
smallest id that is not null; an empty table gives no rows; other columns are
ignored by ``classes`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.joins import broadcast_if_small
from . import tokens
from .components import components, spanning_forest
from .shared import frugal, picked, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
SIZE = BANDS * ROWS
BLOCK = 512
BLOCK_BYTES = 2 << 20
#: home of the blocks that hold small groups (groups are named by a node, which is not negative)
MIXED = -1
MAX_DOCS = 50_000
#: characters that are signed together: a shingle takes some 100 bytes meanwhile
SLICE_CHARS = 1_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all texts, and how many each text has."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}_]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    coded = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()], np.uint64)
    word = hashes[np.asarray(coded.indices)] if len(hashes) else np.empty(0, np.uint64)
    n = np.diff(np.asarray(lists.offsets))
    starts = np.cumsum(n) - n
    none = np.asarray(pc.equal(pc.utf8_trim(spaced, " "), "").to_numpy(zero_copy_only=False), bool)
    counts = np.where(none, 0, np.maximum(n - SHINGLE + 1, 1))
    width = np.minimum(n, SHINGLE)
    at = tokens.ragged(starts, counts)
    wide = np.repeat(width, counts)
    h = wide.astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < wide
        h[inside] = mixed(h[inside] * _GOLDEN + word[at[inside] + k])
    return h, counts


def bags(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (48 bits of hash) as (document, shingle, weight), in order of document and shingle."""
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = np.sort(doc << np.uint64(48) | h >> np.uint64(16))
    first = np.flatnonzero(np.diff(key, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64(0xFFFFFFFFFFFF), weight


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """BagMinHash values (docs x SIZE); infinite for documents without shingles."""
    spans = np.ones(len(weight), np.int64)
    heavy = weight > 1
    spans[heavy] += np.frexp((weight[heavy] - 1).astype(np.float64))[1]
    level = tokens.ragged(np.zeros(len(spans), np.int64), spans)
    doc, w = np.repeat(doc, spans), np.repeat(weight, spans)
    length = np.where(level == 0, 1.0, 2.0 ** np.maximum(level - 1, 0))
    low = np.where(level == 0, 0.0, length)
    state = mixed(np.repeat(shingle, spans) * _GOLDEN + level.astype(np.uint64))
    time = np.zeros(len(doc))
    values = np.full(docs * SIZE, np.inf)
    while len(doc):
        state = state + _GOLDEN
        draw = mixed(state)
        time = time - np.log1p(-_uniform(draw)) / (SIZE * length)
        other = mixed(draw ^ np.uint64(0x5851F42D4C957F2D))
        component = ((other >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        seen = low + length <= w
        cut = np.flatnonzero(~seen)
        if len(cut):
            place = low[cut] + length[cut] * _uniform(mixed(other[cut]))
            seen[cut] = place < w[cut]
        np.minimum.at(values, doc[seen] * SIZE + component[seen], time[seen])
        last = values.reshape(docs, SIZE).max(axis=1)
        going = time < last[doc]
        doc, w, length, low, state, time = (x[going] for x in (doc, w, length, low, state, time))
    return values.reshape(docs, SIZE)


def _band_keys(values: np.ndarray) -> np.ndarray:
    bits = values.view(np.uint64).reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * _GOLDEN + bits[:, :, k])
    return key.view(np.int64)


def _occurrences(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multisets as sets: 32-bit hashes of (shingle, occurrence), and how many each document has."""
    nth = tokens.ragged(np.zeros(len(weight), np.int64), weight).astype(np.uint64)
    item = (mixed(np.repeat(shingle, weight) + nth * _GOLDEN) >> np.uint64(32)).astype(np.uint32)
    return item, np.repeat(doc, weight)


def signed(rows: DataFrame) -> DataFrame:
    """node, id, digest (of the multiset), bands (array of bucket keys; empty without words), bag (binary) of rows (node, id, text)."""
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("id", id_type), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bag", T.BinaryType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def sign(batches):
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_CHARS):
                for lo in range(0, part.num_rows, MAX_DOCS):
                    yield one(part.slice(lo, MAX_DOCS))

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(part.column("text"), "").cast(pa.large_string())
        n = len(texts)
        doc, shingle, weight = bags(*shingle_hashes(texts))
        keys = _band_keys(signatures(doc, shingle, weight, n))
        item, owner = _occurrences(doc, shingle, weight)
        distinct = np.unique(owner.astype(np.uint64) << np.uint64(32) | item)
        item, of_doc = distinct.astype(np.uint32), np.cumsum(np.bincount((distinct >> np.uint64(32)).astype(np.int64), minlength=n))
        of_bag = np.searchsorted(doc, np.arange(n + 1))
        digests, bands, bag = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            a, b = of_bag[i], of_bag[i + 1]
            if a == b:
                digests.append(hashlib.blake2b(text.encode(), digest_size=16, key=b"text").digest())
                bands.append([])
                bag.append(b"")
                continue
            digests.append(hashlib.blake2b(shingle[a:b].tobytes() + weight[a:b].tobytes(), digest_size=16).digest())
            bands.append(keys[i])
            bag.append(item[(of_doc[i - 1] if i else 0) : of_doc[i]].tobytes())
        return pa.RecordBatch.from_arrays([part.column("node"), part.column("id"), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bag, pa.binary())], schema=arrow)

    return rows.mapInArrow(frugal(sign), schema)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= THRESHOLD * (len(a) + len(b) - both)


def _verified_stars(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs (node, lead) whose multisets overlap enough."""
    # ids are small: where they are few they go to the multisets, not the multisets to them
    own = bag.select("node", F.col("bag").alias("own")).join(broadcast_if_small(pairs), "node")
    leads = bag.select(F.col("node").alias("lead"), F.col("bag").alias("other"))
    leads = leads.join(broadcast_if_small(pairs.select("lead").distinct()), "lead", "left_semi")
    full = own.join(leads, "lead").select("node", "lead", "own", "other")

    def check(batches):
        for batch in batches:
            good = [_similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(*(batch.column(c).to_pylist() for c in ("own", "other")))]
            yield batch.select(["node", "lead"]).filter(pa.array(good, pa.bool_()))

    return full.mapInArrow(frugal(check), "node long, lead long")


def _linked(rows: list[dict], band: int) -> Iterator[tuple[int, int]]:
    """Links across groups among rows, of pairs whose first common bucket is of this band; a spanning forest of them."""
    rows.sort(key=lambda r: r["node"])
    group = np.unique([r["group"] for r in rows], return_inverse=True)[1]
    bands = np.array([r["bands"] for r in rows])
    side = np.array([r["side"] for r in rows])
    todo = np.triu(group[:, None] != group[None, :], 1)
    if side.max() > 0:
        todo &= side[:, None] != side[None, :]
    for k in range(band):
        todo &= bands[:, k][:, None] != bands[:, k][None, :]
    i, j = np.nonzero(todo)
    if not len(i):
        return iter(())
    sets = [np.frombuffer(r["bag"], np.uint32) for r in rows]
    sizes = np.array([len(s) for s in sets])
    fits = np.minimum(sizes[i], sizes[j]) >= THRESHOLD * np.maximum(sizes[i], sizes[j])
    i, j = i[fits], j[fits]
    if len(i) > 2000:
        both = _overlaps(sets)[i, j]
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    good = both >= THRESHOLD * (sizes[i] + sizes[j] - both)
    root = spanning_forest(len(rows), i[good], j[good])
    return ((rows[k]["node"], rows[r]["node"]) for k, r in enumerate(root) if k != r)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the items that two sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    item, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    column = (np.cumsum(shared) - 1)[number]
    keep = shared[number]
    owner, column = owner[keep], column[keep]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _slots(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _block_pairs(placed: DataFrame) -> DataFrame:
    """key, home, slot, i, j, side: the pairs of blocks that each block of a bucket is compared in; two blocks of one group are none."""
    blocks = placed.select("key", "home", "slot").distinct().withColumn("block", F.row_number().over(Window.partitionBy("key").orderBy("home", "slot")))
    other = blocks.select("key", F.col("home").alias("other_home"), F.col("block").alias("other"))
    pairs = blocks.join(other, "key").where((F.col("home") != F.col("other_home")) | (F.col("home") == MIXED))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return pairs.select("key", "home", "slot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"))


def _across_groups(buckets: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of one bucket that stars left in different groups."""
    member = buckets.join(groups, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("group"))
    # a bucket is open if at least two of its nodes beside the first are of different groups
    state = member.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("n"))
    state = written(state.filter("low != high AND n > 2").select("key"), "open-buckets")
    inside = written(member.join(state, "key").join(nodes.select("node", "size"), "node"), "open-members")
    # a group too large for one block has blocks of its own, all others share blocks
    own = inside.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).withColumn("slots", _slots(F.col("n"), F.col("size")))
    shared = own.where("slots = 1").groupBy("key").agg(_slots(F.sum("n"), F.sum("size")).alias("shared"))
    large = F.col("slots") > 1
    homes = own.join(shared, "key", "left").select("key", "group", F.when(large, F.col("group")).otherwise(MIXED).alias("home"), F.when(large, F.col("slots")).otherwise(F.col("shared")).alias("slots"))
    placed = written(inside.join(homes, ["key", "group"]).select("key", "band", "node", "group", "home", F.pmod(F.xxhash64("node"), "slots").alias("slot")), "open-places")
    dealt = written(placed.join(_block_pairs(placed), ["key", "home", "slot"]).select("key", "band", "node", "group", "i", "j", "side"), "open-blocks")
    task = nodes.select("node", "bands", "bag").join(broadcast_if_small(dealt), "node")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: pa.Table) -> pa.Table:
        found = list(_linked(rows.to_pylist(), rows["band"][0].as_py()))
        return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=out)

    return task.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def classes(rows: DataFrame) -> DataFrame:
    """node, id, class_node, class_id of rows (node unique, id, text); class_node is the node that stands for the class."""
    table = written(signed(rows), "signatures", compression="zstd")
    members = table.select("node", "id", "digest")
    # of equal multisets the first node, with their bucket keys
    leads = written(table.groupBy("digest").agg(F.min(F.struct("node", "bands")).alias("lead")).select("digest", F.col("lead.node").alias("lead"), "lead.bands"), "copies")
    keyed = leads.select(F.col("lead").alias("node"), F.posexplode("bands").alias("band", "key"))
    leads = leads.drop("bands")
    first = written(keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "buckets")
    buckets = written(keyed.join(broadcast_if_small(first), "key"), "bucket-members")
    pairs = written(buckets.filter("node != lead").select("node", "lead").distinct(), "star-pairs")
    # multisets are needed of nodes that share a bucket, a part of all; the others' never move if the part's ids are few
    shared = table.select("node", "bands", "bag", F.octet_length("bag").alias("size")).join(broadcast_if_small(buckets.select("node").distinct()), "node", "left_semi")
    shared = written(shared, "candidates", compression="zstd")
    stars = written(_verified_stars(pairs, shared.select("node", "bag")), "stars").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    across = written(_across_groups(buckets.select("key", "band", "node"), components(stars), shared), "across")
    labels = components(stars.unionByName(across))
    grouped = leads.join(labels, leads["lead"] == labels["node"], "left").select("digest", F.coalesce("component", "lead").alias("component"))
    full = written(members.join(grouped, "digest").select("node", "id", "component"), "members")
    stands = full.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    return full.join(stands, "component").select("node", "id", F.col("best.node").alias("class_node"), F.col("best.id").alias("class_id"))


def document_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``class_id`` of every row."""
    rows = picked(docs, id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("node"), "id", "text")
    return classes(rows).select(F.col("id").alias(id_col), "class_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class (its smallest id), with all columns of docs."""
    mark = "node_" + hashlib.blake2b(" ".join(docs.columns).encode(), digest_size=8).hexdigest()
    numbered = written(docs.withColumn(mark, F.monotonically_increasing_id()), "documents", compression="zstd")
    found = classes(picked(numbered, node=mark, id=id_col, text=text_col))
    gone = written(found.filter("node != class_node").select(F.col("node").alias(mark)), "gone")
    return numbered.join(broadcast_if_small(gone), mark, "left_anti").drop(mark)
