"""Operator 7: a toxicity classifier with counterfactual regularisation.

Features of a text are its words in lower case and their beginnings of
``PREFIXES`` letters, each present or not, over the whole text. ``fit`` learns
a logistic model from at most ``MAX_TRAINING_DOCS`` labelled documents: of
each label those with the smallest hash of their id, half of the places each
unless a label has fewer, so that rare toxic rows stay. The loss weighs a label's
rows by how many rows each stands for, which keeps the prior. Equal texts are
one row of the counts and of the loss, however they are dealt to tasks; it is
toxic if a copy is:

1. presence of every feature is counted by label; the ``MAX_FEATURES`` with the
   highest G2 statistic and ``LEAST_DOCS`` documents are kept, and all identity
   terms; the least G2 is the one of ``CUTS`` with the smallest loss on ``FOLDS``
   folds of the training rows, each judged by a model whose features were also
   chosen without it;
2. for every sentence with identity terms a counterfactual is made in which
   each is swapped for the next of its group;
3. the log loss is minimised with a penalty on the squared weights and one on
   the squared change of the score between a sentence and its counterfactual,
   summed over the sentences of a text, so that the mention of a group by itself
   moves the score little.

Labels are used in ``fit`` alone; language, source and id are never features.

Scale: the chosen ids (bounded) are broadcast and their texts are read once;
fitting shuffles those bounded texts and feature counts. The models of the folds
are fitted in tasks of their own on broadcast vectors. The model has at most ``MAX_FEATURES`` weights and the identity terms.
Scoring is one pass without a shuffle. Words are looked up once per distinct
word of a batch.

Defined results: null and empty texts get the score of no feature; without
labelled rows that is the prior of one clean document; a document that is
labelled more than once counts as toxic if any label says so, null labels don't
count; repeated rows are scored each; an empty table gives no rows; other
columns are ignored by ``score`` and kept by ``accepted``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .shared import frugal, picked, written

MAX_TRAINING_DOCS = 20_000
MAX_FEATURES = 4_000
LEAST_DOCS = 4
CUTS = (30.0, 20.0, 15.0, 10.8, 6.6, 3.8)
FOLDS = 3
PREFIXES = (4, 5, 6)
L2 = 0.02
COUNTERFACTUAL = 1.0
STEPS = 400

# Groups of identity terms that are swapped for one another.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "citizens", "refugees"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"),
)

_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?\n])")


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]


def features_of(word: str) -> list[str]:
    """Features of one lower-case word: itself, and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def counterfactual_sentences(text: str, groups=IDENTITY_GROUPS) -> list[tuple[str, str | None]]:
    """The sentences of a text, each with itself where each identity term is swapped for the next of its group; None if it has none."""
    following = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    swapped = [(s, _WORDS.sub(lambda m: following.get(m[0].lower(), m[0]), s)) for s in _SENTENCE.split(text)]
    return [(s, None if other == s else other) for s, other in swapped]


def counterfactual(text: str, groups=IDENTITY_GROUPS) -> str | None:
    """The text with each identity term swapped for the next of its group; None if it has none."""
    pairs = counterfactual_sentences(text, groups)
    return "".join(s if other is None else other for s, other in pairs) if any(other is not None for _, other in pairs) else None


def _present(text: str) -> set[str]:
    return {f for w in set(_WORDS.findall(text.lower())) for f in features_of(w)}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> tuple[DataFrame, list[float]]:
    """text, toxic (0 or 1) of at most ``most`` labelled documents, equal texts once; how many rows one of each label stands for."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max("toxic").cast("int") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    places = min(toxic, max(most // 2, most - clean))
    places = [min(clean, most - places), places]
    chosen = [known.filter(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(n) for label, n in enumerate(places)]
    rows = picked(docs, id=id_col, text=text_col).join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    copies = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("copy")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return copies.select("text", "toxic"), [n / max(1, k) for n, k in zip((clean, toxic), places)]


def _g2(n0: Column, n1: Column, clean: int, toxic: int) -> Column:
    """G2 of the table (feature present or not) x (label)."""
    seen, every = n0 + n1, clean + toxic

    def term(n: Column, rows: Column, total: int) -> Column:
        """n ln(n / expected) of one cell."""
        return F.when(n > 0, n * F.log(n * every / (rows * total))).otherwise(0.0)

    cells = [(n0, seen, clean), (n1, seen, toxic), (clean - n0, every - seen, clean), (toxic - n1, every - seen, toxic)]
    return 2 * sum((term(*c) for c in cells), F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=IDENTITY_GROUPS, most: int = MAX_TRAINING_DOCS) -> Model:
    """Learn from the rows of labels (``id_col``, ``toxic``), all of which may be used."""
    rows, stands = training_rows(docs, labels, id_col, text_col, most)
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "training-rows", compression="zstd")

    def count(batches):
        found: dict[tuple[int, int], Counter] = {(fold, label): Counter() for fold in range(FOLDS) for label in (0, 1)}
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                found[fold, toxic].update(_present(text))
        for fold in range(FOLDS):
            clean, toxic = found[fold, 0], found[fold, 1]
            names = list(clean | toxic)
            for lo in range(0, len(names), 100_000):
                part = names[lo : lo + 100_000]
                yield pa.RecordBatch.from_pydict({"feature": part, "fold": [fold] * len(part), "n0": [clean[f] for f in part], "n1": [toxic[f] for f in part]}, schema=pa.schema([("feature", pa.string()), ("fold", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64())]))

    totals = Counter({(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()})
    clean, toxic = (sum(totals[fold, label] for fold in range(FOLDS)) for label in (0, 1))
    bias = float(np.log((toxic * stands[1] + 0.5) / (clean * stands[0] + 1.5)))
    if not clean or not toxic:
        return Model(bias, {})
    of_fold = [F.sum(F.when(F.col("fold") == fold, F.col(n)).otherwise(0)).alias(f"{n}_{fold}") for fold in range(FOLDS) for n in ("n0", "n1")]
    counts = rows.mapInArrow(count, "feature string, fold int, n0 long, n1 long").groupBy("feature").agg(*of_fold)
    counts = written(counts.filter(sum(F.col(c) for c in counts.columns[1:]) >= LEAST_DOCS), "feature-counts")

    def best(folds: list[int]) -> dict[str, float]:
        """Features of the rows of some folds and their G2, the highest first."""
        n0, n1 = (sum((F.col(f"{n}_{fold}") for fold in folds), F.lit(0)) for n in ("n0", "n1"))
        g2 = _g2(n0, n1, *(sum(totals[fold, label] for fold in folds) for label in (0, 1)))
        found = counts.filter(n0 + n1 >= LEAST_DOCS).select("feature", g2.alias("g2")).filter(F.col("g2") >= min(CUTS)).orderBy(F.desc("g2"), "feature").limit(MAX_FEATURES).toPandas()
        return dict(zip(found["feature"], found["g2"]))

    # folds that leave rows of both labels to learn from and have rows to judge
    judged = [k for k in range(FOLDS) if totals[k, 0] + totals[k, 1] and all(totals[k, label] < n for label, n in ((0, clean), (1, toxic)))]
    chosen = {None: best(list(range(FOLDS)))} | {k: best([x for x in range(FOLDS) if x != k]) for k in judged}
    terms = [t for g in groups for t in g]
    names = list(dict.fromkeys([*(f for found in chosen.values() for f in found), *terms]))
    number = {f: i for i, f in enumerate(names)}

    def vector(text: str) -> list[int]:
        return sorted(number[f] for f in _present(text) if f in number)

    def change(sentence: str, other: str) -> list[int]:
        """Features that only the counterfactual has, and ~f of those that only the sentence has."""
        own, new = set(vector(sentence)), set(vector(other))
        return [*sorted(new - own), *(~f for f in sorted(own - new))]

    def vectors(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            changes = [[change(s, other) for s, other in counterfactual_sentences(t, groups) if other is not None] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("fold"), pa.array([vector(t) for t in texts], pa.list_(pa.int32())), pa.array(changes, pa.list_(pa.list_(pa.int32())))], names=["toxic", "fold", "own", "changes"])

    found = rows.mapInArrow(vectors, "toxic int, fold int, own array<int>, changes array<array<int>>").toPandas()
    every = _flat(found, np.array(stands))

    def used(fold: int | None, cut: float) -> np.ndarray:
        return np.array([chosen[fold].get(f, 0.0) >= cut for f in names]) | np.isin(names, terms)

    cut = _best_cut(docs.sparkSession, every, [(k, c, used(k, c)) for k in judged for c in CUTS])
    weights, bias = _minimise(every, used(None, cut))
    return Model(bias, {f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-6})


class Rows(NamedTuple):
    """Training rows as entries (row, feature), and the changes of features by counterfactual sentences as entries (pair, feature, +1 or -1)."""

    toxic: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    pair_row: np.ndarray
    pair: np.ndarray
    changed: np.ndarray
    sign: np.ndarray

    def only(self, good: np.ndarray) -> Rows:
        """The rows that are good."""
        at, kept = good[self.row], good[self.pair_row]
        both = kept[self.pair]
        number, pair_number = np.cumsum(good) - 1, np.cumsum(kept) - 1
        return Rows(self.toxic[good], self.weight[good], self.fold[good], number[self.row[at]], self.feature[at], number[self.pair_row[kept]], pair_number[self.pair[both]], self.changed[both], self.sign[both])


def _flat(found, stands: np.ndarray) -> Rows:
    """The collected vectors, in an order that doesn't depend on the tasks."""
    found = found.assign(key=[np.asarray(x).tobytes() for x in found["own"]]).sort_values(["fold", "toxic", "key"], kind="stable")
    own = [np.asarray(x, np.int64) for x in found["own"]]
    toxic = found["toxic"].to_numpy()
    pairs = [(i, np.asarray(x, np.int64)) for i, changes in enumerate(found["changes"]) for x in changes]
    none = np.empty(0, np.int64)
    changed = np.concatenate([none, *(x for _, x in pairs)])
    return Rows(
        toxic.astype(np.float64), stands[toxic], found["fold"].to_numpy(), np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([none, *own]),
        np.array([i for i, _ in pairs], np.int64), np.repeat(np.arange(len(pairs)), [len(x) for _, x in pairs]), np.where(changed < 0, ~changed, changed), np.where(changed < 0, -1.0, 1.0),
    )


def _best_cut(spark: SparkSession, every: Rows, tries: list[tuple[int, float, np.ndarray]]) -> float:
    """The cut of least loss over the folds it is tried on; each try is a task. The highest cut if there are none."""
    if not tries:
        return max(CUTS)
    shared = spark.sparkContext.broadcast((every, tries))

    def losses(batches):
        every, tries = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                fold, cut, used = tries[k]
                weights, bias = _minimise(every.only(every.fold != fold), used)
                test = every.only(every.fold == fold)
                z = np.bincount(test.row, weights[test.feature], len(test.toxic)) + bias
                loss = float((test.weight * np.logaddexp(0, np.where(test.toxic == 1, -z, z))).sum())
                yield pa.RecordBatch.from_pydict({"cut": [cut], "loss": [loss]})

    found = spark.range(0, len(tries), 1, len(tries)).mapInArrow(losses, "cut double, loss double").toPandas()
    total = {c: sum(sorted(found["loss"][found["cut"] == c])) for c in CUTS}
    return min(CUTS, key=lambda c: (total[c], -c))


def _minimise(rows: Rows, used: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (0 but for used features) and bias of least regularised loss, by Adam on all rows."""
    size, y, weight, pairs = len(used), rows.toxic, rows.weight, len(rows.pair_row)
    texts = len(np.unique(rows.pair_row))
    at, moving = used[rows.feature], used[rows.changed]
    row, col = rows.row[at], rows.feature[at]
    c_row, c_col, c_val = rows.pair[moving], rows.changed[moving], rows.sign[moving]
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(((weight * y).sum() + 0.5) / ((weight * (1 - y)).sum() + 1.5))
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], len(y)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(col, error[row], size), error.sum()) / weight.sum()
        g[:-1] += L2 * w[:-1] / max(1.0, np.sqrt(len(y)))
        if pairs:
            moved = np.bincount(c_row, c_val * w[c_col], pairs)
            g[:-1] += 2 * COUNTERFACTUAL * np.bincount(c_col, c_val * moved[c_row], size) / texts
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores of texts; each distinct word of a part of them is looked up once."""
    number = {f: i for i, f in enumerate(model.weights)}
    weights = np.array(list(model.weights.values()))
    z = np.full(len(texts), model.bias)
    words = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = words.flatten().dictionary_encode()
    hits = [sorted({number[f] for w in _WORDS.findall(u.lower()) for f in features_of(w) if f in number}) for u in coded.dictionary.to_pylist()]
    counts = np.array([len(h) for h in hits], np.int64)
    numbers = np.asarray(coded.indices).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(words.offsets)))
    some = counts[numbers] > 0 if len(hits) else np.zeros(0, bool)
    if some.any():
        numbers, owner = numbers[some], owner[some]
        values = np.array([f for h in hits for f in h], np.int64)
        starts = np.cumsum(counts) - counts
        feature = values[tokens.ragged(starts[numbers], counts[numbers])]
        key = np.unique(np.repeat(owner, counts[numbers]) * len(weights) + feature)
        z += np.bincount(key // len(weights), weights[key % len(weights)], len(texts))
    return 1 / (1 + np.exp(-z))


def _scored(batch: pa.RecordBatch, column: str, model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in tokens.slices(batch, column):
        yield part, _scores(model, part.column(column))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score``, ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = picked(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = pa.schema([(id_col, to_arrow_type(id_type)), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            for part, scores in _scored(batch, "text", shared.value):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], schema=arrow)

    return rows.mapInArrow(frugal(run), schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, scores in _scored(batch, text_col, shared.value):
                yield part.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(frugal(run), docs.schema)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fifth."""
    return labels.filter(~held_out(F.col(id_col))).select(id_col, "toxic")


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fifth that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
