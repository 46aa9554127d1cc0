"""Operator 11: language identification as inference of a mixture of languages.

Model (``fit``): each language has a chain of letters. The probability of a word
is the product, over its letters and its end, of the probability of the letter
after the two before it, smoothed by shorter contexts (Dirichlet, weight
``CONTEXT_WEIGHT``). Counts are taken from all training documents, not from a
sample: every task counts hashed n-grams of its distinct words (``BUCKETS``
buckets a language) and Spark adds the buckets up. The driver and each worker
hold ``BUCKETS`` numbers a language, whatever the corpus's size.

Inference (``identify``): a document is a bag of words, each drawn from one of
the document's languages, so its likelihood for proportions pi is the product
over words of sum pi[l] P(word | l). Languages are selected forward by penalised
likelihood: a document starts with its best single language (with the prior of
the training documents), the language with the largest gradient of the
likelihood is tried, expectation-maximisation estimates the proportions of the
larger set, and the set is kept if the log-likelihood rises by more than
``PENALTY`` log(words + 1). As the log-likelihood is concave, the rise is at
most words * log(gradient); where that is not above the penalty nothing is
tried. All documents of a slice take each step together in numpy.

Prediction: the language with the largest proportion (ties: the first by name),
``und`` if the text is null or has no letter. score is that proportion, for a
document of one language the posterior of the language among all languages.

A word is a run of letters in lower case; a run of more than ``LONGEST_WORD``
letters (scripts without spaces) counts as several words. Whole texts are read,
long ones in parts.

Scale: one narrow pass for the counts with a sum by (language, bucket), one
narrow pass for the predictions; no text is shuffled.

Defined results: an empty text is ``und`` with score 0; rows with a null
language or text teach nothing; repeated rows each count; without training rows
every prediction is ``und``; an empty table gives no rows; other columns are
ignored. ``doc_id``, source and the row's own language are no inputs of ``identify``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .shared import picked

#: a power of two
BUCKETS = 1 << 17
CONTEXT_WEIGHT = 4.0
#: letters a language may have beyond those seen, for the probability of a new one
ALPHABET = 1 << 12
LONGEST_WORD = 32
PENALTY = 2.0
#: steps of expectation-maximisation, and the change of a proportion that ends them
EM_STEPS = 50
EM_CHANGE = 1e-4
#: languages that a task counts before it hands their buckets on
HELD_LANGUAGES = 32

UNDETERMINED = "und"
#: buckets of grams of order 1, 2, 3, and of contexts of order 2, 3 are told apart by these
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: rows of the count table that are no bucket
_LETTERS, _DOCUMENTS = BUCKETS, BUCKETS + 1


_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST_WORD}}}")


def _letter_runs(text: str) -> list[str]:
    found = _WORD.findall(text)
    if found and not "".join(found).isalpha():
        # numbers that are no decimal digits (\u00b2, \u2167) count as \w: they are blanked
        numbers = {ord(c): " " for c in set(text) if c.isalnum() and not c.isalpha()}
        found = _WORD.findall(text.translate(numbers))
    return found


def words(text: str | None) -> Counter:
    """How often each word occurs in a whole text."""
    found: Counter = Counter()
    if text:
        for part in tokens.parts(text):
            found.update(_letter_runs(part.lower()))
    return found


def _hashed(salt: int, *letters: np.ndarray) -> np.ndarray:
    h = np.full(len(letters[0]), _SALTS[salt])
    for x in letters:
        h = (h ^ x) * _MIX
        h ^= h >> np.uint64(29)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def gram_buckets(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words: the number of the word at each letter or end, and the buckets there (grams of order 1 to 3, contexts of order 2 and 3)."""
    # a word is two opening marks, its letters and a closing mark (which opens the next one)
    data = np.frombuffer(("\x02\x02" + "\x03\x02\x02".join(distinct) + "\x03").encode("utf-32-le"), "<u4").astype(np.uint64)
    at = np.flatnonzero(data != 2)
    c, b, a = data[at], data[at - 1], data[at - 2]
    word = np.cumsum(c == 3) - (c == 3)
    return word, np.stack([_hashed(0, c), _hashed(1, b, c), _hashed(2, a, b, c), _hashed(3, b), _hashed(4, a, b)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used.astype(np.int32)), "n": pa.array(counts[used])})
        held.clear()

    for batch in batches:
        for rows in tokens.slices(batch, "text"):
            found: dict[str, Counter] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                own = found.setdefault(lang, Counter())
                own.update(words(text))
                own[""] += 1  # the document
            for lang, own in found.items():
                if lang not in held and len(held) >= HELD_LANGUAGES:
                    yield from out()
                counts = held.setdefault(lang, np.zeros(BUCKETS + 2, np.int64))
                counts[_DOCUMENTS] += own.pop("")
                if own:
                    word, buckets = gram_buckets(list(own))
                    n = np.fromiter(own.values(), np.int64, len(own))[word]
                    for row in buckets:
                        counts[:BUCKETS] += np.bincount(row, n, BUCKETS).astype(np.int64)
                    counts[_LETTERS] += int(n.sum())
    yield from out()


@dataclass
class Model:
    """Languages in order of name, their log prior, and the counts of their buckets."""

    languages: list[str]
    prior: np.ndarray
    counts: np.ndarray
    letters: np.ndarray

    def word_likelihoods(self, distinct: list[str]) -> np.ndarray:
        """log P(word | language): (words, languages)."""
        out = np.empty((len(distinct), len(self.languages)))
        word, (one, two, three, after_one, after_two) = gram_buckets(distinct)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        for k, counts in enumerate(self.counts):
            p = (counts[one] + 1.0) / (self.letters[k] + ALPHABET)
            p = (counts[two] + CONTEXT_WEIGHT * p) / (np.maximum(counts[after_one], counts[two]) + CONTEXT_WEIGHT)
            p = (counts[three] + CONTEXT_WEIGHT * p) / (np.maximum(counts[after_two], counts[three]) + CONTEXT_WEIGHT)
            out[:, k] = np.add.reduceat(np.log(p), first)
        return out


def fit(docs: DataFrame, training: Column, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of the documents for which training holds."""
    rows = picked(docs.where(F.coalesce(training, F.lit(False))), lang=lang_col, text=text_col).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most BUCKETS + 2 rows a language
    found = counted.toPandas()
    languages = sorted(found["lang"].unique().tolist())
    counts = np.zeros((len(languages), BUCKETS + 2))
    if languages:
        counts[np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object)), found["bucket"].to_numpy()] = found["n"].to_numpy()
    documents = counts[:, _DOCUMENTS]
    return Model(languages, np.log(np.maximum(documents, 1) / max(documents.sum(), 1)), counts[:, :BUCKETS].astype(np.float32), counts[:, _LETTERS])


class Bags:
    """Documents with at least one word: the distinct words of each, how often they occur, and their likelihoods."""

    def __init__(self, model: Model, counters: list[Counter]):
        sizes = np.array([len(c) for c in counters], np.int64)
        coded = pa.array(chain.from_iterable(counters), pa.string()).dictionary_encode()
        word = np.asarray(coded.indices)
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(counters)), sizes)
        self.n = np.fromiter(chain.from_iterable(c.values() for c in counters), np.float64, int(sizes.sum()))
        self.total = np.add.reduceat(self.n, self.starts)
        self.log_p = model.word_likelihoods(coded.dictionary.to_pylist())[word]
        self.best = self.log_p.max(axis=1, keepdims=True)
        self.p = np.exp(self.log_p - self.best)  # likelihoods but for a factor of the word

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of some documents, where each document starts among them, and each row's place in docs."""
        sizes = np.diff(self.starts, append=len(self.owner))[docs]
        rows = tokens.ragged(self.starts[docs], sizes)
        return rows, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(docs)), sizes)


def em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, owner: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after expectation-maximisation from pi (0 stays 0), and the log-likelihoods."""
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(EM_STEPS):
        joint = pi[owner] * p
        share = joint * (n / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        new = np.add.reduceat(share, starts) / total
        change, pi = np.abs(new - pi).max(initial=0), new
        if change < EM_CHANGE:
            break
    return pi, np.add.reduceat(n * np.log(np.maximum((pi[owner] * p).sum(axis=1), 1e-300)), starts)


def mixtures(model: Model, counters: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents, languages) of the selected languages, and the score of the largest; every counter has a word."""
    bags = Bags(model, counters)
    single = np.add.reduceat(bags.n[:, None] * bags.log_p, bags.starts) + model.prior
    first = single.argmax(axis=1)
    docs = np.arange(len(counters))
    pi = np.zeros(single.shape)
    pi[docs, first] = 1
    reached = np.add.reduceat(bags.n * (bags.log_p - bags.best)[np.arange(len(bags.owner)), first[bags.owner]], bags.starts)
    penalty = PENALTY * np.log(bags.total + 1)
    open_docs = docs
    while len(open_docs) and len(model.languages) > 1:
        rows, starts, owner = bags.of(open_docs)
        p, n = bags.p[rows], bags.n[rows]
        own = pi[open_docs]
        ratio = p / np.maximum((own[owner] * p).sum(axis=1, keepdims=True), 1e-300)
        gradient = np.add.reduceat(n[:, None] * ratio, starts) / bags.total[open_docs][:, None]
        gradient[own > 0] = 0
        new = gradient.argmax(axis=1)
        bound = bags.total[open_docs] * np.log(np.maximum(gradient[np.arange(len(new)), new], 1e-300))
        worth = bound > penalty[open_docs]
        tried, new = open_docs[worth], new[worth]
        if not len(tried):
            break
        rows, starts, owner = bags.of(tried)
        begin = pi[tried] * 0.5
        begin[np.arange(len(tried)), new] = 0.5
        found, likelihood = em(bags.p[rows], bags.n[rows], starts, owner, begin)
        better = likelihood - reached[tried] > penalty[tried]
        open_docs = tried[better]
        pi[open_docs], reached[open_docs] = found[better], likelihood[better]
    alone = np.exp(single - single.max(axis=1, keepdims=True))
    posterior = alone[docs, first] / alone.sum(axis=1)
    top = pi.max(axis=1)
    return pi, np.where((pi > 0).sum(axis=1) == 1, posterior, np.minimum(top, 1.0))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``languages`` (proportions of the selected languages) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType
    kind = T.MapType(T.StringType(), T.DoubleType())
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", kind)])
    arrow = pa.schema([("doc_id", to_arrow_type(id_type)), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                counters = [words(t) for t in rows.column("text").to_pylist()]
                known = [i for i, c in enumerate(counters) if c and model.languages]
                pred, score, parts = [UNDETERMINED] * len(counters), np.zeros(len(counters)), [[] for _ in counters]
                if known:
                    pi, score[known] = mixtures(model, [counters[i] for i in known])
                    for i, own in zip(known, pi):
                        pred[i] = names[own.argmax()]
                        parts[i] = [(names[k], float(own[k])) for k in np.flatnonzero(own)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(parts, arrow.field("languages").type)], schema=arrow)

    return picked(docs, doc_id=id_col, text=text_col).mapInArrow(predict, schema)
