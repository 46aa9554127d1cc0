"""Operator 12: how the sources of each language differ in their words.

Counting (``term_counts``) is length-bucketed packing. A term is a run of ASCII
letters and bytes from 0x80 in a text's UTF-8, so its borders and its lower
case (A-Z only) are byte operations on the Arrow buffer of many texts, without
a Python step a term. A term of at most 8 bytes becomes one big-endian
``uint64``, one of at most 16 bytes two; both are put in order by a least
significant digit first radix sort (16-bit digits, the group last) and counted
by runs. The sort is stable and texts are in order, so a run's documents are its
changes of text. Longer terms go to buckets of 32, 64, 128, ... bytes that are
sorted as bytes.

A chunk of ``CHUNK_BYTES`` gives one row a (language, source, term) it holds;
Spark adds them up with partial aggregation, and by (language, term) keeps the
terms of enough documents. The kept terms are a table in the shared folder.

Divergence (``audit``): p is a term's smoothed share of a group in units of
1e-9, rounded down (decimals, ``div``). The value of two sources is the sum over
*all* kept terms of f(p, q) = floor((p - q)^2 / (p + q)), also over those that
neither has. With p0 the share of a term that a source lacks it is split into
  V f(p0A, p0B)  +  sum over terms of A of f(pA, p0B) - f(p0A, p0B)  +  same of B
  +  sum over terms of both of f(pA, pB) - f(pA, p0B) - f(p0A, pB) + f(p0A, p0B):
the second part needs only how many terms of A have each count (a small table
joined to the sources of the language), and the third is summed in numpy over
batches of terms, each batch giving one row a pair of sources it has. No rows of
(term, source, source) exist. Every pair of sources of a language is in the
result, so its size is the square of the sources by definition.

Skew: a hot source or language is many terms, and terms are in every key that
is shuffled; top terms are ranked behind a partial limit. Shares of groups join
by size as Spark finds them.

Defined results: null text, language and source are ''; an empty text has no
term but its group counts; repeated rows are documents of their own; ties rank
by UTF-8 order; a language without kept terms gives pairs of value 0; an empty
table gives no rows; other columns are ignored. A text longer than a chunk is
counted in parts cut at bytes that no term has, and is one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import picked, written
from .tokens import ragged

#: Bytes of text that are counted together.
CHUNK_BYTES = 8 << 20
#: Values of a matrix (terms x sources) that are compared together.
MATRIX_VALUES = 1 << 20
SCALE = 1_000_000_000

_BYTES = np.arange(256)
_CAPITAL = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
IN_TERM = (_BYTES >= 0x80) | _CAPITAL | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LOWER = np.where(_CAPITAL, _BYTES + 0x20, _BYTES).astype(np.uint8)


def term_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every term of texts that lie one after another and stop at ends."""
    inside = IN_TERM[data]
    sizes = np.diff(ends, prepend=0)
    first, last = (ends - sizes)[sizes > 0], ends[sizes > 0] - 1
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    stops[:-1] &= ~inside[1:]
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1 - starts


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by unsigned keys, the most significant first, one 16-bit digit a pass."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if digit.min(initial=0xFFFF) != digit.max(initial=0):
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit keys by radix
    return order


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The bytes of terms of at most width bytes, zeros behind: (terms, width)."""
    found = np.lib.stride_tricks.sliding_window_view(data, width)[starts]
    found[np.arange(width) >= lengths[:, None]] = 0
    return found


def run_counts(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Group, start, length, occurrences and texts of each distinct (group, term), bucket by bucket; data is lower case."""
    starts, lengths = term_spans(data, ends)
    text = np.searchsorted(ends, starts, side="right")
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    widths = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        if width > 16 and len(data) < int(starts[at[-1]]) + width:
            data = np.concatenate([data, np.zeros(width, np.uint8)])
        s, n, t = starts[at], lengths[at], text[at]
        g = group[t]
        rows = _packed(data, s, n, width)
        if width <= 16:
            words = rows.view(">u8").astype(np.uint64)
            order = radix_order([g, *words.T])
            changed = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        else:
            terms = rows.view(f"S{width}").ravel()
            order = np.argsort(terms, kind="stable")
            order = order[radix_order([g[order]])]
            changed = terms[order[1:]] != terms[order[:-1]]
        g, t = g[order], t[order]
        opens = np.concatenate([[True], changed | (g[1:] != g[:-1])])
        run = np.flatnonzero(opens)
        fresh = opens.copy()
        fresh[1:] |= t[1:] != t[:-1]
        head = order[run]
        yield g[run], s[head], n[head], np.diff(run, append=len(order)), np.add.reduceat(fresh.astype(np.int64), run)


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, lengths)]))


_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of texts without nulls, and the ends of the texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return LOWER[data], offsets[1:] - offsets[0]


def _segments(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about CHUNK_BYTES, cut at bytes outside terms."""
    start = 0
    while start < len(data):
        stop = min(start + CHUNK_BYTES, len(data))
        while stop < len(data) and not len(gap := np.flatnonzero(~IN_TERM[data[stop : stop + CHUNK_BYTES]])):
            stop = min(stop + CHUNK_BYTES, len(data))
        if stop < len(data):
            stop += int(gap[0])
        yield data[start:stop]
        start = stop


def _long_text(lang: str, source: str, data: np.ndarray) -> pa.RecordBatch:
    """Counts of one text, added up over its parts."""
    found, none = [pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})], np.zeros(1, np.uint32)
    for part in _segments(data):
        for _, s, n, times, _ in run_counts(part, np.array([len(part)]), none):
            found.append(pa.table({"term": _strings(part, s, n), "n": times}))
        found = [pa.concat_tables(found).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])]
    whole = found[0].combine_chunks().to_batches()
    terms, times = (whole[0].column("term"), whole[0].column("n")) if whole else (pa.array([], pa.string()), pa.array([], pa.int64()))
    size = len(terms)
    return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, times, pa.array(np.ones(size, np.int64))], schema=_SCHEMA)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = _buffer(batch.column("text"))
        sizes = np.diff(ends, prepend=0)
        pairs = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        groups = list(dict.fromkeys(zip(*(x.to_pylist() for x in pairs.flatten()))))
        number = {g: i for i, g in enumerate(groups)}
        group = np.array([number[g] for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.uint32)
        chunk = np.cumsum(sizes) // CHUNK_BYTES
        chunk = np.cumsum(np.diff(chunk, prepend=0) > 0) if len(chunk) else chunk
        for a, b in zip(*(lambda x: (x, [*x[1:], len(chunk)]))(np.flatnonzero(np.diff(chunk, prepend=-1)).tolist())):
            start, stop = int(ends[a] - sizes[a]), int(ends[b - 1])
            if b - a == 1 and sizes[a] > CHUNK_BYTES:
                yield _long_text(*groups[group[a]], data[start:stop])
                continue
            langs, sources = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
            for g, s, n, times, docs in run_counts(data[start:stop], ends[a:b] - start, group[a:b]):
                g = pa.array(g.astype(np.int64))
                yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), _strings(data[start:stop], s, n), pa.array(times.astype(np.int64)), pa.array(docs)], schema=_SCHEMA)


def cleaned(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source`` and ``text`` of docs, nulls as ''."""
    rows = picked(docs, lang=lang_col, source=source_col, text=text_col)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents that have it) of cleaned documents."""
    found = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """``lang``, ``term``, ``total`` and ``at`` (source, n) of the terms in at least least_docs documents of a language."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("at"))
    return kept.where(F.col("docs") >= least_docs).drop("docs")


def share(count: str, size: str, terms: str) -> Column:
    """1 + floor(1e9 (count + 2) / (size + 2 terms)), exactly."""
    wide = "CAST({} AS DECIMAL(20, 0))".format
    return F.expr(f"1 + ({SCALE}BD * ({wide(count)} + 2)) div ({wide(size)} + 2 * {wide(terms)})")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2^31, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for every occurring (lang, source): number in the language, size, and the language's terms and size."""
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    sizes = kept.select("lang", F.explode("at").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("size"))
    found = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])
    return found.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of a pair's value that only terms of both sources have, summed over a batch: one row a pair."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        per_term = np.diff(np.asarray(batch.column("at").offsets))
        flat = batch.column("at").flatten()
        number, p, p0 = (np.asarray(flat.field(c)) for c in ("number", "p", "p0"))
        term = np.repeat(np.arange(batch.num_rows), per_term)
        lang_of_term = np.asarray(langs.indices)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(lang_of_term[term] == k)
            sources, first, column = np.unique(number[own], return_index=True, return_inverse=True)
            base = p0[own][first]
            terms, row = np.unique(term[own], return_inverse=True)
            step = max(1, MATRIX_VALUES // len(sources))
            for start in range(0, len(terms), step):
                here = (row >= start) & (row < start + step)
                p_of = np.tile(base, (min(step, len(terms) - start), 1))
                has = np.zeros(p_of.shape, bool)
                p_of[row[here] - start, column[here]] = p[own][here]
                has[row[here] - start, column[here]] = True
                for a in range(len(sources)):
                    q = p_of[has[:, a]]
                    pa_, pa0 = q[:, a : a + 1], base[a]
                    # a term that b lacks has q = p0 there, and adds nothing
                    total = (f(pa_, q) - f(pa_, base) - f(pa0, q) + f(pa0, base)).sum(axis=0)
                    some = np.flatnonzero((total != 0) & (np.arange(len(sources)) != a))
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), sources[a], np.int32)), pa.array(sources[some].astype(np.int32)), pa.array(total[some])], schema=schema)


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b`` (numbers of different sources) and ``value``, both ways round, of every pair of a language."""
    p0 = groups.select("lang", "number", "terms", F.when(F.col("terms") > 0, share("0", "size", "terms")).alias("p0"))
    one = p0.select("lang", F.col("number").alias("a"), "terms", F.col("p0").alias("p0_a"))
    other = p0.select("lang", F.col("number").alias("b"), F.col("p0").alias("p0_b"))
    lacking = divergence("p0_a", "p0_b")
    neither = one.join(other, "lang").where("a <> b").select("lang", "a", "b", F.coalesce(F.col("terms") * lacking, F.lit(0)).alias("value"))

    held = rows.groupBy("lang", F.col("number").alias("a"), F.col("p").alias("p_a"), F.col("p0").alias("p0_a")).agg(F.count("*").alias("m"))
    of_one = held.join(other, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (divergence("p_a", "p0_b") - lacking)).alias("value"))
    turned = of_one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")

    at = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p", "p0")).alias("at"))
    both = at.select("lang", "at").mapInArrow(_together, "lang string, a int, b int, value long")
    return neither.unionByName(of_one).unionByName(turned).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair`` ranks all other sources of the language by divergence, part ``term`` the top terms that the
    source uses more than its language does.
    """
    docs = cleaned(docs, lang_col, source_col, text_col)
    kept = written(kept_terms(term_counts(docs), least_docs), "kept-terms")
    groups = written(_groups(docs, kept), "groups")
    rows = kept.select("lang", "term", "total", F.explode("at").alias("x")).select("lang", "term", "total", "x.source", "x.n").join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "number", "term", share("n", "size", "terms").alias("p"), share("0", "size", "terms").alias("p0"), share("total", "lang_size", "terms").alias("q"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    name = groups.select("lang", "number", "source")
    pairs = pair_values(rows, groups)
    pairs = pairs.join(name.select("lang", F.col("number").alias("a"), "source"), ["lang", "a"]).join(name.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return terms.unionByName(pairs)
