"""Operator 1: benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case words with single spaces. An
item of L characters may differ by ``floor(ERROR_RATE * L)`` edits. Split into
one piece more than that (8 characters at least), at least one piece of it is in every such passage
unchanged (pigeonhole), so the exact hits of all pieces, found in one pass of
an Aho-Corasick automaton over each whole text, are all the places to look at.
There Myers' bit-parallel algorithm gives the edit distance of the item to the
best passage of the window around the hit.

A document is contaminated by an item if a passage of it is within the item's
budget; a quoted fragment of an item is not. One row for each (document, item)
has the smallest distance, the first passage with it, and its span in the
original text (code points, end exclusive).

Scale: one pass over the documents without a shuffle, for each block of items.
Items are the stated query set: their sizes are summed first and they are dealt
into blocks of about ``BLOCK_CHARS`` characters, each collected, checked and
broadcast by itself. Hits that belong to the same alignment are verified once.

Defined results: null and empty documents match nothing; items without words
match nothing, those of less than 16 characters have no budget and match
exactly, of less than ``LEAST_WITHIN`` characters only as whole words; repeated documents and items give a row each; null
ids stay; empty tables give no rows; other columns are ignored by ``leaks`` and
kept by ``clean``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .shared import frugal, picked

ERROR_RATE = 1 / 16
LEAST_WITHIN = 12
BLOCK_CHARS = 4_000_000

_WORDS = re.compile(r"\w+")


class Item(NamedTuple):
    item_id: object
    text: str
    budget: int


class Leak(NamedTuple):
    number: int
    distance: int
    start: int
    end: int


def normal(text: str | None) -> str:
    """Lower-case words with single spaces."""
    return " ".join(_WORDS.findall((text or "").lower()))


def item_of(item_id, text: str | None) -> Item:
    text = normal(text)
    return Item(item_id, text, math.floor(ERROR_RATE * len(text)))


def pieces(item: Item) -> list[tuple[int, str]]:
    """The item's text in budget + 1 pieces, with their places."""
    n = item.budget + 1
    cuts = [len(item.text) * k // n for k in range(n + 1)]
    return [(a, item.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], length: int, text: str, free: bool) -> tuple[int, int]:
    """Least edit distance of a pattern to a passage that ends in text, and the first end of such a passage.

    With free, a passage may start anywhere; else it starts at the text's start.
    """
    top, all_bits = 1 << (length - 1), (1 << length) - 1
    plus, minus, score = all_bits, 0, length
    best, end = length, 0
    for at, c in enumerate(text, 1):
        match = masks.get(c, 0)
        vertical = match | minus
        across = (((match & plus) + plus) ^ plus) | match
        up = minus | (all_bits & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) | (0 if free else 1)
        down <<= 1
        plus = (down | (all_bits & ~(vertical | up))) & all_bits
        minus = up & vertical & all_bits
        if score < best:
            best, end = score, at
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = [i for i in items if i.text]
        self.masks: dict[int, tuple] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(self.items):
            for start, piece in pieces(item):
                places.setdefault(piece, []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def _best(self, number: int, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """Distance, start and end of the best passage of text[lo:hi] within the item's budget."""
        item = self.items[number]
        n = len(item.text)
        if number not in self.masks:
            self.masks[number] = masks_of(item.text), masks_of(item.text[::-1])
        ahead, back = self.masks[number]
        distance, end = myers(ahead, n, text[lo:hi], free=True)
        if distance > item.budget:
            return None
        # the longest passage with that end and distance is as far as the pattern and the edits reach
        before = text[max(0, lo + end - n - distance) : lo + end][::-1]
        _, length = myers(back, n, before, free=False)
        return distance, lo + end - length, lo + end

    def leaks(self, text: str) -> list[Leak]:
        """The best passage of every item in a normalised text."""
        if not self.any or not text:
            return []
        spots: dict[tuple[int, int], int] = {}
        for last, (length, at) in self.automaton.iter(text):
            for number, start in at:
                # alignments within the budget of one another are seen in one window
                origin = last + 1 - length - start
                width = self.items[number].budget + 1
                spots.setdefault((number, origin // width), origin)
        best: dict[int, tuple[int, int, int]] = {}
        for (number, _), origin in sorted(spots.items()):
            item = self.items[number]
            if not item.budget:
                a, b = origin, origin + len(item.text)
                whole = (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")
                found = (0, a, b) if whole or len(item.text) >= LEAST_WITHIN else None
            else:
                # of alignments of one cell the others start less than a budget away
                reach = 2 * item.budget + 1
                found = self._best(number, text, max(0, origin - reach), min(len(text), origin + len(item.text) + reach))
            if found and found < best.get(number, (1 << 60, 0, 0)):
                best[number] = found
        return [Leak(n, *x) for n, x in sorted(best.items())]


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """The span of a text that a span of its normal form came from."""
    at, first, last = 0, None, 0
    low, where = _lowered(text)
    for m in _WORDS.finditer(low):
        length = m.end() - m.start()
        if first is None and start < at + length + 1:
            first = where(m.start() + min(max(start - at, 0), length))
        if end > at:
            last = where(m.start() + min(end - at, length))
        at += length + 1
        if at >= end:
            break
    return first or 0, last


def _lowered(text: str):
    """The lower-case text, and the map from its places to the text's (a few letters have longer lower-case forms)."""
    low = text.lower()
    if len(low) == len(text):
        return low, lambda i: i
    ends, total = [], 0
    for c in text:
        total += len(c.lower())
        ends.append(total)
    return low, lambda i: bisect.bisect_right(ends, i) if i < total else len(text)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """The test items, block by block."""
    rows = picked(benchmark, id=id_col, text=text_col).filter(F.col("text").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // BLOCK_CHARS) or 1
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == k)
        yield [item_of(r["id"], r["text"]) for r in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col``, ``item_id_col``, ``distance``, ``start``, ``end``: one row for each contaminated document and item."""
    rows = picked(docs, id=id_col, text=text_col)
    id_type, item_type = rows.schema["id"].dataType, benchmark.schema[item_id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField(item_id_col, item_type), *(T.StructField(c, T.IntegerType()) for c in ("distance", "start", "end"))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    found = None
    for items in item_blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def match(batches, shared=shared):
            matcher = Matcher(shared.value)
            for batch in batches:
                out = []
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    for leak in matcher.leaks(normal(text)):
                        out.append((i, matcher.items[leak.number].item_id, leak.distance, *_original(text, leak.start, leak.end)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, arrow)], schema=arrow)

        part = rows.mapInArrow(match, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    for items in item_blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches, shared=shared):
            matcher = Matcher(shared.value)
            for batch in batches:
                for part in tokens.slices(batch, text_col):
                    yield part.filter(pa.array([not matcher.leaks(normal(t)) for t in part.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(frugal(keep), docs.schema)
    return docs
