"""Byte-level BPE ids of whole texts, encoded once per distinct word of a batch.

The vocabulary file is read on the driver (a local path or any path Spark can
open), checked against ``MAX_VOCABULARY_BYTES``, broadcast as text and loaded
once per Python worker, so executors need no file of their own.

A text is cut before a space or a line break wherever the tokenizer's split
pattern is sure to start a new pre-token there:

* before a white-space character that follows a non-space, and
* before the last white-space character of a run that a non-space follows,

so runs of at most two white-space characters inside a text may be cut at each
of them; texts with longer runs, or with two at their end, are cut only before
a space that a non-space follows. No special token contains white space. The
ids of the pieces, put together, are therefore the ids of the text. Each
distinct piece of a batch is encoded once: pieces of letters below U+0250,
digits and marks by ``tiktoken`` with the same merges (checked when the
vocabulary is loaded: ids rise with the order of merges), all others by
``tokenizers``. The tests hold both against ``tokenizers`` on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

MAX_VOCABULARY_BYTES = 64 << 20
#: Characters that are encoded together; a longer text is cut into such parts at sure borders.
BATCH_CHARS = 3_000_000
IDS = np.dtype("<u4")
#: Units, and ids of them, that an encoder remembers; longer units are encoded each time.
MAX_KNOWN_UNITS = 200_000
MAX_KNOWN_IDS = 2_000_000
LONGEST_KNOWN_UNIT = 64

#: Fixed value: the split pattern of byte-level BPE tokenizers of this kind.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"  # more than any library's \s
_LONG_RUN = f"{_SPACES}{_SPACES}(?:{_SPACES}|$)|[\x01\x02]"
_SURE_CUT = re.compile(r" (?=\S)")
_PLAIN = re.compile(r"[^\sɐ-\U0010ffff]+")


def read_vocabulary(spark: SparkSession, path: str) -> str:
    """The text of a tokenizer file, local to the driver or on a path Spark reads."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read(MAX_VOCABULARY_BYTES + 1)
    else:
        text = spark.read.text(path, wholetext=True).first()[0]
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file larger than {MAX_VOCABULARY_BYTES} bytes: {path}")
    return text


def vocabulary_size(text: str) -> int:
    spec = json.loads(text)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]
    return max(ids) + 1


def byte_letters() -> dict[int, str]:
    """Byte -> letter of byte-level BPE: printable Latin-1 stays, the rest moves to U+0100 and up."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(moved)}


class ByteLevelEncoder:
    """ids of texts as ``tokenizers`` gives them by default, without added special tokens."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.loads(vocabulary)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("only byte-level tokenizers with the usual split pattern and no prefix space")
        if spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("the tokenizer normalises, drops or skips merges")
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("an added token depends on the spaces around it")
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids don't rise with the order of merges")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(back[c] for c in w): i for w, i in model["vocab"].items() if w not in self.specials}
        self.fast = tiktoken.Encoding("words", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(vocabulary_size(vocabulary), np.int64)
        for word, i in ranks.items():
            self.width[i] = len(word)
        self._forget()

    def encode_unit(self, unit: str) -> np.ndarray:
        """ids of one string by ``tokenizers``."""
        return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, IDS)

    def plain(self, units: list[str]) -> list[bool]:
        """Which units are a space or line break and characters below U+0250 without white space or special strings."""
        plain = [bool(u[:1] in (" ", "\n") and _PLAIN.fullmatch(u, 1)) for u in units]
        whole = "\n".join(units)
        if any(s in whole for s in self.specials):
            plain = [p and not any(s in u for s in self.specials) for p, u in zip(plain, units)]
        return plain

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of many units, and where those of each of these distinct units start and how many they are.

        Units are kept from call to call while there are at most MAX_KNOWN_UNITS with MAX_KNOWN_IDS ids; when
        no more fit and less than a third of the units are known, all are forgotten."""
        place = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        at = np.flatnonzero(place < 0)
        values, counts = self.values, self.counts
        if len(at):
            new = [units[i] for i in at]
            own, sizes = self._encode_new(new)
            place[at] = np.arange(len(counts), len(counts) + len(new))
            values, counts = np.concatenate([values, own]), np.concatenate([counts, sizes])
            if len(counts) <= MAX_KNOWN_UNITS and len(values) <= MAX_KNOWN_IDS:
                self.known.update((u, i) for u, i in zip(new, place[at].tolist()) if len(u) <= LONGEST_KNOWN_UNIT)
                self.values, self.counts = values, counts
            elif 3 * (len(units) - len(new)) < len(units):
                self._forget()
        return values, (np.cumsum(counts) - counts)[place], counts[place]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.counts = np.empty(0, IDS), np.empty(0, np.int64)

    def _encode_new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of units, one after another, and how many each has."""
        plain = self.plain(units)
        counts = np.zeros(len(units), np.int64)
        at = np.flatnonzero(plain)
        quick = np.empty(0, IDS)
        if len(at):
            chosen = [units[i] for i in at]
            quick = self.fast.encode_to_numpy("".join(chosen)).astype(IDS)
            ends = np.cumsum([len(u.encode()) for u in chosen])
            stop = np.searchsorted(np.cumsum(self.width[quick]), ends) + 1
            counts[at] = np.diff(stop, prepend=0)
        if len(at) == len(units):
            return quick, counts
        slow = {i: self.encode_unit(u) for i, u in enumerate(units) if not plain[i]}
        for i, ids in slow.items():
            counts[i] = len(ids)
        values = np.empty(int(counts.sum()), IDS)
        starts = np.cumsum(counts) - counts
        values[ragged(starts[at], counts[at])] = quick
        for i, ids in slow.items():
            values[starts[i] : starts[i] + len(ids)] = ids
        return values, counts

    def units(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of texts: the number of each unit's text, the distinct units, and the unit numbers in order."""
        odd = pc.match_substring_regex(texts, _LONG_RUN)
        if pc.any(odd).as_py():
            cut = [_marked(_SURE_CUT.split(t)) if o else t.replace("\n", " \x01").split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist())]
            lists = pa.array(cut, pa.list_(pa.large_string()))
        else:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \x01"), " ")
        ends = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        words, numbers = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        units = ["\n" + w[1:] if w[:1] == "\x01" else " " + w[1:] if w[:1] == "\x02" else " " + w for w in words]
        first = ends[:-1] - ends[0]  # the first piece of a text has no space before it
        leads = numbers[first]
        opening, numbers[first] = np.unique(leads, return_inverse=True)
        numbers[first] += len(units)
        units += [words[i] for i in opening]
        return np.repeat(np.arange(len(texts)), np.diff(ends)), units, numbers

    def _encode_some(self, texts: pa.Array) -> list[np.ndarray]:
        owner, units, numbers = self.units(texts)
        values, starts, counts = self._encode_units(units)
        n = counts[numbers]
        ids = values[ragged(starts[numbers], n)]
        return np.split(ids, np.cumsum(np.bincount(owner, n, len(texts)).astype(np.int64))[:-1])

    def unit_counts(self, units: list[str]) -> np.ndarray:
        """The number of ids of each of distinct units."""
        return self._encode_new(units)[1]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each whole text; null is empty."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if len(text) > BATCH_CHARS:
                yield from self._flush(held)
                held, size = [], 0
                yield np.concatenate([x for part in parts(text) for x in self._encode_some(pa.array([part], pa.large_string()))])
                continue
            held.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, texts: list[str]) -> list[np.ndarray]:
        return self._encode_some(pa.array(texts, pa.large_string())) if texts else []


def _marked(pieces: list[str]) -> list[str]:
    """Pieces of a text as they are, those after the first marked if they start like a mark."""
    return pieces[:1] + ["\x02" + p if p[:1] in ("\x01", "\x02") else p for p in pieces[1:]]


def parts(text: str) -> Iterator[str]:
    """A very long text in parts that end before a space which a non-space follows (or one part if it has none)."""
    start = 0
    while len(text) - start > BATCH_CHARS and (m := _SURE_CUT.search(text, start + BATCH_CHARS)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def slices(batch: pa.RecordBatch, column: str, chars: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about BATCH_CHARS or the given number of characters (or one longer text)."""
    chars = chars or BATCH_CHARS
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - lengths) // chars
    for a, b in zip(*(lambda x: (x, [*x[1:], len(part)]))(np.flatnonzero(np.diff(part, prepend=-1)).tolist())):
        yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each of many runs, one run after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - ends + counts, counts)


_ENCODERS: dict[int, ByteLevelEncoder] = {}


def worker_encoder(vocabulary) -> ByteLevelEncoder:
    """The worker's encoder for a broadcast vocabulary, loaded once per Python process."""
    key = hash(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteLevelEncoder(vocabulary.value)
    return _ENCODERS[key]
