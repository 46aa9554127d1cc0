"""Operator 9: URL filters by a bit-parallel wildcard automaton.

All rules become globs over the canonical URL (host, a separator, path). The
automaton has one bit for each position of each glob, packed into 64-bit words,
and simulates all globs together (Shift-And with self-loops for wildcards): for
one character, ``D = (shift(D) & mask[character]) | (D & loop[character])``
followed by the empty moves over wildcards. Shifts carry from word to word; no
glob's bits spill into the next, as the first bit of a glob is cleared.

A batch of URLs is stepped together through numpy, one character position at a
time, longest URLs first, so work is (characters of the batch) x (words).
The rules are a parameter of the job: their masks take 256 x words x 16 bytes,
checked against ``MAX_MASK_BYTES``, and travel with the tasks. No shuffle.

Wildcards: ``*`` any run without a separator, ``**`` any run, ``?`` one
character that is no separator. A glob has to match from the start of the
canonical URL; it ends with ``**`` to match prefixes. The longest rule (by the
text of its host and path) wins; of equally long rules, the first.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and gets the default verdict; repeated rows stay; an empty table
gives no rows; other columns are ignored. URLs of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import picked

SEPARATOR = "\x00"
MAX_MASK_BYTES = 256 << 20
#: characters of URLs that are stepped together
BATCH_BYTES = 4_000_000


class Rule(NamedTuple):
    name: str
    verdict: str
    globs: tuple[str, ...]


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains, and the paths that start with path."""
    return Rule(host + path, verdict, tuple(f"{lead}{host}{SEPARATOR}{path}**" for lead in ("", "*.")))


class Automaton:
    """Masks of all globs of all rules, packed into 64-bit words."""

    def __init__(self, rules: Sequence[Rule]):
        symbols, starts, ends, empties, owner = [], [], [], [], []
        for number, rule in enumerate(rules):
            for glob in rule.globs:
                starts.append(len(symbols))
                symbols.append(("start", None))
                raw, i = glob.encode(), 0
                while i < len(raw):
                    if raw[i : i + 2] == b"**":
                        kind, i = ("any", None), i + 2
                    elif raw[i : i + 1] == b"*":
                        kind, i = ("run", None), i + 1
                    elif raw[i : i + 1] == b"?":
                        kind, i = ("one", None), i + 1
                    else:
                        kind, i = ("byte", raw[i]), i + 1
                    symbols.append(kind)
                ends.append(len(symbols) - 1)
                owner.append(number)
        self.words = -(-len(symbols) // 64)
        if 2 * 256 * self.words * 8 > MAX_MASK_BYTES:
            raise ValueError("too many rules for one automaton")
        take = np.zeros((256, self.words * 64), bool)
        loop = np.zeros((256, self.words * 64), bool)
        inside = np.arange(256) != ord(SEPARATOR)
        for at, (kind, byte) in enumerate(symbols):
            if kind == "byte":
                take[byte, at] = True
            elif kind == "one":
                take[inside, at] = True
            elif kind == "run":
                loop[inside, at] = True
                empties.append(at)
            elif kind == "any":
                loop[:, at] = True
                empties.append(at)
        self.take, self.loop = _packed(take), _packed(loop)
        flags = np.zeros((3, self.words * 64), bool)
        flags[0, starts], flags[1, empties], flags[2, ends] = True, True, True
        self.start, self.empty, self.end = _packed(flags)
        # wildcards in a row need as many empty moves
        runs, best = 0, 0
        for kind, _ in symbols:
            runs = runs + 1 if kind in ("run", "any") else 0
            best = max(best, runs)
        self.moves = best
        self.ends, self.owner = np.array(ends, np.int64), np.array(owner, np.int64)
        self.rules = len(rules)

    def _shift(self, d: np.ndarray) -> np.ndarray:
        up = d << np.uint64(1)
        up[:, 1:] |= d[:, :-1] >> np.uint64(63)
        return up

    def _closed(self, d: np.ndarray) -> np.ndarray:
        for _ in range(self.moves):
            d = d | (self._shift(d) & self.empty)
        return d

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """urls x rules: which rules fit."""
        lengths = np.array([len(u) for u in urls], np.int64)
        by = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(urls), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[by]
        left = lengths[by]
        d = self._closed(np.repeat(self.start[None, :], len(urls), axis=0))
        for s in range(int(left[0]) if len(urls) else 0):
            n = int(np.searchsorted(-left, -s, side="left"))
            c = data[starts[:n] + s]
            now = d[:n]
            d[:n] = self._closed((self._shift(now) & self.take[c]) | (now & self.loop[c]))
        final = (d[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & np.uint64(1)
        out = np.zeros((len(urls), self.rules), bool)
        for k, rule in enumerate(self.owner):
            out[by, rule] |= final[:, k].astype(bool)
        return out


def _packed(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=-1, bitorder="little").view("<u8").astype(np.uint64)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (name of the longest that fits, else null), ``verdict`` of every row."""
    pages = picked(pages, id=id_col, url=url_col)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("id", host.alias("host"), path.alias("path"))
    id_type = pages.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    arrow = pa.schema([(id_col, to_arrow_type(id_type)), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))])
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton(ranked)

    def run(batches):
        names = np.array([r.name for r in ranked] + [None], object)
        verdicts = np.array([r.verdict for r in ranked] + [default], object)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            # the separator can't come from the URL, and an empty host fits nothing
            urls = [f"{h}{SEPARATOR}{p}".encode() if h and SEPARATOR not in h else b"" for h, p in zip(hosts, paths)]
            sizes = np.cumsum([len(u) for u in urls])
            best = np.full(len(urls), len(ranked), np.int64)
            cuts = np.flatnonzero(np.diff(sizes // BATCH_BYTES, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(urls)]):
                fits = automaton.fits(urls[a:b])
                if fits.size:
                    best[a:b] = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())], schema=arrow)

    return parsed.mapInArrow(run, schema)
