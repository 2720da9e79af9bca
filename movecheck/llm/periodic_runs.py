"""Periodic runs of words: internal pattern matching over suffix array and wavelet tree.

Blocks of 2^k words at multiples of 2^k are looked up in the neighbouring window: all places
where a block stands again between 2^k and 2^(k+1) words later are one interval of the suffix
array, cut by text position, and a range successor query on a wavelet tree over the suffix
array finds the first, second and last of them. They form an arithmetic progression, which
names the periods worth a check: a run of period q in [2^k, 2^(k+1)) that repeats four times
holds a whole block and the same block q words later.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MIN_LENGTH = 6
#: Periods that a run must hold; with fewer than four, a block and its repeat might not fit in.
MIN_TIMES = 4
#: Words of texts that are searched in one suffix array; a longer text has one of its own.
CHUNK_WORDS = 60_000


class _Codes(dict):
    """Numbers of words, from 0 as they come."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class Factors:
    """Ranks of all factors of 2^k words of a sequence, and its suffix array.

    ``ranks[k][i]`` is the number of suffixes whose first 2^k words are smaller than those at
    i; equal ranks are equal factors. Prefix doubling sorts only what is still ambiguous, so
    ordinary text is done after a few levels. The sequence must end in a word of its own.
    """

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        counts = np.bincount(words)
        rank = (np.cumsum(counts) - counts)[words]
        size = counts[words]
        self.n, self.ranks, self.sizes = n, [], []
        while True:
            self.ranks.append(rank.astype(np.int32))
            self.sizes.append(size.astype(np.int32))
            active = np.flatnonzero(size > 1)
            if not len(active):
                break
            # What repeats holds no end, so the factor after it begins inside the sequence.
            key = rank[active] * n + rank[active + (1 << len(self.ranks) - 1)]
            order = np.argsort(key)
            key, at = key[order], active[order]
            fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            old = rank[at]
            begun = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
            length = np.diff(np.append(fresh, len(at)))
            first = np.repeat(fresh, length) - np.repeat(begun, np.diff(np.append(begun, len(at))))
            rank, size = rank.copy(), size.copy()
            rank[at] = old + first
            size[at] = np.repeat(length, length)
        self.suffixes = np.empty(n, dtype=np.int64)
        self.suffixes[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are the same from ``i`` and ``j`` (which differ) on."""
        same = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i + same, j + same
            inside = (a < self.n) & (b < self.n)
            rank = self.ranks[k]
            same += (inside & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)])).astype(np.int64) << k
        return same

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are the same up to ``i`` and ``j`` (which differ), backwards."""
        same = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - same - (1 << k) + 1, j - same - (1 << k) + 1
            rank = self.ranks[k]
            same += ((a >= 0) & (b >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << k
        return same


class WaveletTree:
    """Order statistics of intervals of an array of numbers below its length."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8)).view("<u8")
            counts = np.bitwise_count(packed).astype(np.int32)
            self.words.append(packed)
            self.before.append(np.cumsum(counts, dtype=np.int32) - counts)
            values = np.concatenate([values[~one], values[one]])
            self.zeros.append(len(one) - int(counts.sum()))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a level."""
        word = at >> 6
        below = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(below).astype(np.int64)

    def smaller(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many numbers of each interval [low, high) are smaller than ``than``."""
        found = np.zeros(len(low), dtype=np.int64)
        whole = than >= 1 << self.bits
        found[whole] = (high - low)[whole]
        for level in range(self.bits):
            one = (than >> (self.bits - 1 - level) & 1).astype(bool)
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            zeros = (high - ones_high) - (low - ones_low)
            found += np.where(one & ~whole, zeros, 0)
            low = np.where(one, self.zeros[level] + ones_low, low - ones_low)
            high = np.where(one, self.zeros[level] + ones_high, high - ones_high)
        return found

    def smallest(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The ``nth`` smallest number, from 0, of each interval."""
        out = np.zeros(len(low), dtype=np.int64)
        for level in range(self.bits):
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            zeros = (high - ones_high) - (low - ones_low)
            one = nth >= zeros
            out = out << 1 | one
            nth = np.where(one, nth - zeros, nth)
            low = np.where(one, self.zeros[level] + ones_low, low - ones_low)
            high = np.where(one, self.zeros[level] + ones_high, high - ones_high)
        return out


def _candidates(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods to check, a constant number for each block."""
    # Blocks of one word: the window is the next word alone.
    single = np.flatnonzero(factors.ranks[0][1:] == factors.ranks[0][:-1])
    at, periods = [single], [np.ones(len(single), dtype=np.int64)]
    blocks = []
    for k in range(1, len(factors.ranks) - 1):
        p = np.arange(0, factors.n, 1 << k)
        p = p[factors.sizes[k][p] > 1]
        low = factors.ranks[k][p].astype(np.int64)
        blocks.append((p, np.full(len(p), 1 << k), low, low + factors.sizes[k][p]))
    if not sum(len(b[0]) for b in blocks):
        return single, periods[0]
    p, m, low, high = (np.concatenate(x) for x in zip(*blocks))
    tree = WaveletTree(factors.suffixes)
    # The successor of the window's begin is the number whose rank is what lies below it.
    before = tree.smaller(low, high, p + m)
    inside = tree.smaller(low, high, p + 2 * m) - before
    hit = inside > 0
    p, low, high, before, inside = p[hit], low[hit], high[hit], before[hit], inside[hit]
    first = tree.smallest(low, high, before)
    last = tree.smallest(low, high, before + inside - 1)
    at += [p, p]
    periods += [first - p, last - p]
    many = inside > 2
    p, a = p[many], first[many]
    d = tree.smallest(low[many], high[many], before[many] + 1) - a
    # A progression: the block has period d itself. A longer period moves the whole stretch of
    # period d, so it is the distance of its left ends, or of its right ends.
    lefts = [x - factors.behind(x - 1, x + d - 1) for x in (p, a)]
    rights = [x + factors.ahead(x, x + d) for x in (p, a)]
    for q in (lefts[1] - lefts[0], rights[1] - rights[0]):
        good = q > 0
        at.append(p[good])
        periods.append(q[good])
    return np.concatenate(at), np.concatenate(periods)


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    ``words`` are numbers from 0; texts may follow each other if a number of its own ends each,
    the last one too.
    """
    if min_times < 4:
        raise ValueError("runs of fewer than four periods are not searched")
    if not len(words):
        return np.empty((0, 3), dtype=np.int64)
    factors = Factors(words)
    p, q = _candidates(factors)
    start = p - factors.behind(p - 1, p + q - 1)
    length = p + q + factors.ahead(p, p + q) - start
    good = length >= np.maximum(min_length, min_times * q)
    rows = np.unique(np.stack([start[good], length[good], q[good]], axis=1), axis=0)
    # Of one stretch the smallest period counts; others are its multiples.
    smallest = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)]
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    min_length: int = MIN_LENGTH,
    min_times: int = MIN_TIMES,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """Rows (id, n_words, runs, collapsed), one per row of ``docs``.

    Words are what stands between ASCII white space, as written, numbered from 0. ``runs``
    holds (start, length, period) of each longest stretch of at least ``min_length`` words and
    ``min_times`` periods in which words a period apart are the same, by start and period; the
    period is the smallest. ``collapsed`` is the text without the words that any run holds after
    its first period, joined by one blank. All runs are found, whatever their period.

    Null and empty texts have no words, no runs and an empty text; repeated rows and repeated or
    null ids are searched row by row; other columns are ignored; an empty table gives no rows.
    Nothing is shuffled. Texts are searched whole: short ones together, up to ``chunk_words`` at a
    time, and one with more words by itself, with about 100 bytes a word (four more for each
    doubling of its longest repeat) in its task.
    """
    kind = docs.schema[id].dataType
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    arrow = pa.schema([("id", to_arrow_type(kind)), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def search(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        codes = _Codes()
        n = np.array([len(words) for words in texts], dtype=np.int64)
        begins = np.cumsum(n + 1) - (n + 1)
        flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
        # After each text a number of its own.
        whole = np.insert(flat, np.cumsum(n), len(codes) + np.arange(len(texts)))
        found = runs_of(whole, min_length, min_times)
        of = np.searchsorted(begins, found[:, 0], side="right") - 1
        offsets = np.searchsorted(of, np.arange(len(texts) + 1))
        change = np.zeros(len(whole) + 1, dtype=np.int64)
        np.add.at(change, found[:, 0] + found[:, 2], 1)
        np.add.at(change, found[:, 0] + found[:, 1], -1)
        kept = np.cumsum(change) == 0
        collapsed = []
        for i, words in enumerate(texts):
            if offsets[i] < offsets[i + 1]:
                words = [words[j] for j in np.flatnonzero(kept[begins[i] : begins[i] + n[i]])]
            collapsed.append(b" ".join(words))
        parts = [pa.array(found[:, 0] - begins[of]), pa.array(found[:, 1]), pa.array(found[:, 2])]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(run_type)))
        joined = pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)
        return pa.RecordBatch.from_arrays([pa.array(ids, arrow.field(0).type), pa.array(n), lists, joined], schema=arrow)

    def search_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for id_, value in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                words = (value.as_py() or b"").split()
                if ids and size + len(words) > chunk_words:
                    yield search(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(id_.as_py())
                texts.append(words)
                size += len(words) + 1
            if ids:
                yield search(ids, texts)

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kinds = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(search_batches, f"id {kind.simpleString()}, {kinds}").withColumnRenamed("id", id)
