"""Periodic runs of words, found by block convolution at dyadic scales.

A run of smallest period q is at least three periods and MIN_RUN words long.
So it holds a block of L words, aligned to L, that occurs again q words later,
for the L = 8, 16, 32 ... with L <= q < 2 L (L = 8 for every shorter period).
At each scale the blocks are compared with the words behind them: the sum of
squared differences of word numbers over the block is zero where it occurs
again. These sums come from one convolution per block, by a number-theoretic
transform in whole numbers. Every distance found is a seed, which is extended
word by word to the whole run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import WORD

# Words a run has at least, and the least number of its periods.
MIN_RUN, MIN_PERIODS = 24, 3
# The smallest block. A run of a period up to 15 holds one with its repetition.
BLOCK = 8
# A prime 15 * 2^27 + 1 and a number whose powers reach all others.
PRIME, GENERATOR = 2_013_265_921, 31
# Characters of text that a task works on at a time, and cells of a transform.
SLICE_CHARS, CELLS = 4_000_000, 1 << 20

FIELDS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@lru_cache(maxsize=64)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 to size / 2 of a root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(max(1, size // 2), dtype=np.uint64)
    filled = 1
    while filled < len(out):
        step = np.uint64(pow(root, filled, PRIME))
        out[filled : 2 * filled] = out[:filled][: len(out) - filled] * step % np.uint64(PRIME)
        filled *= 2
    return out


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row; sizes are powers of two.

    Halves are folded into sums and turned differences, whose places are
    interleaved, so that the result needs no reordering.
    """
    prime, (count, size) = np.uint64(PRIME), rows.shape
    half, stride = size // 2, 1
    while half:
        both = rows.reshape(count, 2, half, stride)
        low, high = both[:, 0], both[:, 1]
        turn = _powers(2 * half, inverse)[:half, None]
        out = np.empty((count, half, 2, stride), dtype=np.uint64)
        out[:, :, 0] = (low + high) % prime
        out[:, :, 1] = (low + prime - high) % prime * turn % prime
        rows, half, stride = out, half // 2, stride * 2
    rows = rows.reshape(count, size)
    return rows * np.uint64(pow(size, -1, PRIME)) % prime if inverse else rows


def mismatch_sums(blocks: np.ndarray, windows: np.ndarray, places: int) -> np.ndarray:
    """Sum of squared differences of each block at each place of its window.

    Whole numbers modulo PRIME: zero for every place without a mismatch.
    """
    prime, size = np.uint64(PRIME), 1 << int(windows.shape[1] - 1).bit_length()
    count, length = blocks.shape
    turned = np.zeros((count, size), dtype=np.uint64)
    turned[:, 0] = blocks[:, 0]
    turned[:, size - length + 1 :] = blocks[:, :0:-1]
    padded = np.zeros((count, size), dtype=np.uint64)
    padded[:, : windows.shape[1]] = windows
    products = transform(transform(turned) * transform(padded) % prime, inverse=True)[:, :places]
    squares = np.zeros((count, windows.shape[1] + 1), dtype=np.uint64)
    np.cumsum(windows * windows % prime, axis=1, out=squares[:, 1:])
    of_windows = squares[:, length : length + places] - squares[:, :places]
    of_blocks = (blocks * blocks % prime).sum(axis=1, dtype=np.uint64)[:, None]
    return (of_blocks + of_windows + 2 * (prime - products)) % prime


class Words:
    """Numbered words of several documents in one row, and where each recurs."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.size = codes, len(codes)
        order = np.argsort(codes, kind="stable")
        group = np.cumsum(np.concatenate(([0], codes[order][1:] != codes[order][:-1])))
        # A key is word group times ``span`` plus place; groups do not touch.
        self.span = 4 * (self.size + 1)
        self.keys = group * self.span + order
        self.base = np.empty(self.size, dtype=np.int64)
        self.base[order] = group * self.span

    def recurs(self, places: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the word of each place stands again ``low`` to ``high`` - 1 later."""
        wanted = self.base[places] + places + low
        at = np.searchsorted(self.keys, wanted)
        return (at < self.size) & (self.keys[np.minimum(at, self.size - 1)] < wanted + (high - low))

    def blocks(self, length: int, low: int, high: int) -> np.ndarray:
        """Starts of aligned blocks each word of which recurs in that distance.

        No other block occurs again there, so no other needs a convolution.
        """
        starts = np.arange(0, self.size - length - low + 1, length)
        done, step = 0, 1
        while done < length and len(starts):
            offsets = np.arange(done, min(length, done + step))
            starts = starts[self.recurs(starts[:, None] + offsets, low, high).all(axis=1)]
            done, step = done + step, step * 2
        return starts

    def seeds(self, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(distance, block start) of the repetitions, by distance and start."""
        starts, places = self.blocks(length, low, high), high - low
        width = places - 1 + length
        padded = np.concatenate((self.codes, np.zeros(low + width, dtype=np.int64))) % PRIME
        at_once, found = max(1, CELLS // (2 * width)), []
        for i in range(0, len(starts), at_once):
            some = starts[i : i + at_once, None]
            blocks = padded[some + np.arange(length)].astype(np.uint64)
            windows = padded[some + low + np.arange(width)].astype(np.uint64)
            row, place = np.nonzero(mismatch_sums(blocks, windows, places) == 0)
            found.append((place + low, some[row, 0]))
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        distance, start = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, distance))
        return distance[order], start[order]

    def equal_until(self, at: int, distance: int) -> int:
        """First place from ``at`` on whose word differs from that ``distance`` later."""
        end, step = self.size - distance, 64
        while at < end:
            stop = min(end, at + step)
            differ = self.codes[at:stop] != self.codes[at + distance : stop + distance]
            if differ.any():
                return at + int(differ.argmax())
            at, step = stop, step * 2
        return end

    def equal_from(self, at: int, distance: int) -> int:
        """First place of the equal stretch that ends right before ``at``."""
        step = 64
        while at > 0:
            start = max(0, at - step)
            differ = (self.codes[start:at] != self.codes[start + distance : at + distance])[::-1]
            if differ.any():
                return at - int(differ.argmax())
            at, step = start, step * 2
        return 0


class Found:
    """Runs so far, to tell which seeds lie in one of a shorter period."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []

    def inside(self, distance: np.ndarray, start: np.ndarray, length: int, periods: Callable[[int], bool]) -> np.ndarray:
        """Seeds whose block and repetition lie in one run of such a period."""
        runs = sorted((s, s + n) for s, n, p in self.runs if periods(p))
        if not runs:
            return np.zeros(len(start), dtype=bool)
        starts, ends = (np.array(x) for x in zip(*runs))
        furthest = np.maximum.accumulate(ends)
        at = np.searchsorted(starts, start, side="right") - 1
        return (at >= 0) & (furthest[np.maximum(at, 0)] >= start + distance + length)

    def extend(self, words: Words, distance: np.ndarray, start: np.ndarray, length: int) -> None:
        last, end = -1, -1
        for d, s in zip(distance.tolist(), start.tolist()):
            if d == last and s + length <= end:
                continue
            # The sums vanish modulo a prime; the words themselves decide.
            until = words.equal_until(s, d)
            if until - s < length:
                continue
            first = words.equal_from(s, d)
            last, end = d, until
            if until + d - first >= max(MIN_RUN, MIN_PERIODS * d):
                self.runs.append((first, until + d - first, d))


def find_runs(codes: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs, by start and period.

    ``codes`` may hold several documents that share no number; ``longest`` is
    the length of the longest one.

    A seed whose block and repetition lie in a run of a period that divides its
    distance leads to that run again and is left out. For blocks as long as
    that period, lying in the run is enough: two periods of so long a stretch
    have their common divisor as a period, which would be the run's own.
    """
    if longest < MIN_RUN:
        return []
    words, found = Words(codes), Found()
    distance, start = words.seeds(BLOCK, 1, 2 * BLOCK)
    for d in range(1, 2 * BLOCK):
        one = distance == d
        if one.any():
            skip = found.inside(distance[one], start[one], BLOCK, lambda p: p < d and d % p == 0)
            found.extend(words, distance[one][~skip], start[one][~skip], BLOCK)
    length = 2 * BLOCK
    while MIN_PERIODS * length <= longest:
        distance, start = words.seeds(length, length, 2 * length)
        skip = found.inside(distance, start, length, lambda p: p < length)
        found.extend(words, distance[~skip], start[~skip], length)
        length *= 2
    return sorted(found.runs, key=lambda run: (run[0], run[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without the repetitions: of each run its first period stays."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with at most SLICE_CHARS characters, or one longer row."""
    for batch in batches:
        first = chars = 0
        for i, text in enumerate(batch.column("text")):
            size = len(text.as_buffer()) if text.is_valid else 0
            if i > first and chars + size > SLICE_CHARS:
                yield batch.slice(first, i - first)
                first, chars = i, 0
            chars += size
        if batch.num_rows > first:
            yield batch.slice(first)


Rewrite = Callable[[int | None, int], "np.ndarray | None"]


def _search(keep: list[str], rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(WORD).findall
        for batch in _slices(batches):
            rows = [split(t.as_py() or "") for t in batch.column("text")]
            if rewrite:
                for i, (key, words) in enumerate(zip(batch.column("doc_id"), rows)):
                    order = rewrite(key.as_py(), len(words))
                    if order is not None:
                        rows[i] = list(map(words.__getitem__, order.tolist()))
            sizes = np.array([len(words) for words in rows], dtype=np.int64)
            ends = np.cumsum(sizes)
            numbered = pa.array([w for words in rows for w in words], pa.string()).dictionary_encode()
            codes = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # Numbers of different documents differ.
            codes += np.repeat(np.arange(len(rows)) * len(numbered.dictionary), sizes)
            runs: list[list] = [[] for _ in rows]
            for start, length, period in find_runs(codes, int(sizes.max(initial=0))):
                row = int(np.searchsorted(ends, start, side="right"))
                runs[row].append((start - int(ends[row] - sizes[row]), length, period))
            told = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
            texts = [collapsed(words, found) for words, found in zip(rows, runs)]
            columns = [pa.array(sizes), pa.array(told, RUN), pa.array(texts, pa.string())]
            names = ["n_words", "runs", "collapsed"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *names])

    return run


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, rewrite: Rewrite | None = None) -> DataFrame:
    """Rows (``keep`` columns, n_words, runs, collapsed) of all documents.

    ``runs`` lists every maximal stretch of words with smallest period q and at
    least max(24, 3 q) words, by start and period; ``collapsed`` is the text's
    words without those in a run behind its first q words, joined by blanks.
    ``rewrite`` may name, from doc_id and number of words, the words a document
    is taken to consist of, by their places.

    One pass without a shuffle; whole texts, any period. Null and empty texts
    have no words and no runs; repeated rows are searched as often as they
    occur; other columns are not read. A kept column named like one of the
    results is not possible.
    """
    keep = ["doc_id"] if keep is None else keep
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    rows = docs.select(*dict.fromkeys([*keep, *(["doc_id"] if rewrite else []), "text"]))
    return rows.mapInArrow(_search(keep, rewrite), f"{fields}{FIELDS}")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; ties: smallest start, period."""

    def better(best: Column, run: Column) -> Column:
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | ahead, run).otherwise(best)

    kind = "struct<start: bigint, length: bigint, period: bigint>"
    # Runs come by start and period, so of equal ones the first stays.
    return F.aggregate(runs, F.lit(None).cast(kind), better)


def run_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, digests of all runs and of the text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
