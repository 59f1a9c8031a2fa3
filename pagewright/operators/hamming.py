"""Close 64-bit fingerprints, compared block by block.

Within a wide distance most masks of bits are shared by most fingerprints, and
the close pairs are a fixed share of all pairs, so neither can be stored. Here
fingerprints are cut into chunks of bounded size and every two chunks meet in
one task, which holds just these and gives out sums, forests or nearest leaders.
What is sent grows with rows times chunks, never with pairs. Distances to a few
pivots rule out blocks that lie too far apart, by the triangle inequality.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.components import roots_of

# Fingerprints of one chunk at most; a task holds two chunks.
CHUNK_ROWS = 65_536
# Rows of a block, which is compared with another block at once.
BLOCK = 256
# Pivots, and fingerprints they are drawn from by hash; they decide what is
# skipped, never what is found.
PIVOTS, PIVOT_ROWS = 8, 1_000
# Pairs given out at once.
PAIRS_AT_ONCE = 100_000
# Links held before the groups of a cell are joined by them.
JOINS_AT_ONCE = 100_000


def choose_pivots(hashes: DataFrame) -> np.ndarray:
    """Fingerprints far from one another, out of a bounded sample."""
    drawn = hashes.select("simhash").where("simhash IS NOT NULL").orderBy(F.xxhash64("simhash")).limit(PIVOT_ROWS)
    sample = as_bits([r["simhash"] for r in drawn.collect()])
    found = sample[:1]
    while 0 < len(found) < min(PIVOTS, len(sample)):
        near = np.bitwise_count(sample[:, None] ^ found).min(axis=1)
        found = np.append(found, sample[near.argmax()])
    return found


def as_bits(hashes) -> np.ndarray:
    return np.asarray(hashes, dtype=np.int64).view(np.uint64)


class Side:
    """Fingerprints in the order of their nearest pivots, cut into blocks; or, if ``sort`` is off, as given."""

    def __init__(self, bits: np.ndarray, pivots: np.ndarray, sort: bool = True):
        away = np.bitwise_count(bits[:, None] ^ pivots)
        # Rows of this side, by their place in the given order.
        self.order = np.lexsort((away.min(axis=1), away.argmin(axis=1))) if sort else np.arange(len(bits))
        self.bits = bits[self.order]
        self.starts = np.arange(0, len(bits), BLOCK)
        away = away[self.order].astype(np.int16)
        self.low = np.minimum.reduceat(away, self.starts, axis=0)
        self.high = np.maximum.reduceat(away, self.starts, axis=0)


def close_blocks(a: Side, b: Side, distance: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start in a, start in b, distances) of all blocks that may hold close pairs.

    Where both sides are one, blocks come once, the earlier one first.
    """
    for i, start in enumerate(a.starts):
        gap = np.maximum(a.low[i] - b.high, b.low - a.high[i]).max(axis=1, initial=0)
        rows = a.bits[start : start + BLOCK, None]
        for j in np.flatnonzero(gap <= distance):
            if a is b and j < i:
                continue
            other = b.starts[j]
            yield start, other, np.bitwise_count(rows ^ b.bits[other : other + BLOCK])


def chunk_count(rows: int, cores: int) -> int:
    """Chunks of bounded size, enough of them to give all cores cells to work on."""
    spread = min(math.ceil(math.sqrt(8 * cores)), math.ceil(rows / (4 * BLOCK)))
    return max(1, spread, math.ceil(rows / CHUNK_ROWS))


def cells_of(hashes: DataFrame, chunks: int) -> DataFrame:
    """The columns of ``hashes``, chunk and cell, sorted by cell: every two chunks meet in one cell."""
    chunk = F.pmod(F.xxhash64("simhash"), F.lit(chunks)).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(chunks - 1)),
        lambda j: F.least(F.col("chunk"), j) * F.lit(chunks) + F.greatest(F.col("chunk"), j),
    )
    return (
        hashes.select("*", chunk.alias("chunk"))
        .select("*", F.explode(cells).alias("cell"))
        .repartition(chunks * (chunks + 1) // 2, "cell")
        .sortWithinPartitions("cell")
    )


def per_cell(work: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]):
    """Hand the rows of one cell after another to ``work``; rows come sorted by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            cell = batch["cell"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            for start, end in zip(edges[:-1], edges[1:]):
                if held and held[0]["cell"].iat[0] != cell[start]:
                    yield from work(pd.concat(held, ignore_index=True))
                    held = []
                held.append(batch.iloc[start:end])
        if held:
            yield from work(pd.concat(held, ignore_index=True))

    return run


def _sides(cell: pd.DataFrame, pivots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[Side]]:
    """Fingerprints of a cell, and the row numbers and the side of its one or two chunks."""
    hashes, chunk = cell["simhash"].to_numpy(), cell["chunk"].to_numpy()
    rows = [np.flatnonzero(chunk == c) for c in np.unique(chunk)]
    sides = [Side(as_bits(hashes[r]), pivots) for r in rows]
    return hashes, [r[s.order] for r, s in zip(rows, sides)], sides


def _cell_blocks(cell: pd.DataFrame, pivots: np.ndarray, chunks: int, distance: int):
    """(rows, rows, distances) of the close pairs, for one pair of blocks after another."""
    _, rows, sides = _sides(cell, pivots)
    i, j = divmod(int(cell["cell"].iat[0]), chunks)
    if len(sides) == 1 and i != j:
        return
    for start, other, far in close_blocks(sides[0], sides[-1], distance):
        met = far <= distance
        if i == j and start == other:
            met = np.triu(met, 1)
        x, y = np.divmod(np.flatnonzero(met), met.shape[1])
        if len(x):
            yield rows[0][start + x], rows[-1][other + y], far[x, y]


def _pair_rows(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b, far = (np.concatenate(part) for part in zip(*held))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": far.astype(np.int32)})


def pairs_in_cells(pivots: np.ndarray, chunks: int, distance: int, name: str = "simhash"):
    """Close pairs (a < b, distance), given out some at a time.

    ``a`` and ``b`` are the values of the column ``name``.
    """

    def work(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        names = cell[name].to_numpy()
        held, waiting = [], 0
        for left, right, far in _cell_blocks(cell, pivots, chunks, distance):
            held.append((names[left], names[right], far))
            waiting += len(far)
            if waiting >= PAIRS_AT_ONCE:
                yield _pair_rows(held)
                held, waiting = [], 0
        if held:
            yield _pair_rows(held)

    return per_cell(work)


def _joined(group: np.ndarray, joins: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if not joins:
        return group
    left, right = (np.concatenate(ends) for ends in zip(*joins))
    return roots_of(len(group), left, right, group)


def links_in_cells(pivots: np.ndarray, chunks: int, distance: int):
    """Per linked fingerprint of a cell: its links there and the least one it reaches there."""

    def work(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        hashes = cell["simhash"].to_numpy()
        links, group = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
        joins: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for left, right, _ in _cell_blocks(cell, pivots, chunks, distance):
            np.add.at(links, left, 1)
            np.add.at(links, right, 1)
            new = group[left] != group[right]
            joins.append((left[new], right[new]))
            waiting += np.count_nonzero(new)
            if waiting >= JOINS_AT_ONCE:
                group, joins, waiting = _joined(group, joins), [], 0
        group = _joined(group, joins)
        linked = np.flatnonzero(links)
        if len(linked):
            least = np.full(len(hashes), np.iinfo(np.int64).max)
            np.minimum.at(least, group[linked], hashes[linked])
            yield pd.DataFrame({"simhash": hashes[linked], "links": links[linked], "root": least[group[linked]]})

    return per_cell(work)


# --- first wins ------------------------------------------------------------------


def greedy(distance: int):
    """Rows of a block, sorted by ``ord``, that no kept row before them touches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        bits = as_bits(rows["simhash"])
        bands = rows["bands"].to_numpy() if "bands" in rows else None
        left, at, seen, kept = bits, np.arange(len(rows)), set(), []
        while len(left):
            own = bands[at[0]] if bands is not None else None
            if own is not None and not seen.isdisjoint(own):
                left, at = left[1:], at[1:]
                continue
            kept.append(at[0])
            if own is not None:
                seen.update(own)
            stay = np.bitwise_count(left ^ left[0]) > distance
            left, at = left[stay], at[stay]
        yield rows.iloc[kept]

    return run


def untouched(bits: np.ndarray, kept: np.ndarray, distance: int) -> np.ndarray:
    """True for fingerprints that are close to none of the kept ones."""
    open_, step = np.arange(len(bits)), 16 * BLOCK
    for start in range(0, len(kept), step):
        part, stay = kept[start : start + step], []
        for i in range(0, len(open_), BLOCK // 4):
            rows = open_[i : i + BLOCK // 4]
            stay.append(rows[np.bitwise_count(bits[rows, None] ^ part).min(axis=1) > distance])
        open_ = np.concatenate(stay) if stay else open_
    out = np.zeros(len(bits), dtype=bool)
    out[open_] = True
    return out


def drop_touched(kept: np.ndarray, bands: set | None, distance: int):
    """Rows that touch none of the kept ones: neither close nor with a band in common."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if bands and len(batch):
                batch = batch[[own is None or bands.isdisjoint(own) for own in batch["bands"]]]
            if len(batch):
                yield batch[untouched(as_bits(batch["simhash"]), kept, distance)]

    return run


# --- nearest leaders --------------------------------------------------------------


def leaders_in_cells(pivots: np.ndarray, distance: int):
    """(simhash, distance, cluster): the leaders of a cell that a fingerprint may join.

    A cell holds a chunk of rows (``place`` null) and a chunk of leaders, whose
    ``place`` is their position in the order of leaders. Given out are, among the
    leaders next to one pivot, those that are closer than all before them: a
    later one that is no closer is never joined. At each distance the earliest
    leader is among them unless an earlier one is closer still.
    """

    def work(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        is_row = cell["place"].isna().to_numpy()
        hashes = cell["simhash"].to_numpy()
        if is_row.all() or not is_row.any():
            return
        rows, bits = Side(as_bits(hashes[is_row]), pivots), as_bits(hashes[~is_row])
        place = cell["place"].to_numpy()[~is_row].astype(np.int64)
        next_to = np.bitwise_count(bits[:, None] ^ pivots).argmin(axis=1)
        none = np.iinfo(np.int64).max
        best = np.full(len(rows.bits) * (distance + 1), none)
        for pivot in np.unique(next_to):
            own = np.flatnonzero(next_to == pivot)
            own = own[place[own].argsort()]
            # Blocks of leaders come in their order, so the bound of a row only falls.
            bound = np.full(len(rows.bits), distance + 1, dtype=np.uint8)
            for start, other, far in close_blocks(rows, Side(bits[own], pivots, sort=False), distance):
                met = np.flatnonzero(far < bound[start : start + BLOCK, None])
                if len(met):
                    x, y = np.divmod(met, far.shape[1])
                    near = far[x, y]
                    np.minimum.at(best, (start + x) * (distance + 1) + near, place[own[other + y]])
                    np.minimum.at(bound, start + x, near)
        found = np.flatnonzero(best < none)
        x, d = np.divmod(found, distance + 1)
        yield pd.DataFrame({"simhash": hashes[is_row][rows.order][x], "distance": d.astype(np.int32), "cluster": best[found]})

    return per_cell(work)
