"""SimHash and MinHash of a text, vectorised over Arrow batches.

Both need a cryptographic hash of every shingle or word. Hashing each
occurrence on the JVM took 40 times as long as this: here every distinct
shingle of a slice is hashed once and the votes are array sums. A row's
fingerprint needs no other row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.base import as_col

SHINGLE = 4
# MinHash layout and the prime of its permutations.
PERMUTATIONS = 128
PRIME = (1 << 31) - 1
# Characters worked on at a time, which bounds the memory of a slice.
SLICE_CHARS = 500_000
SHINGLES_AT_ONCE = 65_536
# Digests of shingles that are kept for the next slices of a batch, and slots for the shingles of a small alphabet.
DIGESTS_KEPT = 1 << 17
TABLE_SLOTS = 1 << 24
WORDS_AT_ONCE = 8_192


def permutation_params(n: int = PERMUTATIONS, seed: int = 1) -> list[tuple[int, int]]:
    """Coefficients of the MinHash permutations, drawn from a fixed seed."""
    rng = np.random.RandomState(seed)
    return [(int(rng.randint(1, PRIME)), int(rng.randint(0, PRIME))) for _ in range(n)]


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts that are not null; of a batch, only a slice becomes Python text."""
    held, size = [], 0
    for value in texts.drop_null():
        text = value.as_py()
        held.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _digest_bits(tokens: list[str], known: dict[str, bytes]) -> np.ndarray:
    """Last 64 bits of each token's MD5, one bit per column; ``known`` keeps some of them."""
    if len(known) >= DIGESTS_KEPT:
        known.clear()
    digests = []
    for token in tokens:
        digest = known.get(token)
        if digest is None:
            digest = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[8:]
            if len(known) < DIGESTS_KEPT:
                known[token] = digest
        digests.append(digest)
    return np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8), axis=1)


def _coded(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points as numbers from zero on, and how many there are."""
    present = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
    present[points] = True
    letters = np.flatnonzero(present)
    numbers = np.zeros(len(present), dtype=np.int64)
    numbers[letters] = np.arange(len(letters))
    return numbers[points], len(letters)


def _distinct(codes: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct shingle, and the number of the shingle at each place."""
    windows = max(len(codes) - SHINGLE + 1, 0)
    keys = np.zeros(windows, dtype=np.int64)
    for i in range(SHINGLE):
        keys = keys * letters + codes[i : i + windows]
    if letters**SHINGLE > TABLE_SLOTS:
        return np.unique(keys, return_index=True, return_inverse=True)[1:]
    # A small alphabet has few possible shingles: a slot for each is faster than a sort.
    places = np.arange(windows, dtype=np.int32)
    slots = np.empty(letters**SHINGLE, dtype=np.int32)
    slots[keys] = places
    first = np.flatnonzero(slots[keys] == places)
    slots[keys[first]] = places[: len(first)]
    return first, slots[keys]


def _votes(bits: np.ndarray) -> np.ndarray:
    """Sum of every column of zeros and ones; as many rows as a byte can count at a time."""
    whole = len(bits) // 255 * 255
    sums = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[whole:].sum(axis=0, dtype=np.uint8)


def _slice_simhash(texts: list[str], known: dict[str, bytes] | None = None) -> list[int]:
    known = {} if known is None else known
    whole = "".join(texts)
    codes, letters = _coded(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    wide = letters >= 1 << 15
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, index = _distinct(codes, letters) if not wide else (np.empty(0, dtype=np.int64), None)
    bits = _digest_bits([whole[i : i + SHINGLE] for i in first.tolist()], known) if len(first) else None
    values = []
    for n, text in enumerate(texts):
        count = max(len(text) - SHINGLE + 1, 1)
        ones = np.zeros(64, dtype=np.int64)
        # Votes are summed piece by piece, whatever the length of the text.
        for i in range(0, count, SHINGLES_AT_ONCE):
            end = min(i + SHINGLES_AT_ONCE, count)
            if len(text) < SHINGLE or wide:
                own = _digest_bits([text[j : j + SHINGLE] for j in range(i, end)], known)
            else:
                own = bits.take(index[starts[n] + i : starts[n] + end], axis=0)
            ones += _votes(own)
        packed = np.packbits(ones * 2 > count).tobytes()
        values.append(int.from_bytes(packed, "big", signed=True))
    return values


@F.arrow_udf(T.LongType())
def _simhash(texts: pa.Array) -> pa.Array:
    known: dict[str, bytes] = {}
    values = iter([v for part in _slices(texts) for v in _slice_simhash(part, known)])
    return pa.array([next(values) if present.as_py() else None for present in texts.is_valid()], pa.int64())


def simhash_of(text: Column | str) -> Column:
    """64-bit fingerprint over 4-character shingles of the word characters."""
    return _simhash(F.regexp_replace(F.lower(as_col(text)), r"[^\p{L}\p{N}_]+", ""))


_A, _B = (np.array(x, dtype=np.int64) for x in zip(*permutation_params()))


def _word_minhash(words: set[str]) -> np.ndarray:
    raw = b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:4] for w in words)
    hashes = np.frombuffer(raw, dtype=">u4").astype(np.int64) & PRIME
    least = np.full(PERMUTATIONS, PRIME, dtype=np.int64)
    for i in range(0, len(hashes), WORDS_AT_ONCE):
        part = hashes[i : i + WORDS_AT_ONCE]
        np.minimum(least, ((part[:, None] * _A + _B) % PRIME).min(axis=0), out=least)
    return least


@F.pandas_udf(T.ArrayType(T.LongType()))
def _minhash(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> np.ndarray | None:
        words = set(text.split()) if text is not None else None
        return _word_minhash(words) if words else None

    return texts.map(one)


def minhash_of(text: Column | str) -> Column:
    """128 minima over the lowered words; null for a text without words."""
    return _minhash(F.lower(as_col(text)))
