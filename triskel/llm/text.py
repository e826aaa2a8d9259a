"""Array views of text for work inside tasks: code points, runs of one class, hashes.

A task sees Arrow batches. ``slices`` cuts each into pieces of about half a megabyte
(one longer text is a piece by itself), so that a worker's memory follows the longest
single text and not the batch. All functions work on whole texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
RUN_BLOCK, LONG_RUN = 1 << 15, 1 << 10
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_MULTIPLIER = 0x9E3779B97F4A7C15


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of ``batch`` that hold about ``limit`` bytes of ``column`` each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64) + 16) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; a null text is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and the bounds of each text in them."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


@cache
def classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        major = unicodedata.category(c)[0]
        if major == "L":
            kinds[code] = LETTER
        elif major == "N":
            kinds[code] = NUMBER
        elif c.isspace() and code not in (0x1C, 0x1D, 0x1E, 0x1F):
            kinds[code] = SPACE
    return kinds


@cache
def word_characters() -> np.ndarray:
    """Whether a code point belongs to a word: letters, numbers and combining marks."""
    kinds = classes()
    words = (kinds == LETTER) | (kinds == NUMBER)
    for code in np.flatnonzero(kinds == OTHER):
        words[code] = unicodedata.category(chr(code))[0] == "M"
    return words


def true_runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none across the bound of two texts."""
    change = np.empty(len(mask) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(mask[1:], mask[:-1], out=change[1:-1])
    change[bounds] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    kept = mask[starts] if len(mask) else np.zeros(0, bool)
    return starts[kept], ends[kept]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _powers(base: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, one for each place of a block and a run that leaves it."""
    out = np.full(RUN_BLOCK + LONG_RUN, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each run: their polynomial in the multiplier.

    It is a difference of running sums over a block, moved to the run's start. ``starts``
    ascend.
    """
    out = np.zeros(len(starts), np.uint64)
    powers, inverse = _powers(_MULTIPLIER), _powers(pow(_MULTIPLIER, -1, 1 << 64))
    long = ends - starts > LONG_RUN
    stops = np.where(long, starts, ends)
    cuts = np.searchsorted(starts, np.arange(0, len(codes) + RUN_BLOCK, RUN_BLOCK))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo == hi:
            continue
        first, last = starts[lo], stops[hi - 1]
        sums = np.zeros(last - first + 1, np.uint64)
        chars = codes[first:last].astype(np.uint64)
        chars += np.uint64(1)
        chars *= powers[: last - first]
        np.cumsum(chars, out=sums[1:])
        s, e = starts[lo:hi] - first, stops[lo:hi] - first
        out[lo:hi] = (sums[e] - sums[s]) * inverse[s]
    for i in np.flatnonzero(long):
        chars = codes[starts[i] : ends[i]] + np.uint64(1)
        inside = np.arange(len(chars))
        # The block number of a very long run keeps its terms apart.
        out[i] = (chars * (powers[inside % LONG_RUN] + (inside // LONG_RUN).astype(np.uint64))).sum()
    return mix(out)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-case word, and the bounds of each text among the words.

    A word is a longest run of letters, numbers and combining marks.
    """
    codes, bounds = code_points([t.lower() for t in texts])
    starts, ends = true_runs(word_characters()[codes], bounds)
    return run_hashes(codes, starts, ends), np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words, and the number of the text it lies in.

    A text of fewer words, but at least one, is one shingle of all its words.
    """
    counts = np.diff(bounds)
    per_text = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), per_text)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = bounds[owner] + inside
    out = np.full(len(owner), n, np.uint64)
    for k in range(n):
        there = k < counts[owner]
        word = hashes[np.where(there, at + k, at)] if len(hashes) else np.zeros(0, np.uint64)
        out = mix(out * np.uint64(_MULTIPLIER) + np.where(there, word, np.uint64(k)))
    return out, owner
