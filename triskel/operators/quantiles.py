"""Exact per-feature order statistics by radix selection.

``percentile`` keeps every distinct value of a group in a single aggregation buffer. Here
a double's 64 bits are made a whole number of the same order, and the wanted ranks are
followed down its digits: one pass over the table counts the next 13 bits of the values
that share the digits found so far, for all features and ranks at once. Five passes find
any rank whatever the values. A rank is settled as soon as one value has its digits, and
where few values are left, one pass fetches them instead.

Tasks count into arrays (at most GROUP features a pass), Spark adds the counts up, and only one row
a wanted rank reaches the driver. This is a fit: it runs jobs and keeps a few numbers
per feature on the driver. A feature is a column of the wide table, so their number is the
schema's width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triskel.session import local_table

BITS = 13  # of a pass: 192 kB of counts and bounds for each feature and prefix
GROUP = 64  # features of a pass, six prefixes each
FETCHED = 1 << 16  # values that are fetched to end the search
# Columns that share one aggregate; more would make its generated code too long.
COLUMNS = 24


class Profile(NamedTuple):
    """What one pass over a feature yields."""

    rows: int
    present: int
    mean: float | None
    sd: float | None
    variance: float | None

    @property
    def gaps(self) -> int:
        return self.rows - self.present


def _aggregate(df: DataFrame, columns: Mapping[tuple, Column], at_once: int) -> dict[tuple, object]:
    """Values of many aggregates over ``df``, a bounded number of them in a job."""
    keys, out = list(columns), {}
    for lo in range(0, len(keys), at_once):
        part = keys[lo : lo + at_once]
        row = df.agg(*[columns[k].alias(f"_{i}") for i, k in enumerate(part)]).first()
        out.update(zip(part, row, strict=True))
    return out


def profile(df: DataFrame, features: Sequence[str]) -> dict[str, Profile]:
    """feature -> counts and moments."""
    wanted: dict[tuple, Column] = {}
    for f in features:
        v = F.col(f).cast("double")
        wanted |= {(f, "rows"): F.count(F.lit(1)), (f, "present"): F.count(v), (f, "mean"): F.avg(v)}
        wanted |= {(f, "sd"): F.stddev_samp(v), (f, "variance"): F.var_pop(v)}
    got = _aggregate(df, wanted, 5 * COLUMNS)
    return {f: Profile(*[got[f, name] for name in Profile._fields]) for f in features if got[f, "rows"]}


def ordered_image(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles: zeros are equal, NaN is the greatest."""
    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def value_of_image(image: int) -> float:
    bits = image - (1 << 63) if image >> 63 else image ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


class _Prefix(NamedTuple):
    """Values of a feature whose image begins with ``digits``."""

    feature: str
    digits: int


def _images(df: DataFrame, prefixes: Sequence[_Prefix], known: int):
    """The table's columns in use, and a task's iterator over (prefix numbers, distinct images
    in order, counts) per batch and column."""
    features = list(dict.fromkeys(p.feature for p in prefixes))
    mine = []
    for f in features:
        own = sorted((p.digits, i) for i, p in enumerate(prefixes) if p.feature == f)
        mine.append((np.array([d for d, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for column, (digits, numbers) in zip(batch.columns, mine, strict=True):
                image, n = np.unique(ordered_image(column.drop_null().to_numpy(zero_copy_only=False)), return_counts=True)
                if not known:  # nothing to shift out: all values begin alike
                    yield np.full(len(image), numbers[0]), image, n
                    continue
                top = image >> np.uint64(64 - known)
                at = np.minimum(np.searchsorted(digits, top), len(digits) - 1)
                hit = digits[at] == top
                yield numbers[at[hit]], image[hit], n[hit]

    return df.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)]), each


class _Step(NamedTuple):
    """The next digits of a rank: values below them, with them, and the least and greatest of these."""

    digit: int
    below: int
    n: int
    least: int
    greatest: int


def _next_digits(df: DataFrame, prefixes: Sequence[_Prefix], known: int, ranks: Sequence[tuple[int, int]]) -> dict[tuple[int, int], _Step]:
    """(prefix number, rank inside) -> its next digits; one pass."""
    bits = min(BITS, 64 - known)
    table, each = _images(df, prefixes, known)
    size = len(prefixes) << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        least, greatest = np.full(size, (1 << 64) - 1, np.uint64), np.zeros(size, np.uint64)
        for number, image, n in each(batches):
            if not len(number):
                continue
            digit = (image >> np.uint64(64 - known - bits)) & np.uint64((1 << bits) - 1)
            cell = (number << bits) + digit.astype(np.int64)
            first = np.flatnonzero(np.diff(cell, prepend=-1))  # cells are runs, as images are in order
            last = np.append(first[1:], len(cell)) - 1
            cell = cell[first]
            counts[cell] += np.add.reduceat(n, first)
            least[cell] = np.minimum(least[cell], image[first])
            greatest[cell] = np.maximum(greatest[cell], image[last])
        at = np.flatnonzero(counts)
        columns = [(at >> bits).astype(np.int32), (at & ((1 << bits) - 1)).astype(np.int32), counts[at]]
        # As signed numbers of the same order, since Spark has no others.
        columns += [(bound[at] ^ np.uint64(1 << 63)).view(np.int64) for bound in (least, greatest)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "digit", "n", "least", "greatest"])

    found = table.mapInArrow(count, "i int, digit int, n bigint, least bigint, greatest bigint")
    found = found.groupBy("i", "digit").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    running = Window.partitionBy("i").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 8,192 rows at most
    ladder = found.withColumn("upto", F.sum("n").over(running))
    wanted = local_table(df.sparkSession, sorted(set(ranks)), "i int, rank bigint")
    steps = ladder.join(F.broadcast(wanted), "i").where("upto > rank AND upto - n <= rank")  # one row a rank
    half = 1 << 63
    return {
        (r["i"], r["rank"]): _Step(r["digit"], r["upto"] - r["n"], r["n"], r["least"] + half, r["greatest"] + half) for r in steps.collect()
    }


def _fetched(df: DataFrame, prefixes: Sequence[_Prefix], known: int) -> dict[int, list[tuple[int, int]]]:
    """Prefix number -> (image, count) in order; for few values in all."""
    table, each = _images(df, prefixes, known)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, image, n in each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(image.view(np.int64)), pa.array(n)], ["i", "image", "n"])

    out: dict[int, list[tuple[int, int]]] = {}
    images = table.mapInArrow(fetch, "i int, image bigint, n bigint").groupBy("i", "image").agg(F.sum("n").alias("n"))
    for i, image, n in images.collect():
        out.setdefault(i, []).append((image % (1 << 64), n))
    return {i: sorted(found) for i, found in out.items()}


def order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]], fetched: int = FETCHED) -> dict[tuple[str, int], float]:
    """(feature, rank) -> value for 0-based ranks among the feature's present values.

    At most five passes over ``df`` for every ``GROUP`` features.
    """
    out: dict[tuple[str, int], float] = {}
    features = [f for f in ranks if ranks[f]]
    for lo in range(0, len(features), GROUP):
        # Each wanted rank with its prefix and its rank among the values that have it.
        open_ = {(f, p): (_Prefix(f, 0), p) for f in features[lo : lo + GROUP] for p in set(ranks[f])}
        known, left = 0, None
        while open_ and (left is None or left > fetched):
            prefixes = sorted({prefix for prefix, _ in open_.values()})
            number = {prefix: i for i, prefix in enumerate(prefixes)}
            steps = _next_digits(df, prefixes, known, [(number[prefix], p) for prefix, p in open_.values()])
            bits, sizes = min(BITS, 64 - known), {}
            for key, (prefix, p) in list(open_.items()):
                step = steps[number[prefix], p]
                if step.least == step.greatest:  # sure when all 64 bits are known
                    out[key] = value_of_image(step.least)
                    del open_[key]
                    continue
                inner = _Prefix(prefix.feature, (prefix.digits << bits) + step.digit)
                open_[key], sizes[inner] = (inner, p - step.below), step.n
            known, left = known + bits, sum(sizes.values())
        prefixes = sorted({prefix for prefix, _ in open_.values()})
        values = _fetched(df, prefixes, known) if prefixes else {}
        for key, (prefix, p) in open_.items():
            for image, n in values[prefixes.index(prefix)]:
                if p < n:
                    out[key] = value_of_image(image)
                    break
                p -= n
    return out


def _between(at: float, value_at) -> float:
    """Linear interpolation between the two ranks around ``at``."""
    low = math.floor(at)
    a, b = value_at(low), value_at(math.ceil(at))
    return a + (b - a) * (at - low)


def filled_quartiles(
    df: DataFrame, features: Sequence[str], profiles: Mapping[str, Profile] | None = None
) -> dict[str, tuple[float, float, float]]:
    """feature -> (median, p25, p75), the quartiles taken after missing values have
    been replaced by the median; NULLs are the missing values.

    The copies of the median slot in between the two halves of the sorted values,
    so ranks in the filled column follow from the counts alone and one selection
    serves all three.
    """
    stats = {f: p for f, p in (profiles or profile(df, features)).items() if p.present}
    if not stats:
        return {}

    def present_rank(p: Profile, rank: int) -> int | None:
        """Rank among the present values, or None for a filled-in copy."""
        half = p.present // 2
        if rank < half:
            return rank
        return None if rank < half + p.gaps else rank - p.gaps

    wanted: dict[str, list[int]] = {}
    for feature, p in stats.items():
        middle = (p.present - 1) * 0.5
        ranks = [math.floor(middle), math.ceil(middle)]
        for q in (0.25, 0.75):
            at = (p.rows - 1) * q
            ranks += [present_rank(p, math.floor(at)), present_rank(p, math.ceil(at))]
        wanted[feature] = [r for r in ranks if r is not None]
    values = order_statistics(df, wanted)

    out = {}
    for feature, p in stats.items():
        median = _between((p.present - 1) * 0.5, lambda r, f=feature: values[f, r])

        def filled(rank: int, f=feature, p=p, m=median) -> float:
            present = present_rank(p, rank)
            return m if present is None else values[f, present]

        low, high = (_between((p.rows - 1) * q, filled) for q in (0.25, 0.75))
        out[feature] = (median, low, high)
    return out
