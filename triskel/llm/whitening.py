"""Whitening of embeddings from the exact characteristic polynomial of their scatter.

Entries are made whole numbers, so that the scatter matrix A = n * sum(x x') - S S' is
exact (A is n^2 times the covariance). Then:

1. Tasks add up sums and products of their rows exactly (limbs of 20 bits, so that floating
   products stay exact); Spark adds these partial sums. Nothing but d*d numbers leaves them.
2. The characteristic polynomial of A is found modulo many primes by Hessenberg reduction,
   primes dealt over tasks, and put together by Chinese remainders. For a scatter matrix the
   sum of its coefficients' sizes is at most prod(1 + A_jj), which tells the number of primes.
3. All roots are real. By Descartes' rule, which is exact for such polynomials, a shifted
   polynomial's sign changes count the roots above a point with their multiplicity. Bisection
   with this count isolates each root; signs of the polynomial then narrow it.
4. Null vectors of A - e*I come from inverse iteration in fixed-point numbers of some hundred
   bits, one task a root, so close roots still give vectors right to double precision.
5. One narrow pass projects the rows.

Components with the eigenvalue zero have no whitened value and are left out, so fewer than
asked for come back where the rank is lower (none for one vector or equal vectors). Roots
that agree to 2^-96 of the largest count as one with several components.

Defined results: null vectors and those that hold a null, NaN or infinite entry take no part, nor do
those with an entry too large for a long after scaling, nor those of another width than the
most frequent one (the greater of two as frequent); an empty table gives an empty table;
repeated rows count each; other columns are not passed on. The width is bounded by MAX_WIDTH,
as d*d numbers of A go to the driver and to each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triskel.session import materialise

SCALE = 64
OFFSET = 1_000_000
MAX_WIDTH = 512
LIMB = 20
ROWS = 4096  # products of two limbs added up: 2^(20 + 20 + 12) < 2^53
PACK = 40  # bits of each number that partial sums are sent in
EXTRA_BITS = 128  # of fixed-point numbers beyond those of A
ROOT_BITS = 96  # relative to the largest root
LARGEST = 2.0**62
PRIMES_A_TASK = 24
ROOTS_A_TASK = 8


# ---------------------------------------------------------------- rows


def _proper(vector: Column) -> Column:
    """Vectors that take part: no null, NaN, infinite or too large entry."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < LARGEST, F.lit(False)))  # NaN is above all
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def fit_list(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id, x`` (whole numbers, written) of the vectors that take part, and their width."""
    vector = F.col(vector_col)
    kept = rows.where(_proper(vector)).select(
        F.col(id_col).alias("id"),
        F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET).alias("x"),
    )
    kept = materialise(kept)
    widths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = widths[0]["d"] if widths else 0
    if width > MAX_WIDTH:
        raise ValueError(f"vectors have {width} entries, more than {MAX_WIDTH}")
    return kept.where(F.size("x") == width), width


def _block(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("x")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, width)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as limbs of 20 bits: y = sum of limb_k * 2^(20 k); the last one has the sign."""
    out = []
    while True:
        top = np.abs(y).max(initial=0) < 1 << LIMB
        out.append((y if top else y & ((1 << LIMB) - 1)).astype(np.float64))
        if top:
            return out
        y = y >> LIMB


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers, exact for any 64-bit entries."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for lo in range(0, len(y), ROWS):
        limbs = _limbs(y[lo : lo + ROWS])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def _packed(value: int) -> list[int]:
    """Signed pieces of 40 bits, so that sums of pieces stay in a long."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << PACK) - 1)))
        value >>= PACK
    return out


def exact_scatter(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, the sums S of x and A = n * sum(x x') - S S', all exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = _block(batch, width) - OFFSET
            n += len(y)
            small = int(np.abs(y).max(initial=0)) * len(y) < 1 << 62
            sums += (y.sum(axis=0).astype(object) if small else y.astype(object).sum(axis=0)) if len(y) else 0
            products += exact_products(y)
        rows = [(-1, -1, 0, n)] if n else []
        for i in range(width):
            rows += [(-1, i, k, v) for k, v in enumerate(_packed(int(sums[i])))]
            rows += [(i, j, k, v) for j in range(i, width) for k, v in enumerate(_packed(int(products[i, j])))]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "k", "v"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, k int, v bigint")
    n, sums, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for i, j, k, v in parts.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():  # d*d/2 numbers
        if i >= 0:
            products[i][j] += v << (PACK * k)
        elif j >= 0:
            sums[j] += v << (PACK * k)
        else:
            n = v
    scatter = [[n * products[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    return n, [s + n * OFFSET for s in sums], scatter


# ---------------------------------------------------------------- characteristic polynomial


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3,215,031,751."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(top: int, bits: int) -> list[int]:
    """Primes downwards from ``top`` whose product has more than ``bits`` bits."""
    out, have, p = [], 0.0, top - 1 + top % 2
    while have <= bits + 1:
        if _is_prime(p):
            out.append(p)
            have += math.log2(p)
        p -= 2
    return out


def polynomials_modulo(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (lowest first) of det(x I - matrix) modulo each prime below 2^31."""
    d, p = len(matrix), np.array(primes, np.int64)
    p1, p2 = p[:, None], p[:, None, None]
    flat = [v for row in matrix for v in row]
    h = np.array([[v % q for v in flat] for q in primes], np.int64).reshape(len(primes), d, d)
    every = np.arange(len(primes))

    def inverse(a: np.ndarray) -> np.ndarray:
        return np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(a, p, strict=True)], np.int64)

    # To Hessenberg form by similar matrices; each prime takes its own pivot.
    for m in range(1, d - 1):
        pivot = m + np.argmax(h[:, m:, m - 1] != 0, axis=1)
        rows = h[every, pivot].copy()
        h[every, pivot] = h[:, m]
        h[:, m] = rows
        columns = h[every, :, pivot].copy()
        h[every, :, pivot] = h[:, :, m]
        h[:, :, m] = columns
        u = h[:, m + 1 :, m - 1] * inverse(h[:, m, m - 1])[:, None] % p1
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m, None, :] % p2) % p2
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p2).sum(axis=2)) % p1

    polys = np.zeros((d + 1, len(primes), d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(1, d + 1):
        polys[k, :, 1:] = polys[k - 1, :, :-1]
        polys[k] = (polys[k] - h[:, k - 1, k - 1, None] * polys[k - 1]) % p1
        factor = np.ones(len(primes), np.int64)
        for i in range(1, k):
            factor = factor * h[:, k - i, k - i - 1] % p
            polys[k] = (polys[k] - (h[:, k - i - 1, k - 1] * factor % p)[:, None] * polys[k - i - 1]) % p1
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients (lowest first, the last is 1) of a scatter matrix."""
    bound = math.prod(1 + matrix[j][j] for j in range(len(matrix)))
    primes = primes_below((1 << 31) - 1, bound.bit_length())
    groups = [primes[lo : lo + PRIMES_A_TASK] for lo in range(0, len(primes), PRIMES_A_TASK)]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, primes array<bigint>")

    def run(frames):
        for frame in frames:
            for mine in frame["primes"]:
                mine = [int(q) for q in mine]
                found = polynomials_modulo(matrix, mine)
                yield _frame([(q, c.tolist()) for q, c in zip(mine, found, strict=True)], ["prime", "poly"])

    residues = rows.repartition(len(groups), "i").mapInPandas(run, "prime bigint, poly array<bigint>").collect()
    value, modulus = [0] * (len(matrix) + 1), 1
    for prime, poly in residues:  # one a prime, each of d + 1 numbers
        inverse = pow(modulus % prime, -1, prime)
        value = [v + modulus * ((c - v) * inverse % prime) for v, c in zip(value, poly, strict=True)]
        modulus *= prime
    return [v - modulus if v > modulus // 2 else v for v in value]


def _frame(rows: list[tuple], names: list[str]):
    import pandas as pd

    return pd.DataFrame(rows, columns=names)


# ---------------------------------------------------------------- roots


def roots_above(poly: list[int], point: int, bits: int) -> int:
    """Roots greater than point / 2^bits, with multiplicity; all roots must be real."""
    d = len(poly) - 1
    c = [v << (bits * (d - i)) for i, v in enumerate(poly)]  # roots times 2^bits
    for lo in range(d):
        for i in range(d - 1, lo - 1, -1):
            c[i] += point * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], point: int, bits: int) -> int:
    """Sign-true value of the polynomial at point / 2^bits."""
    total, power = 0, 1
    for c in reversed(poly):
        total = total * point + c * power
        power <<= bits
    return total


def real_roots(poly: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """The greatest roots above zero as (point, bits, multiplicity), falling.

    A root is point / 2^bits to a part of 2^-ROOT_BITS of the largest. As many as make
    ``wanted`` with their multiplicities, and the rest of the last one's.
    """
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    if len(poly) == 1:
        return []
    top = -poly[-2]  # the trace: no root is greater
    bits = max(0, ROOT_BITS - max(top.bit_length() - len(poly).bit_length(), 0))
    # In units of 2^-bits, so that all points are whole numbers.
    low, high = 0, (top << bits) + 1
    stack, out, have = [(low, high, len(poly) - 1, 0)], [], 0
    while stack and have < wanted:
        low, high, above_low, above_high = stack.pop()
        here = above_low - above_high
        if here == 0:
            continue
        if here == 1 and high - low > 1:
            # A simple root: the polynomial changes its sign in (low, high].
            right = _value(poly, high, bits)
            while right and high - low > 1:
                middle = (low + high) // 2
                at = _value(poly, middle, bits)
                if at == 0 or (at > 0) == (right > 0):
                    high, right = middle, at
                else:
                    low = middle
        if here == 1 or high - low <= 1:
            out.append((high, bits, here))
            have += here
            continue
        middle = (low + high) // 2
        between = roots_above(poly, middle, bits)
        stack += [(low, middle, above_low, between), (middle, high, between, above_high)]
    return out


# ---------------------------------------------------------------- null vectors


def null_space(matrix: list[list[int]], point: int, bits: int, count: int) -> np.ndarray:
    """``count`` orthonormal vectors of the eigenvalue point / 2^bits, as doubles.

    Inverse iteration on an elimination with partial pivots in fixed-point numbers.
    """
    d = len(matrix)
    work = bits + max(1, max(matrix[j][j] for j in range(d)).bit_length()) + EXTRA_BITS
    m = np.array([[v << work for v in row] for row in matrix], object)
    for j in range(d):
        m[j, j] -= point << (work - bits)
    order = np.arange(d)
    factors = np.zeros((d, d), object)
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if best != k:
            for a in (m, factors, order):
                a[[k, best]] = a[[best, k]]
        if m[k, k] == 0:
            m[k, k] = 1
        f = (m[k + 1 :, k] << work) // m[k, k]
        factors[k + 1 :, k] = f
        m[k + 1 :, k:] -= (f[:, None] * m[k, None, k:]) >> work

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(d):
            x[k + 1 :] -= (factors[k + 1 :, k] * x[k]) >> work
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << work) // m[k, k]
            x[:k] -= (m[:k, k] * x[k]) >> work
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        largest = max(abs(v) for v in x)
        shift = max(largest.bit_length() - 2 * work, 0)
        x = x >> shift
        return (x << work) // max(math.isqrt(int((x * x).sum())), 1)

    basis: list[np.ndarray] = []
    one = 1 << work
    for number in range(count):
        # Fixed starts of a plain congruence, so that no component is missed by chance.
        x = np.array([one * (1 + (i * 7919 + number * 104_729 + i * i * 31) % 997) // 997 for i in range(d)], object)
        for _ in range(3):
            x = unit(solve(unit(x)))
            for b in basis:
                x = x - ((b * ((x * b).sum() >> work)) >> work)
            x = unit(x)
        basis.append(x)
    out = np.array([[float(Fraction(int(v), one)) for v in x] for x in basis])
    for v in out:
        if v[np.argmax(np.abs(v))] < 0:
            v *= -1
    return out


def principal_components(spark: SparkSession, scatter: list[list[int]], n: int, wanted: int) -> list[tuple[float, float, list[float]]]:
    """``eigenvalue, share of the trace, unit vector`` of the covariance, falling."""
    trace = sum(scatter[j][j] for j in range(len(scatter)))
    if not trace:
        return []
    roots = real_roots(characteristic_polynomial(spark, scatter), wanted)
    kind = "g int, i int, point string, bits int, m int"
    rows = spark.createDataFrame([(i // ROOTS_A_TASK, i, str(p), b, m) for i, (p, b, m) in enumerate(roots)], kind)

    def run(frames):
        for frame in frames:
            for _, i, p, b, m in frame.itertuples(index=False):
                yield _frame([(i, v.tolist()) for v in null_space(scatter, int(p), int(b), int(m))], ["i", "v"])

    found = rows.repartition(-(-len(roots) // ROOTS_A_TASK), "g").mapInPandas(run, "i int, v array<double>").collect()
    out = []
    for i, vector in sorted(found, key=lambda r: r[0]):
        root = Fraction(roots[i][0], 1 << roots[i][1])
        out.append((float(root / (n * n)), float(root / trace), list(vector)))
    return out[:wanted]


# ---------------------------------------------------------------- whitened rows


def whiten(rows: DataFrame, id_col: str, vector_col: str, components: int = 32) -> DataFrame:
    """``id, n, deviation, whitened array, explained array, identity_error`` of every row that takes part.

    ``deviation`` is the exact sum of (n*x - S)^2, null where it does not fit a long.
    ``identity_error`` is measured on the rows' whitened values, centred by their own means.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    fit, width = fit_list(rows, id_col, vector_col)
    n, sums, scatter = exact_scatter(fit, width)
    found = principal_components(spark, scatter, n, components) if n else []
    k = len(found)
    turn = np.array([np.array(v) / math.sqrt(e) for e, _, v in found]).reshape(k, width).T
    shifted = [s - n * OFFSET for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(shifted, object)
        for batch in batches:
            y = _block(batch, width) - OFFSET
            bound = int(np.abs(y).max(initial=0)) * n + max(map(abs, shifted), default=0)
            if bound * bound * max(width, 1) < 1 << 62:
                t = y * n - whole.astype(np.int64)
                deviation = (t * t).sum(axis=1).tolist()
            else:
                t = y.astype(object) * n - whole
                deviation = [v if v < 1 << 63 else None for v in (t * t).sum(axis=1).tolist()]
            w = (t / n).astype(np.float64) @ turn
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(w.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviation, pa.int64()), values], ["id", "deviation", "whitened"])

    done = fit.mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")
    done = materialise(done)
    error = identity_error(done, k, n)
    shares = F.array(*[F.lit(s) for _, s, _ in found]) if k else F.array().cast("array<double>")
    return done.select("id", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(done: DataFrame, k: int, n: int) -> float:
    """Largest entry of the whitened values' covariance minus the identity."""
    if not k or not n:
        return 0.0

    def table(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)

    def emit(total: np.ndarray) -> pa.RecordBatch:
        flat = total.ravel()
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    def added(run) -> np.ndarray:
        parts = done.select("whitened").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(parts))
        for i, v in parts:
            out[i] = v
        return out

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += table(batch).sum(axis=0)
        yield emit(total)

    mean = added(first) / n

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = table(batch) - mean
            total += w.T @ w
        yield emit(total)

    return float(np.abs(added(second).reshape(k, k) / n - np.eye(k)).max())
