"""Approximate nearest neighbours by multi-index hashing.

Vectors become 64-bit codes: principal directions of a bounded sample, turned by the
rotation that iterative quantisation learns. A code is cut to four substrings of 16 bits,
each with its own index. If two codes differ in at most r bits, one of their substrings
differs in at most r / 4, so probing each index with all values that near finds every code
within r. Those within r are ranked by the inner product of the original vectors in
double precision. The largest norm is appended as in the reduction of inner product to
angle, so that long vectors keep their advantage.

The radius is learned: it holds ``FOUND`` of the true neighbours within the sample, where
neighbours are farther off than among all rows, so recall on all rows is no smaller. A query
that finds too few within the radius is asked again with the radius that holds every code.

Every row is indexed. Rows are dealt to shards of about ``SHARD`` rows by a hash of their
id; the stated queries go to every shard and bring back at most k rows from each.

Defined results: vectors that are null, empty, zero, of another width than most or with a
component that is null or not finite take no part; rows that share the query's id are the
query's own; a query id that occurs several times is asked once, with its vector that
sorts first; ties go to the smaller id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triskel.session import materialise

BITS, PARTS = 64, 4
SAMPLE, SAMPLE_VALUES, ROUNDS, FOUND, SHARD = 8192, 1 << 22, 40, 0.97, 32768


@dataclass
class CodeModel:
    longest: float
    mean: np.ndarray
    rotation: np.ndarray  # (width + 1) x bits
    radius: int = BITS

    def codes(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        bits = (_lifted(vectors, self.longest, queries) - self.mean) @ self.rotation > 0
        padded = np.zeros((len(vectors), BITS), bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(-1)


def _lifted(vectors: np.ndarray, longest: float, queries: bool) -> np.ndarray:
    """Vectors of length one whose angle to a query ranks the inner product."""
    v = vectors.astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    if queries:
        return np.hstack([v / np.maximum(norm, 1e-300), np.zeros((len(v), 1))])
    v = v / longest
    return np.hstack([v, np.sqrt(np.maximum(0.0, 1.0 - (norm / longest) ** 2))])


def usable(vector: Column) -> Column:
    """Whether a vector takes part, apart from its width."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_codes(rows: DataFrame, k: int) -> CodeModel | None:
    """A model from about ``SAMPLE`` rows (fewer for wide vectors) of ``rows`` (id, vector)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, longest, width = rows.agg(F.count("*"), F.max(norm), F.max(F.size("vector"))).first()
    if not n:
        return None
    wanted = max(256, min(SAMPLE, SAMPLE_VALUES // width))
    drawn = rows if n <= wanted else rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(wanted / n * (1 << 30)))
    sample = np.array(drawn.select("vector").toPandas()["vector"].tolist(), np.float64).reshape(-1, width)
    if not len(sample):
        return CodeModel(longest, np.zeros(width + 1), np.zeros((width + 1, 1)))
    lifted = _lifted(sample, longest, False)
    mean = lifted.mean(axis=0)
    mean[-1] *= 0.5  # queries have nothing there
    centred = lifted - mean
    values, directions = np.linalg.eigh(centred.T @ centred)
    top = directions[:, np.argsort(-values)[: min(BITS, width)]]
    flat = centred @ top
    turn, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((top.shape[1],) * 2))
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(flat.T @ np.where(flat @ turn > 0, 1.0, -1.0))
        turn = u @ vt
    model = CodeModel(longest, mean, top @ turn)
    if len(sample) > k:
        asked = sample[: min(512, len(sample))]
        products = asked @ sample.T
        products[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        near = np.argpartition(-products, k - 1, axis=1)[:, :k]
        away = np.bitwise_count(model.codes(asked, True)[:, None] ^ model.codes(sample, False)[near])
        model.radius = int(np.quantile(away, FOUND, method="higher"))
    return model


@cache
def _masks(radius: int) -> np.ndarray:
    """All 16-bit values with at most ``radius`` bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


class MultiIndex:
    """The four indexes of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        parts = np.ascontiguousarray(codes).view("<u2").reshape(-1, PARTS)
        for i in range(PARTS):
            order = np.argsort(parts[:, i], kind="stable")
            starts = np.searchsorted(parts[order, i], np.arange((1 << 16) + 1))
            self.tables.append((order, starts))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits, in order."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        hit = np.zeros(len(self.codes), bool)
        masks = _masks(radius // PARTS)
        for i, (order, starts) in enumerate(self.tables):
            probe = masks ^ np.uint16((int(code) >> (16 * i)) & 0xFFFF)
            lo, size = starts[probe], starts[probe.astype(np.int64) + 1] - starts[probe]
            lo, size = lo[size > 0], size[size > 0]
            if len(lo):
                at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                hit[order[at]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _search(rows: DataFrame, queries: DataFrame, model: CodeModel, radius: int, k: int, kind: str) -> DataFrame:
    """query, id, score of the k nearest that each shard finds within the radius."""
    spark = rows.sparkSession
    shards = max(spark.sparkContext.defaultParallelism, -(-rows.count() // SHARD))
    shared = spark.sparkContext.broadcast(model)
    index = rows.select(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "vector")
    both = index.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: CodeModel = shared.value
        ids, vectors, built = [], [], None
        for batch in batches:
            asks = batch.column("asks").to_numpy()
            first = int(np.searchsorted(asks, 1))
            if first:
                own = batch.slice(0, first)
                ids.append(own.column("id").to_numpy())
                vectors.append(_matrix(own.column("vector")))
            if first == batch.num_rows or not ids:
                continue
            if built is None:
                all_ids, all_vectors = np.concatenate(ids), np.concatenate(vectors)
                built = MultiIndex(m.codes(all_vectors, False))
            own = batch.slice(first)
            wanted = _matrix(own.column("vector"))
            found: tuple[list, list, list] = ([], [], [])
            for query, vector, code in zip(own.column("id").to_pylist(), wanted.astype(np.float64), m.codes(wanted, True), strict=True):
                at = built.within(code, radius)
                at = at[all_ids[at] != query]
                # Row sums, not a matrix product: equal vectors get equal scores.
                score = (all_vectors[at].astype(np.float64) * vector).sum(axis=1)
                if len(at) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    keep = score >= least
                    at, score = at[keep], score[keep]
                order = np.lexsort((all_ids[at], -score))[:k]
                found[0].append(np.full(len(order), query))
                found[1].append(all_ids[at[order]])
                found[2].append(score[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], ["query", "id", "score"])

    return both.mapInArrow(run, f"query {kind}, id {kind}, score double")


def nearest(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), neighbour id and score of the k nearest rows of each query."""
    kind = "bigint"
    rows = df.select(F.col(id_col).cast(kind).alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    widths = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    rows = rows.where(F.size("vector") == (widths["w"] if widths else 0))
    queries = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    rows = rows.select("id", "vector")
    model = fit_codes(rows, k)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    if model is None:
        found = rows.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    else:
        found = materialise(merged(_search(rows, queries, model, model.radius, k, kind)))
        full = found.groupBy(F.col("query").alias("id")).count().where(F.col("count") >= k)
        short = materialise(queries.join(full, "id", "left_anti"))
        if not short.isEmpty():
            again = merged(_search(rows, short, model, BITS, k, kind))
            found = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(again)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
