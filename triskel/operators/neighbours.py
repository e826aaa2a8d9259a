"""k nearest neighbours by cosine, majority vote, nearest centroid."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triskel.functions.vectors import unit
from triskel.operators.embeddings import mean_vector
from triskel.operators.tiles import (
    BLOCK_COLUMNS,
    BLOCK_ROWS,
    STRIP,
    TILE_ROWS,
    arrow_type,
    chunks,
    complete,
    key_type,
    matrix,
    rows_of,
    same_keys,
    single_error,
    sort_by,
    strip_scan,
    tile_cogroup,
    tile_count,
    values,
)
from triskel.session import local_table, materialise

KNN_KS = (5, 10, 20)
# Decimals kept of a similarity before ordering, so that rounding noise cannot
# reorder equal neighbours.
SIM_DECIMALS = 12
MAX_PIVOTS = 2048
# Added to distances: a similarity is right to 1e-12, a distance near zero to its root.
SLACK = 1e-5


def _first_columns(sim: np.ndarray, k: int) -> np.ndarray:
    """The k best columns of each row, best first. Columns are in key order, so ties go
    to the earlier one. Only columns that reach the k-th value are sorted."""
    if sim.shape[1] <= k:
        return np.argsort(-sim, axis=1, kind="stable")
    least = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
    above, level = sim > least, sim == least
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    chosen = np.nonzero(above | level)[1].reshape(len(sim), k)
    order = np.argsort(-np.take_along_axis(sim, chosen, axis=1), axis=1, kind="stable")
    return np.take_along_axis(chosen, order, axis=1)


def _merged(k: int, best: tuple[np.ndarray, np.ndarray] | None, sim: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row among those held and new ones; ties go to the lesser key."""
    if best is None:
        return sim, ids
    old_sim, old_ids = best
    better = np.ones(len(sim), bool) if old_sim.shape[1] < k else sim[:, 0] >= old_sim[:, -1]
    sims = np.concatenate([old_sim[better], sim[better]], axis=1)
    keys = np.concatenate([old_ids[better], ids[better]], axis=1)
    by_key = np.argsort(keys, axis=1, kind="stable")
    sims, keys = np.take_along_axis(sims, by_key, axis=1), np.take_along_axis(keys, by_key, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    sims, keys = np.take_along_axis(sims, order, axis=1), np.take_along_axis(keys, order, axis=1)
    if better.all():
        return sims, keys
    old_sim[better], old_ids[better] = sims, keys
    return old_sim, old_ids


def _topk_kernel(key: str, k: int, kind: pa.DataType):
    """The k nearest of each held row among a strip of tiles.

    Once a row has k neighbours it is looked at only in blocks with a similarity that reaches its
    k-th, by a product in single precision less the error of that; the rest costs this product
    and one comparison. Vectors have length one, or zero.
    """

    def run(_, held: pa.Table, streamed) -> Iterator[pa.Table]:
        q_ids, qm = values(held, key), matrix(held, "vec")
        parts = chunks(len(q_ids), BLOCK_ROWS)
        q_single, error = qm.astype(np.float32), single_error(qm.shape[1])
        best: list = [None] * len(parts)
        for _, table in streamed:
            c = sort_by(table, key)
            c_ids, cm = values(c, key), matrix(c, "vec")
            codes_q, codes_c = same_keys(q_ids, c_ids)
            shared, c_single = np.isin(codes_q, codes_c), cm.astype(np.float32)
            for (i, s), cols in itertools.product(enumerate(parts), chunks(len(c_ids), BLOCK_COLUMNS)):
                rows, found = slice(None), best[i]
                if found is not None and found[0].shape[1] == k:
                    least = (found[0][:, -1:] - error).astype(np.float32)
                    rows = np.flatnonzero((q_single[s] @ c_single[cols].T >= least).any(axis=1))
                    if not len(rows):
                        continue
                    found = found[0][rows], found[1][rows]
                sim = np.round(qm[s][rows] @ cm[cols].T, SIM_DECIMALS)
                own = np.flatnonzero(shared[s][rows])
                if len(own):  # a point is not its own neighbour
                    sim[own] = np.where(codes_q[s][rows][own, None] == codes_c[None, cols], -np.inf, sim[own])
                top = _first_columns(sim, k)
                found = _merged(k, found, np.take_along_axis(sim, top, axis=1), c_ids[cols][top])
                if isinstance(rows, slice):
                    best[i] = found
                else:
                    best[i][0][rows], best[i][1][rows] = found
        for (sims, ids), s in zip(best, parts, strict=True):
            keep = np.isfinite(sims).ravel()
            rows = np.repeat(q_ids[s], sims.shape[1])[keep]
            yield pa.table(
                {key: pa.array(rows, type=kind), "neighbour": pa.array(ids.ravel()[keep], type=kind), "sim": pa.array(sims.ravel()[keep])}
            )

    return run


def _every_pair(rows: DataFrame, tiles: int) -> tuple[DataFrame, DataFrame, int]:
    """Held and streamed rows of all tile pairs."""
    strips = -(-tiles // STRIP)
    held = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    streamed = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    number = F.floor(F.col("_tile") / STRIP).cast("int")
    return (
        held.withColumn("_task", F.col("_tile") * strips + F.col("_s")).drop("_s"),
        streamed.withColumn("_task", F.col("_q") * strips + number).drop("_q"),
        tiles * strips,
    )


def _cells(slim: DataFrame, key: str, count: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with the pivot they are nearest to and their distance (written), and the pivots.

    Pivots are the rows with the least hashes. Vectors have length one, or zero.
    """
    slim = complete(materialise(slim), "vec")
    pivots = np.array([r["vec"] for r in slim.orderBy(F.xxhash64(key), key).limit(count).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("vec"))
            near, least = [], []
            for s in chunks(len(x)):
                d = distances(x[s], pivots)
                near.append(d.argmin(axis=1).astype(np.int32))
                least.append(d.min(axis=1))
            columns = [*batch.columns, pa.array(np.concatenate(near)), pa.array(np.concatenate(least))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_cell", "_dist"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes)
    return materialise(slim.mapInArrow(run, f"{kinds}, _cell int, _dist double")), pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :]
    return np.sqrt(np.maximum(sq - 2.0 * (x @ pivots.T), 0.0))


def _reach_kernel(key: str, k: int, pivots: np.ndarray, radii: np.ndarray):
    """Cells that may hold one of the k nearest of any row of a tile.

    The k-th similarity s within the tile bounds the distance of a nearer point by
    sqrt(2 - 2s), as vectors are no longer than one. A point of cell j is at least d(q, p_j) - r_j
    away from q, and half of d(q, p_j) - d(q, p_i) for any pivot i, since p_j is its nearest.
    """

    def run(tile: int, held: pa.Table, streamed) -> Iterator[pa.Table]:
        x = matrix(held, "vec")
        for _ in streamed:  # none is sent
            pass
        codes, _ = same_keys(values(held, key), values(held, key)[:0])
        needed = np.zeros(len(pivots), bool)
        for s in chunks(len(x)):
            sim = np.where(codes[s, None] == codes[None, :], -np.inf, x[s] @ x.T)
            last = -np.partition(-sim, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(sim), -np.inf)
            reach = np.sqrt(np.maximum(2.0 - 2.0 * last, 0.0)) + SLACK
            d = distances(x[s], pivots)
            least = np.maximum(d - radii[None, :], (d - d.min(axis=1, keepdims=True)) / 2.0)
            needed |= (least <= reach[:, None]).any(axis=0)
        cells = np.flatnonzero(needed).astype(np.int32)
        yield pa.table({"_q": pa.array(np.full(len(cells), tile, np.int32)), "_cell": pa.array(cells)})

    return run


def pruned_pairs(slim: DataFrame, key: str, k: int, tiles: int, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their ``_tile``, the (``_q``, ``_tile``) pairs that may hold neighbours (both
    written), and the number of tiles.

    A cell of more than ``tile_rows`` rows is several tiles. Pivots, radii and tile numbers are
    one row a cell, at most MAX_PIVOTS.
    """
    rows, pivots = _cells(slim, key, min(tiles, MAX_PIVOTS))
    stats = {r["_cell"]: r for r in rows.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_dist").alias("r")).collect()}
    radii, first, total = np.full(len(pivots), -np.inf), [], 0
    for cell in sorted(stats):
        radii[cell] = stats[cell]["r"]
        parts = -(-stats[cell]["n"] // tile_rows)
        first.append((cell, total, parts))
        total += parts
    cells = local_table(slim.sparkSession, first, "_cell int, _first int, _parts int")
    part = F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")
    rows = rows.join(F.broadcast(cells), "_cell").withColumn("_tile", F.col("_first") + part).select(*slim.columns, "_tile")
    rows = materialise(rows)
    held = rows.withColumn("_task", F.col("_tile"))
    reach = strip_scan(held, held.limit(0), _reach_kernel(key, k, pivots, radii), "_q int, _cell int", total)
    tiles_of = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1))
    return rows, materialise(reach.join(F.broadcast(cells), "_cell").select("_q", tiles_of.alias("_tile"))), total


def _pruned_tasks(rows: DataFrame, pairs: DataFrame, tiles: int) -> tuple[DataFrame, DataFrame, int]:
    """Held and streamed rows of the given tile pairs."""
    strips = -(-tiles // STRIP)
    nth = F.row_number().over(Window.partitionBy("_q").orderBy("_tile")) - 1  # a row a tile
    dealt = pairs.withColumn("_task", F.col("_q") * strips + F.floor(nth / STRIP).cast("int"))
    dealt = materialise(dealt)
    held = rows.join(dealt.select(F.col("_q").alias("_tile"), "_task").distinct(), "_tile")
    return held, rows.join(dealt.select("_tile", "_task"), "_tile"), tiles * strips


def top_neighbours(
    points: DataFrame, key: str, k: int, vec: str = "vec", tiles: int | None = None, prune: bool | None = None
) -> DataFrame:
    """(key, neighbour, sim, position 1..k) by cosine similarity; the point itself is
    excluded by key.

    A held tile keeps the k best of a strip of tiles, so a query brings at most k rows a
    strip to the final ranking. Beyond one full tile of rows (or with ``prune``) tiles follow
    pivots, and pairs of tiles that the triangle inequality rules out are not shipped;
    the result is the same.
    """
    kind = key_type(points, key)
    slim = points.select(key, unit(F.col(vec)).alias("vec"))
    n = tile_count(points, tiles)
    if prune or (prune is None and not tiles and points.count() > TILE_ROWS):
        rows, pairs, total = pruned_pairs(slim, key, k, n)
        held, streamed, tasks = _pruned_tasks(rows, pairs, total)
    else:
        held, streamed, tasks = _every_pair(slim.withColumn("_tile", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n)
    partial = strip_scan(
        held, streamed, _topk_kernel(key, k, arrow_type(points, key)), f"{key} {kind}, neighbour {kind}, sim double", tasks, ["vec"]
    )
    order = Window.partitionBy(key).orderBy(F.desc("sim"), F.asc("neighbour"))
    ranked = partial.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k)


def vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str, ks: Sequence[int]) -> DataFrame:
    """(key, k, predicted): majority label of the first k neighbours; ties go to the
    label met first. ``labels`` is (key, label)."""
    known = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("_nl"))
    hits = neighbours.join(known, "neighbour").select(
        key,
        "position",
        "_nl",
        F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("position"))).alias("k"),
    )
    counts = hits.groupBy(key, "k", "_nl").agg(
        F.count(F.lit(1)).alias("_votes"), F.min("position").alias("_first")
    )
    return counts.groupBy(key, "k").agg(
        F.max_by("_nl", F.struct("_votes", -F.col("_first"))).alias("predicted")
    )


def knn_accuracy(
    points: DataFrame, key: str, label: str, ks: Sequence[int] = KNN_KS, tiles: int | None = None
) -> DataFrame:
    """(k, accuracy) over labelled points. k is capped at n-1 by itself, as there are
    no more neighbours; with a single point the accuracy is 0."""
    nearest = top_neighbours(points, key, max(ks), tiles=tiles)
    labels = points.select(key, label)
    predicted = vote(nearest, labels, key, label, ks)
    correct = predicted.join(labels, key).groupBy("k").agg(
        F.count_if(F.col("predicted") == F.col(label)).alias("_hits")
    )
    total = points.agg(F.count(F.lit(1))).scalar()
    return correct.select("k", (F.col("_hits") / total).alias("accuracy"))


def _nearest_kernel(key: str, centre: str, kind: pa.DataType, centre_kind: pa.DataType):
    def run(_, q: pa.Table, c: pa.Table) -> pa.Table:
        c = sort_by(c, centre)
        ids, centres = values(q, key), values(c, centre)
        qm, cm = matrix(q, "vec"), matrix(c, "vec")
        sq_c = np.einsum("ij,ij->i", cm, cm)
        found, dist = [], []
        for s in chunks(len(ids)):
            sq_q = np.einsum("ij,ij->i", qm[s], qm[s])
            d2 = np.round(sq_q[:, None] + sq_c[None, :] - 2.0 * (qm[s] @ cm.T), SIM_DECIMALS)
            at = d2.argmin(axis=1)
            found.append(centres[at])
            dist.append(d2[np.arange(len(at)), at])
        return pa.table(
            {
                key: pa.array(ids, type=kind),
                centre: pa.array(np.concatenate(found), type=centre_kind),
                "d2": pa.array(np.concatenate(dist)),
            }
        )

    return run


def assign_nearest(
    points: DataFrame, centroids: DataFrame, key: str, centre: str = "cluster", tiles: tuple[int, int] | None = None
) -> DataFrame:
    """(key, cluster, d2): nearest centroid, ties to the lowest cluster id. Centroids
    are tiled as well, so their number is not bound to one task's memory."""
    kind, centre_kind = key_type(points, key), key_type(centroids, centre)
    if tiles is None:
        tiles = (tile_count(points), max(1, -(-centroids.count() // TILE_ROWS)))
    partial = tile_cogroup(
        complete(points.select(key, "vec"), "vec"), complete(centroids.select(centre, "vec"), "vec"), key, centre, tiles,
        _nearest_kernel(key, centre, arrow_type(points, key), arrow_type(centroids, centre)),
        f"{key} {kind}, {centre} {centre_kind}, d2 double",
    )
    best = partial.groupBy(key).agg(F.min(F.struct("d2", centre)).alias("_b"))
    return best.select(key, F.col(f"_b.{centre}").alias(centre), F.col("_b.d2").alias("d2"))


def lloyd_step(points: DataFrame, centroids: DataFrame, key: str, centre: str = "cluster") -> DataFrame:
    """One k-means iteration: (cluster, vec) means of the assigned points."""
    assigned = assign_nearest(points, centroids, key, centre).drop("d2")
    return points.join(assigned, key).groupBy(centre).agg(mean_vector("vec"))
