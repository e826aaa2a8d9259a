"""k-means with a start that any engine can repeat.

Starting centres come from D-squared sampling as an exponential race: of all points the
next centre is the one with the least -ln(u) / D2, where u is the portable hash of (seed,
restart, step, key) and D2 the squared distance to the centres so far. That is a draw with
probabilities in proportion to D2, yet it hangs on no partition, order or generator.

All restarts share each pass over the points. A pass sums within tasks; one number a
(restart, cluster, dimension) leaves them. The centres are the model: restarts x clusters x
width numbers on the driver and in each task. A restart ends when a pass assigns every
point as the pass before did.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.operators.tiles import complete, rows_of
from triskel.session import local_table, materialise

RESTARTS = 10
MAX_ITERATIONS = 300
SAME_COST = 1e-9  # relative; restarts this close count as equal, and the first one wins


def _uniform(*parts) -> float:
    """Uniform in (0, 1), from the leading 32 bits of md5('a|b|c')."""
    digest = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return (int(digest[:8], 16) + 0.5) / 2.0**32


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the first of equals), and the squared distance to it."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for c, centre in enumerate(centres):
        d2 = ((x - centre) ** 2).sum(axis=1)
        nearer = d2 < best
        best[nearer], at[nearer] = d2[nearer], c
    return at, best


def starting_centres(points: DataFrame, clusters: int, restarts: int, seed: int) -> np.ndarray:
    """(restart, cluster, dimension) centres of ``points`` (key as text, vec): a pass a cluster.

    Where points run out because fewer are distinct than clusters are wanted, the least key is taken again.
    """
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    for step in range(clusters):
        so_far = [np.array(c) for c in chosen]

        def race(batches: Iterator[pa.RecordBatch], step=step, so_far=so_far) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                keys, x = batch.column("key").to_pylist(), rows_of(batch.column("vec"))
                for r, centres in enumerate(so_far):
                    d2 = _nearest(x, centres)[1] if len(centres) else np.ones(len(x))
                    for key, d, v in zip(keys, d2.tolist(), x, strict=True):
                        time = -np.log(_uniform(seed, r, step, key)) / d if d > 0 else np.inf
                        if r not in best or (time, key) < best[r][:2]:
                            best[r] = (time, key, v)
            if best:
                rows = [(r, t, k, v.tolist()) for r, (t, k, v) in best.items()]
                kinds = (pa.int32(), pa.float64(), pa.string(), pa.list_(pa.float64()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["r", "time", "key", "vec"])

        ran = points.mapInArrow(race, "r int, time double, key string, vec array<double>")
        first = ran.groupBy("r").agg(F.min(F.struct("time", "key", "vec")).alias("first"))
        for r, winner in first.collect():  # one row a restart
            chosen[r].append(np.array(winner["vec"]))
    return np.array(chosen)


def _pass(points: DataFrame, now: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums, costs and changed assignments of some restarts under centres ``now``."""
    restarts, clusters, width = now.shape
    cells = restarts * clusters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((restarts, clusters)), np.zeros((restarts, clusters, width))
        costs, changed = np.zeros(restarts), np.zeros(restarts)
        for batch in batches:
            x = rows_of(batch.column("vec"))
            for r in range(restarts):
                at, d2 = _nearest(x, now[r])
                member = np.zeros((len(x), clusters))
                member[np.arange(len(x)), at] = 1.0
                counts[r] += member.sum(axis=0)
                sums[r] += member.T @ x
                costs[r] += d2.sum()
                changed[r] += len(x) if before is None else (at != _nearest(x, before[r])[0]).sum()
        flat = np.concatenate([counts.ravel(), sums.ravel(), costs, changed])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["slot", "value"])

    total = np.zeros(cells * (width + 1) + 2 * restarts)
    for slot, value in points.mapInArrow(run, "slot bigint, value double").groupBy("slot").agg(F.sum("value")).collect():
        total[slot] = value
    counts, sums, costs, changed = np.split(total, [cells, cells * (width + 1), cells * (width + 1) + restarts])
    return counts.reshape(restarts, clusters, 1), sums.reshape(now.shape), costs, changed


def kmeans_assign(
    points: DataFrame, key: str, clusters: int, restarts: int = RESTARTS, seed: int = 42, iterations: int = MAX_ITERATIONS
) -> DataFrame:
    """(key, cluster) of the cheapest of several seeded k-means runs.

    ``iterations`` bounds each run. An empty cluster keeps its centre. Clusters are numbered by
    their least keys from 0, so equal partitions have equal numbers. No point gives no row.
    """
    kept = complete(materialise(points.select(key, F.transform("vec", lambda v: v.cast("double")).alias("vec"))), "vec")
    rows = kept.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "vec")
    if rows.isEmpty():
        return kept.select(key, F.lit(0).cast("bigint").alias("cluster"))
    centres, before = starting_centres(rows, clusters, restarts, seed), None
    costs, active = np.full(restarts, np.inf), np.arange(restarts)
    for _ in range(iterations):
        counts, sums, cost, changed = _pass(rows.select("vec"), centres[active], before)
        costs[active] = cost
        going = changed > 0
        before = centres[active][going]
        moved = np.where(counts > 0, sums / np.maximum(counts, 1.0), centres[active])
        active = active[going]
        centres[active] = moved[going]
        if not len(active):
            break
    best = int(np.flatnonzero(costs <= costs.min() * (1 + SAME_COST))[0])
    assigned = materialise(_assigned(kept, key, centres[best]))
    least = assigned.groupBy("_at").agg(F.min(key).alias("first")).collect()  # one row a cluster
    order = sorted(least, key=lambda r: (r["first"] is not None, r["first"]))
    numbers = local_table(kept.sparkSession, [(r["_at"], i) for i, r in enumerate(order)], "_at bigint, cluster bigint")
    return assigned.join(F.broadcast(numbers), "_at").select(key, "cluster")


def _assigned(points: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = _nearest(rows_of(batch.column("vec")), centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], [key, "_at"])

    return points.mapInArrow(run, f"`{key}` {dict(points.dtypes)[key]}, _at bigint")
