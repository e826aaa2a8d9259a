"""Connected components of links, as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.session import materialise

CHUNK = 1 << 19  # links a task contracts at a time


def _forest(edges: DataFrame) -> DataFrame:
    """Fewer links (x, y) with the same components: each task replaces its own by stars
    around their least nodes. A combine before the shuffle; the rest is done by joins."""
    kind = edges.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(n):
            top = n
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[n] != top:
                root[n], n = top, root[n]
            return top

        def flush() -> pa.RecordBatch:
            stars = [(find(n), n) for n in list(root)]
            stars = [s for s in stars if s[0] != s[1]]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], types[0]) for i in (0, 1)], ["x", "y"])

        held = 0
        for batch in batches:
            types = [batch.schema.field(0).type]
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
            held += batch.num_rows
            if held >= CHUNK:
                yield flush()
                held = 0
        if root:
            yield flush()

    return edges.select("x", "y").mapInArrow(run, f"x {kind}, y {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``class`` (least node of its component) of every node in ``links``.

    Each round joins a node to its first neighbour and contracts. The first two rounds
    order nodes by number, which settles stars around the least node at once; later ones
    by a hash of the round, so that the number of rounds is logarithmic whatever the
    numbering. A round's links and parents are written, which cuts the lineage; no node
    or link reaches the driver.
    """
    links = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = materialise(_forest(links))
    labels = edges.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("root", F.col("node"))
    number = 0
    while not edges.isEmpty():
        number += 1

        # The first neighbour, or the node itself if it comes before all of them.
        to = F.coalesce("to", "x")
        order = F.xxhash64(F.lit(number), to) if number > 2 else F.lit(0)
        ends = edges.select("x", F.col("y").alias("to")).union(edges.select("y", "x"))
        ends = ends.union(edges.select(F.explode(F.array("x", "y")), F.lit(None)))
        parent = ends.groupBy("x").agg(F.min(F.struct(order, to.alias("id"))).alias("n"))
        parent = materialise(parent.select("x", F.col("n.id").alias("p")))
        labels = labels.join(parent, labels["root"] == parent["x"], "left").select("node", F.coalesce("p", "root").alias("root"))
        left = parent.select("x", F.col("p").alias("px"))
        right = parent.select(F.col("x").alias("y"), F.col("p").alias("py"))
        moved = edges.join(left, "x").join(right, "y").select(F.col("px").alias("x"), F.col("py").alias("y")).where("x <> y")
        edges = materialise(_forest(moved))
        if number % 4 == 0:
            labels = materialise(labels)
    labels = materialise(labels)
    least = labels.groupBy("root").agg(F.min("node").alias("class"))
    return labels.join(least, "root").select("node", "class")
