"""Near duplicates by BagMinHash.

A text is the multiset of its five-word shingles. Each element and each interval of its
weight (one cell to 1, then doubling: 1-2, 2-4, 4-8, ...) has a Poisson process of points
with a component, seeded by the element and interval alone. A point in the
interval the weight ends in is halved down the hierarchy (bit by bit of its cell) to see
whether it lies below the weight. The signature holds for each component the earliest
point of all elements, so that two texts agree in a component with a probability of
exactly their weighted Jaccard similarity. Points later than a bound that fills all
components are never drawn: about m (ln m + 3) points a text and one try an element.

Equal multisets are one node first. Nodes that share a band meet in buckets; pairs are
verified by their true multiset overlap. A bucket is never expanded to all its pairs: its
first member is compared with the others, and only buckets that still hold several
classes go on, their next members (64, then 64 times as many) against the others,
until each is one class or has no member left that was not compared. That loses no link
of a bucket, and only links become rows.

Defined results: texts that are equal are in one class, those without a word too; texts
of fewer than five words are one shingle; a null text is empty; rows that share an id are
one document; an empty table gives no row; only the named columns are read. The class is
named by its least id. A null id has no class and is left out of comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triskel.llm.graph import components
from triskel.llm.text import mix, shingles, slices, texts_of, words
from triskel.session import materialise

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
LEADERS, BLOCK = 64, 1024
KNOWN = 500_000  # distinct shingles a worker keeps for further pairs
PART_BYTES = 1 << 18  # of text that is signed at a time
BROADCAST_IDS = 2_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def multisets(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, their counts and the text they are of."""
    keys, owner = shingles(*words(texts), n)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        keys[a:b].sort()
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return keys[at], np.diff(at, append=len(keys)), owner[at]


def bag_minhash(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures, (n_texts, m); rows of texts without an element are zero."""
    out = np.zeros((n_texts, m), np.uint64)
    total = np.bincount(owner, weights, n_texts)
    bound = np.full(n_texts, np.inf)
    bound[total > 0] = (log(m) + 3.0) / total[total > 0]
    # One process for each element and interval of its weight.
    process, width, inside = [np.arange(len(keys))], [np.ones(len(keys), np.int64)], [np.ones(len(keys), np.int64)]
    seed = [mix(keys + _A)]
    low = 1
    while len(more := np.flatnonzero(weights > low)):
        process.append(more)
        width.append(np.full(len(more), low))
        inside.append(np.minimum(weights[more] - low, low))
        seed.append(mix(keys[more] + np.uint64((low + 1) * int(_A) % (1 << 64))))
        low *= 2
    process, width, inside, seed = (np.concatenate(x) for x in (process, width, inside, seed))
    text = owner[process]
    todo = np.flatnonzero(total > 0)
    while len(todo):
        wanted = np.zeros(n_texts, bool)
        wanted[todo] = True
        own = np.flatnonzero(wanted[text])
        least = np.full(n_texts * m, np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        time, drawn, block = np.zeros(len(own)), 0, 1
        while len(own):
            step = (np.arange(block, dtype=np.uint64) + np.uint64(drawn + 1)) * _B
            point = mix(seed[own][:, None] + step[None, :])
            gap = -np.log(((point >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (m * width[own])[:, None]
            at = time[:, None] + np.cumsum(gap, axis=1)
            early = at <= bound[text[own]][:, None]
            second = mix(point ^ _C)
            cell = (second & np.uint64(0xFFFFFFFF)).astype(np.int64) & (width[own] - 1)[:, None]
            i, j = np.nonzero(early & (cell < inside[own][:, None]))
            component = ((second[i, j] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            where = text[own[i]] * m + component
            np.minimum.at(least, where, at[i, j])
            found.append((where, at[i, j], point[i, j]))
            go_on = early[:, -1]
            own, time = own[go_on], at[go_on, -1]
            drawn, block = drawn + block, 8
        flat = out.reshape(-1)
        for where, at, point in found:
            first = least[where] == at
            flat[where[first]] = point[first]
        empty = np.isinf(least.reshape(n_texts, m)[todo]).any(axis=1)
        todo = todo[empty]
        bound[todo] *= 2
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets (keys, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    either = int(a[1].sum()) + int(b[1].sum()) - common
    return common / either if either else 0.0


def _sketches(rows: DataFrame, kind: str) -> DataFrame:
    """id, a 128-bit digest of the multiset, its size and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                texts = texts_of(part, "text")
                n = len(texts)
                keys, counts, owner = multisets(texts)
                signature = bag_minhash(keys, counts, owner, n, BANDS * ROWS)
                band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
                for r in range(ROWS):
                    band = mix(band * _A + signature[:, r::ROWS])
                halves = []
                for salt in (_A, _B):
                    half = np.zeros(n, np.uint64)
                    np.add.at(half, owner, mix(keys ^ salt) * counts.astype(np.uint64))
                    halves.append(mix(half))
                size = np.bincount(owner, counts, n).astype(np.int64)
                for i in np.flatnonzero(size == 0):  # no word: equal only if the text is
                    halves[0][i], halves[1][i] = (hash_text(texts[i], s) for s in (1, 2))
                bands = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(band).view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
                columns = [part.column("id"), pa.array(halves[0].view(np.int64)), pa.array(halves[1].view(np.int64)), pa.array(size), bands]
                yield pa.RecordBatch.from_arrays(columns, ["id", "d1", "d2", "size", "bands"])

    return rows.mapInArrow(run, f"id {kind}, d1 bigint, d2 bigint, size bigint, bands array<bigint>")


def hash_text(text: str, salt: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, salt=bytes([salt])).digest(), "big")


def _texts_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """id and text of the ids, one row each."""
    ids = materialise(ids)
    if ids.count() <= BROADCAST_IDS:  # else Spark shuffles all texts once more
        ids = F.broadcast(ids)
    return materialise(rows.join(ids, "id", "left_semi").dropDuplicates(["id"]))


def _verified(pairs: DataFrame, rows: DataFrame, kind: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts overlap enough; one row of ``rows`` for each id."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), rows)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 19):
                ids = [part.column(c).to_pylist() for c in ("a", "b")]
                for own, column in zip(ids, ("text_a", "text_b"), strict=True):
                    known.add(own, part.column(column))
                close = [overlap(known.of[x], known.of[y]) >= similarity for x, y in zip(*ids, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(close, pa.bool_()))
                known.trim()

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node`` and ``class`` after further links: only classes are linked anew."""
    if classes is None:
        return materialise(components(links))
    if links.isEmpty():
        return classes
    for c in ("a", "b"):
        named = classes.select(F.col("node").alias(c), F.col("class").alias("of"))
        links = links.join(named, c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
    joined = components(links)
    renamed = joined.select(F.col("class").alias("new"), F.col("node").alias("class"))
    old = classes.join(renamed, "class", "left").select("node", F.coalesce("new", "class").alias("class"))
    return materialise(old.union(joined.join(classes, "node", "left_anti")))


def split_multisets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, counts, owner = multisets(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(keys[a:b], counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _linked(active: DataFrame, leaders: DataFrame, rows: DataFrame, kind: str, similarity: float) -> DataFrame:
    """The verified links (a, b) of each bucket's leaders with its other members.

    No pair is a row: leaders and members of a bucket meet in one stream, leaders first,
    and only links leave it. A large bucket is dealt over blocks, each with all leaders.
    A pair that shares several bands is compared in the first of them only.
    """
    blocks = active.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = active.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("member", F.lit(1))
    first = leaders.join(blocks, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", F.lit(0))
    both = members.unionByName(first).join(_texts_of(active.select("id").distinct(), rows), "id")
    both = both.select("bucket", "block", "member", "id", "size", "band", "bands", "class", "text")
    both = both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "member", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _Known(), None
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                found: tuple[list, list] = ([], [])
                known.add(part.column("id").to_pylist(), part.column("text"))
                columns = [part.column(c).to_pylist() for c in ("bucket", "block", "member", "id", "size", "band", "class")]
                bands = np.array(part.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
                for i, (bucket, block, member, x, size, band, of) in enumerate(zip(*columns, strict=True)):
                    if held is None or held.key != (bucket, block):
                        held = _Leaders((bucket, block))
                    if not member:
                        held.add(x, size, of, bands[i], known.of[x])
                        continue
                    for j in held.compared(x, size, of, bands[i], band, similarity):
                        if overlap(held.sets[j], known.of[x]) >= similarity:
                            found[0].append(held.ids[j])
                            found[1].append(x)
                if found[0]:
                    kinds = part.schema.field("id").type
                    yield pa.RecordBatch.from_arrays([pa.array(f, kinds) for f in found], ["a", "b"])
                known.trim()

    return both.mapInArrow(run, f"a {kind}, b {kind}")


class _Known:
    """Multisets of the texts seen last, as a text stands in many buckets."""

    def __init__(self):
        self.of: dict = {}
        self.held = 0

    def add(self, ids: list, texts: pa.Array) -> None:
        at = {x: i for i, x in enumerate(ids) if x not in self.of}
        new = texts.take(pa.array(list(at.values()), pa.int64())).to_pylist()
        for x, found in zip(at, split_multisets(new), strict=True):
            self.of[x] = found
            self.held += len(found[0]) + 64

    def trim(self) -> None:
        if self.held > KNOWN:
            self.of, self.held = {}, 0


class _Leaders:
    """The leaders of one bucket, and which of them a member is still to be compared with."""

    def __init__(self, key):
        self.key, self.ids, self.sets, self.rows = key, [], [], []
        self.arrays = None

    def add(self, x, size, of, bands, found) -> None:
        self.ids.append(x)
        self.sets.append(found)
        self.rows.append((size, of, bands))
        self.arrays = None

    def compared(self, x, size, of, bands, band, similarity) -> list[int]:
        if self.arrays is None:
            sizes, classes, all_bands = zip(*self.rows, strict=True)
            self.arrays = np.array(self.ids), np.array(sizes), np.array(classes), np.array(all_bands)
        ids, sizes, classes, all_bands = self.arrays
        fits = (ids < x) & (classes != of) & (np.minimum(sizes, size) >= similarity * np.maximum(sizes, size))
        fits &= (all_bands == bands).argmax(axis=1) == band
        return np.flatnonzero(fits).tolist()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """``id_col`` and ``class_id`` of every row with an id."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    sketches = materialise(_sketches(rows, kind))
    # Equal multisets: one node each, named by its least id.
    nodes = materialise(sketches.groupBy("d1", "d2").agg(F.min("id").alias("node")))
    own = sketches.join(nodes.select(F.col("node").alias("id"), "d1", "d2"), ["id", "d1", "d2"], "left_semi").where("size > 0").dropDuplicates(["id"])
    members = own.select("id", "size", "bands", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n > 1").drop("n")
    # First each member with the least id of its bucket: one pair a row at most.
    active = materialise(members.select("bucket", "band", "id", "size").join(shared, "bucket"))
    sizes = active.groupBy(F.col("id").alias("a")).agg(F.min("size").alias("size_a"))
    near = F.least("size_a", "size") >= F.greatest("size_a", "size") * F.lit(similarity)
    pairs = active.where("a <> id").select("a", F.col("id").alias("b"), "size").distinct()
    pairs = materialise(pairs.join(sizes, "a").where(near).select("a", "b"))
    classes = _merged(None, materialise(_verified(pairs, rows, kind, similarity)))
    active = active.where("a <> id").drop("a").join(own.select("id", "bands"), "id")
    leaders = LEADERS
    while True:
        # What is left: members after the leaders, in buckets that hold several classes.
        named = active.drop("class").join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("class", "id"))
        mixed = named.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("bucket")
        active = materialise(named.join(mixed, "bucket").select("bucket", "band", "id", "size", "bands", "class"))
        if active.isEmpty():
            break
        first = active.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).where(F.col("rank") <= leaders).drop("rank")
        first = materialise(first)
        classes = _merged(classes, materialise(_linked(active, first, rows, kind, similarity)))
        active = active.join(first.select("bucket", "id"), ["bucket", "id"], "left_anti")
        leaders *= LEADERS
    result = sketches.select("id", "d1", "d2").join(nodes, ["d1", "d2"])
    result = result.join(classes, "node", "left").select("id", F.coalesce("class", "node").alias("class_id"))
    return result.withColumnRenamed("id", id_col)
