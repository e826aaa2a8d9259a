"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is a path of turns, each a 16-byte digest of role and text with its number
of words. Equal paths are one, with the ids that end there. Distinct paths are range-sorted;
inside a partition:

1. Each path is a component; neighbours are linked by the length of their longest common
   prefix (LCP). Links are taken in descending depth: a merge of two components creates a
   branching node at that depth, or joins the node that is there already.
2. Nodes on the partition's first or last path are open, as other partitions may share them.
   All others are final. The open ones are contracted: each keeps the counts of the
   final subtrees below it.
3. Open nodes of all partitions are merged by their prefix and summed up in descending
   depth. There are at most (partitions) x (turns of two conversations) of them, whatever the rows.

A run of nodes with one child each is one edge of the forest; it is written out as its nodes.

Defined results: null roles and texts are empty; turns are ordered by number, null first, and
those of one number by their digest; null ids take no part; a conversation without turns
ends at the root; an empty table has no node, not even a root. A conversation is one row of
some 40 bytes a turn (at most 2 GB), as sorting compares whole paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triskel.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
TURN = 16  # bytes of a digest
IDS = 256  # ids in a piece of a list
ROWS = 1 << 15
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turn_items(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, items`` of every id: its turns in order as (digest, words)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    # The length of the role tells where the text begins.
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(WORD))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.struct(F.col(turn_col).alias("t"), digest.alias("d"), words.alias("w")).alias("item")
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return ordered.select("conv_id", F.transform("items", lambda i: F.struct(i["d"].alias("d"), i["w"].alias("w"))).alias("items"))


def paths(items: Column) -> list[Column]:
    """``path`` (digests on end) and ``words`` of a list of items."""
    path = F.unhex(F.array_join(F.transform(items, lambda i: i["d"]), ""))
    return [path.alias("path"), F.transform(items, lambda i: i["w"]).alias("words")]


def distinct_paths(rows: DataFrame) -> DataFrame:
    """``path, words, conv_id`` (least), ``n`` and ``ends`` (digest of the ascending ids).

    ``rows`` has ``conv_id`` (distinct), ``path`` and ``words``. The digest of a path that many
    share is fed piece by piece from sorted pieces of 256 ids, never from one list.
    """
    rows = materialise(rows)
    pieces = rows.select(F.md5("path").alias("key"), "conv_id", F.floor(F.col("conv_id") / IDS).alias("part"))
    pieces = pieces.groupBy("key", "part").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("key", F.get("ids", F.lit(0)).alias("least"), F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = least = digest = None
        n, out = 0, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "n", "ends"]
            )

        for batch in batches:
            for k, low, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        out.append((least, n, digest.hexdigest()))
                    key, least, n, digest = k, low, 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
                n += count
            if len(out) >= ROWS:
                yield flush()
        if key is not None:
            out.append((least, n, digest.hexdigest()))
            yield flush()

    streamed = pieces.repartition("key").sortWithinPartitions("key", "least").mapInArrow(run, "conv_id bigint, n bigint, ends string")
    return streamed.join(rows, "conv_id")


# ---------------------------------------------------------------- one partition


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at the beginning that two paths share."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(v, np.uint8, n) for v in (a, b))
    differ = x != y
    first = int(np.argmax(differ)) if n else 0
    return (first if n and differ[first] else n) // TURN


def prefix_keys(path: bytes) -> list[bytes]:
    """A digest of each prefix of whole turns, the empty one first."""
    running, keys = hashlib.md5(), []
    for t in range(len(path) // TURN + 1):
        running.update(path[(t - 1) * TURN : t * TURN] if t else b"")
        keys.append(running.digest())
    return keys


class Forest:
    """Branching nodes of sorted distinct paths; components are runs of neighbours."""

    def __init__(self, lengths: list[int], lcp: list[int], ids: list[int], counts: list[int]):
        """``lcp[i]`` is what paths i-1 and i share."""
        m = len(lengths)
        self.depth, self.least, self.n = list(lengths), list(ids), list(counts)
        self.children: list[list[int]] = [[] for _ in range(m)]
        self.path = list(range(m))  # a path that runs through the node
        self.first, self.last = list(range(m)), list(range(m))
        self.parent = [-1] * m
        self._root, self._top = list(range(m)), list(range(m))
        for i in sorted(range(1, m), key=lambda i: -lcp[i]):
            self._merge(i - 1, i, lcp[i])
        self.top = self._top[self._find(0)]
        if self.depth[self.top]:
            self.top = self._node(0, [self.top])
        for node, below in enumerate(self.children):
            for child in below:
                self.parent[child] = node

    def _find(self, i: int) -> int:
        root = self._root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _node(self, depth: int, below: list[int]) -> int:
        self.depth.append(depth)
        self.children.append(below)
        self.parent.append(-1)
        self.path.append(self.path[below[0]])
        self.least.append(min(self.least[b] for b in below))
        self.n.append(sum(self.n[b] for b in below))
        self.first.append(min(self.first[b] for b in below))
        self.last.append(max(self.last[b] for b in below))
        return len(self.depth) - 1

    def _merge(self, i: int, j: int, depth: int) -> None:
        a, b = self._find(i), self._find(j)
        x, y = self._top[a], self._top[b]
        if self.depth[x] != depth and self.depth[y] != depth:
            x = self._node(depth, [x, y])
        else:
            if self.depth[x] != depth or (self.depth[y] == depth and len(self.children[y]) > len(self.children[x])):
                x, y = y, x
            if self.depth[y] != depth:
                self.children[x].append(y)
            else:  # both ends of the link are the same node
                self.children[x] += self.children[y]
                # A path that ends here keeps its number, which tells its list of ids.
                self.path[x] = min(self.path[x], self.path[y])
            self.least[x] = min(self.least[x], self.least[y])
            self.n[x] += self.n[y]
            self.first[x], self.last[x] = min(self.first[x], self.first[y]), max(self.last[x], self.last[y])
        self._root[b] = a
        self._top[a] = x


def partition_nodes(rows: list[list]) -> Iterator[tuple]:
    """Nodes of one partition's sorted ``[path, words, conv_id, n, ends]``.

    Final: (None, parent's key or None, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends). Open: (key, parent's key, conv_id, depth, words of its turn,
    n_convs, and children, leaves and saved tokens of its final subtrees, ends).
    """
    every, words, ids, counts, ends = rows
    m = len(every)
    lengths = [len(p) // TURN for p in every]
    lcp = [0] + [common_turns(every[i - 1], every[i]) for i in range(1, m)]
    forest = Forest(lengths, lcp, ids, counts)
    keys = {0: prefix_keys(every[0]), m - 1: prefix_keys(every[-1])}
    size = len(forest.depth)
    leaves, saved = [0] * size, [0] * size
    final_children, final_leaves, final_saved = [0] * size, [0] * size, [0] * size

    def is_open(v: int) -> bool:
        return forest.first[v] == 0 or forest.last[v] == m - 1

    for v in sorted((v for v in range(size) if v == forest.top or forest.parent[v] >= 0), key=lambda v: -forest.depth[v]):
        up, bottom, n, below = forest.parent[v], forest.depth[v], forest.n[v], forest.children[v]
        above = forest.depth[up] if up >= 0 else -1
        # The first path of a node is the shortest: if one ends here, it is that.
        ended = forest.first[v]
        here = ends[ended] if lengths[ended] == bottom else None
        mine, opened = words[forest.path[v]], is_open(v)
        key = keys[0 if forest.first[v] == 0 else m - 1] if opened else None
        total = final_saved[v] if opened else saved[v]
        found = leaves[v] if below else 1
        for t in range(bottom, above, -1):
            w = mine[t - 1] if t else 0
            at = here if t == bottom else None
            parent_key = key[t - 1] if opened and t else None
            if opened:
                inside = (final_children[v], final_leaves[v], final_saved[v]) if t == bottom else (0, 0, 0)
                yield (key[t], parent_key, forest.least[v], t, w, n, *inside, at)
                continue
            total += (n - 1) * w
            outer = None
            if t == above + 1 and is_open(up):
                parent_key = keys[0 if forest.first[up] == 0 else m - 1][above]
            else:
                outer = forest.least[up] if t == above + 1 else forest.least[v]
            yield (None, parent_key, forest.least[v], t, outer, n, len(below) if t == bottom else 1, found, total, at or NO_ENDS)
        if up >= 0:
            if opened:
                continue
            leaves[up] += found
            saved[up] += total
            final_children[up] += 1
            final_leaves[up] += found
            final_saved[up] += total


# ---------------------------------------------------------------- all partitions

_RAW = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, other bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_KINDS = (pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string())
_NAMES = [f.split()[0] for f in _RAW.split(", ")]


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _partition_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = [[] for _ in range(5)]
    for batch in batches:
        for column, values in zip(held, batch.columns, strict=True):
            column += values.to_pylist()
    if not held[0]:
        return
    out: list[tuple] = []
    for row in partition_nodes(held):
        out.append(row)
        if len(out) >= ROWS:
            yield _batch(out, _KINDS, _NAMES)
            out = []
    if out:
        yield _batch(out, _KINDS, _NAMES)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes, deepest first: each adds its subtree to its parent."""
    waiting: dict[bytes, list[int]] = {}
    for batch in batches:
        out = []
        for key, up, conv, depth, words, n, children, leaves, saved, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more = waiting.pop(key, (0, 0, 0))
            children += more[0]
            leaves = leaves + more[1] if children else 1
            saved += more[2] + (n - 1) * words
            if up is not None:
                sums = waiting.setdefault(up, [0, 0, 0])
                for i, v in enumerate((1, leaves, saved)):
                    sums[i] += v
            out.append((key, up, conv, depth, None, n, children, leaves, saved, ends or NO_ENDS))
        if out:
            yield _batch(out, _KINDS, _NAMES)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conv_id`` (distinct), ``path`` and ``words``."""
    each = materialise(distinct_paths(rows).select("path", "words", "conv_id", "n", "ends"))
    raw = each.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_partition_task, _RAW)
    raw = materialise(raw)

    def total(name: str) -> Column:
        return F.sum(name).alias(name)

    merged = raw.where("key IS NOT NULL").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("other").alias("other"),
        *[total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    opened = materialise(merged.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_sum_up, _RAW))
    names = opened.select(F.col("key").alias("up"), F.col("conv_id").alias("named"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    inner = raw.where("key IS NULL AND parent_key IS NULL").withColumnRenamed("other", "parent_conv_id").select(*columns)
    border = raw.where("key IS NULL AND parent_key IS NOT NULL").unionByName(opened.where("parent_key IS NOT NULL"))
    border = border.join(names, F.col("parent_key") == F.col("up")).withColumn("parent_conv_id", F.col("named")).select(*columns)
    root = opened.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*columns)
    return inner.unionByName(border).unionByName(root)
