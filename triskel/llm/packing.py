"""Packing of tokenised documents into near-equal windows by Karmarkar-Karp differencing.

A task tokenises the rows of its own partition and packs them in groups of about
``windows`` windows. Documents longer than a window give full windows first. What remains
is partitioned by multiway differencing: the two partial partitions with the largest
spreads are merged so that large parts of one meet small parts of the other, until one
partition is left. If its largest part exceeds the capacity, the group is partitioned
again into one window more. Pieces have a quarter of the capacity at most: with longer ones
the differences left over are larger than the padding saved (98.3 % full instead of 99.3 %).
The last document of a group is cut where the group is full and goes on in the next.

No row is shuffled and no group grows with the data: memory is one group and one batch.
The result depends on the order of rows in input partitions only, so a task that runs
again gives the same rows; ``sequence_id`` is the partition number and a running number.

Ids equal those of the tokenizer on the whole text. The tokenizer splits a text into
words, numbers and marks and merges within each of them only, so each distinct one is
tokenised once and looked up after that; texts for which that is not so (control strings
of the vocabulary, capital sigma) are tokenised whole.

Defined results: a null or empty text is the end id alone; repeated rows are packed one
by one; very long texts are cut into as many windows as they need; an empty table gives
no piece; only the named columns are read.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.llm.text import LETTER, NUMBER, OTHER, SPACE, classes, code_points, run_hashes, slices, texts_of

CAPACITY, WINDOWS, SLACK, END_ID = 4096, 64, 0.008, 2
_SLOTS, _MOST_IDS = 1 << 20, 1 << 22


class WordTokenizer:
    """Whole-text ids of a lower-casing BPE vocabulary with word ends, by way of its words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.control = [t["content"] for t in spec["added_tokens"]]
        split = [{"type": "WhitespaceSplit"}, *[p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]]
        self.by_word = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": split}}))
        vocabulary = spec["model"]["vocab"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int64)
        self.size = np.zeros(_SLOTS, np.int64)
        self.ids = np.zeros(1 << 16, np.uint16 if len(self.ends_word) <= 1 << 16 else np.uint32)
        self.used = 0

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, the units' starts and ends in them, and the bounds of the texts."""
        codes, bounds = code_points([(t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).lower() for t in texts])
        kind = classes()[codes]
        edge = np.ones(len(codes) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        edge[bounds] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1].copy(), at[1:].copy()
        kinds = kind[starts] if len(codes) else kind
        # An apostrophe by itself takes the endings s t m d re ve ll from the letters behind it.
        i = np.flatnonzero((kinds == OTHER) & (ends - starts == 1))
        i = i[i + 1 < len(starts)]
        i = i[(codes[starts[i]] == ord("'")) & (kinds[i + 1] == LETTER)]
        i = i[bounds[np.searchsorted(bounds, starts[i + 1])] != starts[i + 1]]
        if len(i):
            first = codes[starts[i + 1]]
            second = np.where(ends[i + 1] - starts[i + 1] > 1, codes[np.minimum(starts[i + 1] + 1, len(codes) - 1)], 0)
            one = np.isin(first, [ord(c) for c in "stmd"])
            two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
            taken = np.where(one, 1, np.where(two, 2, 0))
            ends[i] += taken
            starts[i + 1] += taken
        kept = (kinds != SPACE) & (ends > starts)
        return codes, starts[kept], ends[kept], bounds

    def _learn(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokenises units that are not known yet; where their ids are, and how many."""
        units = [codes[s:e].tobytes().decode("utf-32-le", "surrogatepass") for s, e in zip(starts, ends, strict=True)]
        ids = np.array(self.by_word.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(self.ends_word[ids]) + 1
        if len(last) != len(units):
            raise ValueError("the vocabulary does not mark word ends")
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(ids)), self.ids.dtype)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        size = np.diff(last, prepend=0)
        at = self.used + last - size
        self.used += len(ids)
        return at, size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        odd = [i for i, t in enumerate(texts) if "Σ" in t or any(c in t for c in self.control)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        codes, starts, ends, bounds = self._units(plain)
        if self.used > _MOST_IDS:
            self._clear()
        keys = run_hashes(codes, starts, ends) | np.uint64(1)
        slot = (keys >> np.uint64(44)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        missing = np.flatnonzero(self.keys[slot] != keys)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            where, how_many = self._learn(codes, starts[missing[first]], ends[missing[first]])
            at[missing], size[missing] = where[back], how_many[back]
            slots = (new >> np.uint64(44)).astype(np.int64)
            slots, own = np.unique(slots, return_index=True)  # one word a slot
            self.keys[slots], self.at[slots], self.size[slots] = new[own], where[own], how_many[own]
        stop = np.cumsum(size)
        flat = self.ids[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        per_text = np.concatenate([[0], stop])[np.searchsorted(starts, bounds)]
        out = [flat[a:b] for a, b in zip(per_text[:-1], per_text[1:], strict=True)]
        for i in odd:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, self.ids.dtype)
        return out


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` lists of indices into ``sizes`` with nearly equal sums.

    A partial partition keeps its non-zero parts only, largest first; each part is a
    binary tree of items. Merging pairs the largest with the smallest parts and takes the
    least sum off all, as only differences matter.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    trees: list[tuple[int, int]] = []  # tree number n + j is trees[j]
    n, ticket = len(sizes), len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            parts = a + b
        else:
            # The smallest parts of both meet the largest of the other; the rest stay alone.
            parts = a[: len(a) - over] + b[: len(b) - over]
            for (s, x), (t, y) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True):
                trees.append((x, y))
                parts.append((s + t, n + len(trees) - 1))
        parts.sort(key=lambda p: (-p[0], p[1]))
        spread = parts[0][0]
        if len(parts) == k:
            # Kept as true sums; the spread is what ranks it.
            spread -= parts[-1][0]
        heapq.heappush(heap, (-spread, ticket, parts))
        ticket += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += trees[x - n]
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of pieces none longer than ``capacity``; one window more until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = karmarkar_karp(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


class _Packer:
    """Collects documents to groups and turns groups to rows of pieces."""

    def __init__(self, partition: int, capacity: int, windows: int):
        self.capacity = capacity
        self.room = int(windows * capacity * (1 - SLACK))
        self.longest = max(1, capacity // 4)
        self.next_id = partition << 32
        self.pieces: list[tuple[object, int, np.ndarray, int]] = []  # id, start, ids, tokens of the document
        self.filled = 0
        self.rows: list[tuple] = []

    def _emit(self, window: list[tuple[object, int, np.ndarray, int]]) -> None:
        offset = 0
        for key, start, ids, total in window:
            self.rows.append((key, start, len(ids), total, self.next_id, offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.next_id += 1

    def add(self, key, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._emit([(key, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        while at < total:
            piece = ids[at : at + min(self.longest, self.room - self.filled)]
            self.pieces.append((key, at, piece, total))
            self.filled += len(piece)
            at += len(piece)
            if self.filled == self.room:
                self.flush()

    def flush(self) -> None:
        for window in pack_group([len(p[2]) for p in self.pieces], self.capacity):
            self._emit([self.pieces[i] for i in window])
        self.pieces, self.filled = [], 0


def pack_documents(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, windows: int = WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset and ``ids``
    (little-endian unsigned 32-bit). A window is the pieces of a sequence_id by offset."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer(tokenizer)
        packer = _Packer(TaskContext.get().partitionId(), capacity, windows)
        key_type = pa.int64()

        def emit() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) if packer.rows else [[]] * 7
            packer.rows = []
            types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            key_type = batch.schema.field("id").type
            for part in slices(batch, "text"):
                ends = np.array([end_id], encoder.ids.dtype)
                for key, ids in zip(part.column("id").to_pylist(), encoder.encode(texts_of(part, "text")), strict=True):
                    packer.add(key, np.concatenate([ids, ends]))
                if packer.rows:
                    yield emit()
        packer.flush()
        if packer.rows:
            yield emit()

    out = rows.mapInArrow(run, f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return out.withColumnRenamed("id", id_col)
