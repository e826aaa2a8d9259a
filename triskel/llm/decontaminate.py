"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut to passages of at most 64 words. Their TF-IDF vectors (document
frequencies from all documents) are factored by a randomised SVD whose two passes over
the passages are distributed. Windows of a document, as long as the passages they are
compared with, are folded into the latent space as sums of word vectors; passages whose
cosine with a window reaches ``COSINE`` are candidates. The space keeps little of a passage
whose words few others use; where it keeps less than ``KEPT`` of the length, an inverted
index on the passage's words also gives every place that holds as many of them as a leak
must (cosine over the passage's own words).

A candidate is a leak if the longest common subsequence of words covers ``VERBATIM`` of
the passage; as a paraphrase, if it covers ``PARAPHRASE`` of it and also that share of its
answer, the last quarter, and of its rare words.

An item of one or two words is a leak where all its words stand in their order, with one
word between them at most; it is looked up word by word.

Words in more than ``COMMON`` of all documents take no part in retrieval, unless a passage
has fewer than five others. Windows start at each word that takes part, so the work is
proportional to what a document shares with the benchmark.

Documents are never shuffled. The benchmark is worked through in blocks of ``BLOCK``
passages, which bounds the model that is broadcast; each block is one more narrow pass.

Defined results: a null or empty text has no leak, a null or wordless item none either;
ties between items are all reported; rows, also repeated ones, are judged one by one;
whole texts are read; an empty benchmark or table gives no leak.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from triskel.llm.text import mix, slices, texts_of, words

SCALES = (16, 32, 64)
RANK, OVERSAMPLE, FIT_TASKS, BLOCK = 256, 16, 4, 16384
COSINE, COMMON, FEW, KEPT = 0.45, 0.05, 5, 0.9
PART_BYTES = 1 << 17  # of text whose windows are held at a time
VERBATIM, PARAPHRASE = 0.7, 0.5
LEAK = StructType([StructField("item_id", LongType()), StructField("cosine", DoubleType()), StructField("lcs", DoubleType()), StructField("answer", DoubleType())])


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; one big-integer step for each of ``b``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            met = row & m
            row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@dataclass
class Passages:
    """A block of benchmark passages: words by position, and vectors in the latent space."""

    item: np.ndarray
    words: list[np.ndarray]
    vocabulary: np.ndarray  # sorted hashes of the words that take part
    word_vectors: np.ndarray  # idf-weighted, vocabulary x rank
    idf: np.ndarray
    vectors: np.ndarray  # passages x rank, of length one
    scale: np.ndarray  # index into SCALES
    rare: list[frozenset[int]]  # the words of each passage that take part
    least: np.ndarray  # of these, the number that a leak must have
    listed: np.ndarray  # passages of which the space keeps too little, by word
    lists: np.ndarray  # bounds of each word's passages in them
    short_keys: np.ndarray  # sorted keys of items of one or two words
    short_items: np.ndarray


def _cut(items: list, texts: list[str]) -> tuple[list, list[np.ndarray]]:
    """Passages of nearly equal length, none above the largest scale."""
    hashes, bounds = words(texts)
    names, out = [], []
    for item, a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
        parts = -(-(b - a) // SCALES[-1])
        for i in range(parts):
            names.append(item)
            out.append(hashes[a + (b - a) * i // parts : a + (b - a) * (i + 1) // parts])
    return names, out


def _lookup(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _document_frequencies(documents: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each word: a partial sum a task."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen, total = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = words(texts_of(part, "text"))
                total += len(bounds) - 1
                at = _lookup(hashes, known)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at >= 0]
                once = np.unique(owner * len(known) + at[at >= 0])
                seen += np.bincount(once % max(len(known), 1), minlength=len(known))
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(seen[there], total))], ["word", "n"])

    counted = documents.select(F.col(text_col).alias("text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[counted["word"]] = counted["n"]
    return int(out[-1]), out[:-1]


def _sums(passages: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, of) -> np.ndarray:
    """Sum over tasks of ``of(rows)``, rows being (word numbers, TF-IDF values of length one)."""
    shared = passages.sparkSession.sparkContext.broadcast((vocabulary, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        total = None
        for batch in batches:
            rows = [_vector(np.array(w, np.int64).view(np.uint64), known, weight) for w in batch.column(0).to_pylist()]
            part = of([r for r in rows if len(r[0])])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part"])

    parts = passages.mapInArrow(run, "part binary").toLocalIterator()  # one at a time on the driver
    return sum(np.frombuffer(r["part"], np.float32).astype(np.float64) for r in parts)


def _vector(hashes: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _lookup(hashes, vocabulary)
    at, n = np.unique(at[at >= 0], return_counts=True)
    value = n * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm else value


def _latent(passages: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the passages' TF-IDF rows."""
    d = len(vocabulary)
    rank = min(RANK + OVERSAMPLE, n, d)
    start = np.random.default_rng(0).standard_normal((d, rank))

    def spread(basis: np.ndarray):
        def of(rows) -> np.ndarray:
            out = np.zeros((d, rank))
            for at, value in rows:
                out[at] += value[:, None] * (value @ basis[at])[None, :]
            return out

        return of

    def squared(basis: np.ndarray):
        def of(rows) -> np.ndarray:
            y = np.array([value @ basis[at] for at, value in rows]).reshape(-1, rank)
            return y.T @ y

        return of

    basis, _ = np.linalg.qr(_sums(passages, vocabulary, idf, spread(start)).reshape(d, rank))
    values, rotation = np.linalg.eigh(_sums(passages, vocabulary, idf, squared(basis)).reshape(rank, rank))
    kept = np.argsort(-values)[: min(RANK, rank)]
    return basis @ rotation[:, kept[values[kept] > 1e-9 * max(values.max(), 1e-300)]]


def fit_passages(documents: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str) -> list[Passages]:
    """The benchmark in blocks of passages, each with its latent space."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, cut = _cut(part.column("item").to_pylist(), texts_of(part, "text"))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([c.view(np.int64) for c in cut], pa.list_(pa.int64()))], ["item", "words"])

    passages = items.mapInArrow(run, "item bigint, words array<bigint>")
    n_blocks = -(-passages.count() // BLOCK)
    blocks = []
    for b in range(n_blocks):
        own = passages.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == b).distinct()
        table = own.toPandas().sort_values("item", kind="stable")  # about BLOCK rows of 64 words at most
        cut = [np.asarray(w, np.int64).view(np.uint64) for w in table["words"]]
        if not cut:
            continue
        vocabulary = np.unique(np.concatenate(cut))
        total, frequency = _document_frequencies(documents, text_col, vocabulary)
        idf = np.log((1.0 + total) / (1.0 + frequency)) + 0.1
        # Common words are left out where that leaves enough of a passage.
        rare = frequency <= max(COMMON * total, 1.0)
        for w in cut:
            at = np.unique(_lookup(w, vocabulary))
            if rare[at].sum() < FEW:
                rare[at] = True
        vocabulary, idf = vocabulary[rare], idf[rare]
        dealt = spark.createDataFrame([(w.view(np.int64).tolist(),) for w in cut], "words array<bigint>").repartition(FIT_TASKS)
        space = _latent(dealt, vocabulary, idf, len(cut))
        rows = [_vector(w, vocabulary, idf) for w in cut]
        vectors = np.array([value @ space[at] for at, value in rows], np.float32).reshape(len(cut), -1)
        kept = np.linalg.norm(vectors, axis=1)
        vectors /= np.maximum(kept[:, None], 1e-12)
        scale = np.searchsorted(SCALES, [len(w) for w in cut])
        sizes = np.array([len(at) for at, _ in rows])
        least = np.maximum(1, np.minimum(np.ceil(PARAPHRASE * sizes), np.ceil(sizes - (1 - VERBATIM) * np.array([len(w) for w in cut])))).astype(np.int64)
        weak = np.flatnonzero(kept < KEPT)
        of_word = np.concatenate([np.zeros(0, np.int64), *[rows[j][0] for j in weak]])
        order = np.argsort(of_word, kind="stable")
        lists = np.searchsorted(of_word[order], np.arange(len(vocabulary) + 1))
        listed = np.repeat(weak, sizes[weak])[order]
        blocks.append(Passages(table["item"].to_numpy(np.int64), cut, vocabulary, (idf[:, None] * space).astype(np.float32), idf, vectors, scale, [frozenset(at.tolist()) for at, _ in rows], least, listed, lists, *_short_passages(table["item"].to_numpy(np.int64), cut)))
    return blocks


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second)


def _short_passages(items: np.ndarray, cut: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and items of the passages of one or two words: the word, or a hash of both."""
    own = [(j, w) for j, w in enumerate(cut) if len(w) in (1, 2)]
    keys = np.array([w[0] if len(w) == 1 else _pair_keys(w[:1], w[1:])[0] for _, w in own], np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], items[[j for j, _ in own]][order] if own else np.zeros(0, np.int64)


def _short_leaks(hashes: np.ndarray, bounds: np.ndarray, p: Passages) -> Iterator[tuple[int, int]]:
    """(text, item) of the items of one or two words."""
    if not len(p.short_keys) or not len(hashes):
        return
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = [(owner, hashes)]
    for gap in (1, 2):
        inside = np.flatnonzero(owner[gap:] == owner[:-gap])
        found.append((owner[inside], _pair_keys(hashes[inside], hashes[inside + gap])))
    for text, key in found:
        lo, hi = (np.searchsorted(p.short_keys, key, side) for side in ("left", "right"))
        met = np.flatnonzero(hi > lo)
        once = np.unique(np.stack([text[met], lo[met], hi[met]]), axis=1)
        for t, a, b in once.T.tolist():
            for j in range(a, b):
                yield t, int(p.short_items[j])


def _candidates(at: np.ndarray, owner: np.ndarray, place: np.ndarray, p: Passages) -> Iterator[tuple[int, int, float]]:
    """(number of the window's first word, passage, cosine) for the words that take part:
    their vocabulary numbers, texts and places in them."""
    sums = np.concatenate([np.zeros((1, p.word_vectors.shape[1]), np.float64), np.cumsum(p.word_vectors[at], axis=0, dtype=np.float64)])
    key = owner * (1 << 40) + place
    for s, length in enumerate(SCALES):
        own = np.flatnonzero(p.scale == s)
        if not len(own):
            continue
        end = np.searchsorted(key, key + length)
        # A window needs a few of a passage's words; the next start sees the rest of a longer match.
        start = np.flatnonzero(end - np.arange(len(at)) >= 3)
        for lo in range(0, len(start), 4096):
            i = start[lo : lo + 4096]
            window = (sums[end[i]] - sums[i]).astype(np.float32)
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
            cosine = window @ p.vectors[own].T
            for w, j in zip(*np.nonzero(cosine >= COSINE), strict=True):
                yield int(i[w]), int(own[j]), float(cosine[w, j])


def _listed_candidates(at: np.ndarray, owner: np.ndarray, place: np.ndarray, p: Passages) -> Iterator[tuple[int, int, float]]:
    """As ``_candidates``, by the passages' own words: exact, for the passages that are listed."""
    if not len(p.listed) or not len(at):
        return
    n_passages, n_words = len(p.words), len(p.vocabulary)
    own = np.unique(owner * n_words + at)  # each word once a text
    text, word = own // n_words, own % n_words
    many = np.diff(p.lists)[word]
    pairs = []
    for lo, hi in _runs(many, 1 << 20):
        n = many[lo:hi]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        passage = p.listed[np.repeat(p.lists[word[lo:hi]], n) + inside]
        pairs.append(np.unique(np.repeat(text[lo:hi], n) * n_passages + passage, return_counts=True))
    key, at_key = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
    shared = np.bincount(at_key, np.concatenate([c for _, c in pairs]), len(key))
    first = np.searchsorted(owner, np.arange(owner[-1] + 2))
    for k in key[shared >= p.least[key % n_passages]].tolist():
        t, j = divmod(k, n_passages)
        lo, hi = int(first[t]), int(first[t + 1])
        words_j = np.array(sorted(p.rare[j]), np.int64)
        there = lo + np.flatnonzero(np.isin(at[lo:hi], words_j))
        own_words = np.searchsorted(words_j, at[there])
        weight = p.idf[words_j]
        passage = np.bincount(np.searchsorted(words_j, (w := _lookup(p.words[j], p.vocabulary))[w >= 0]), minlength=len(words_j)) * weight
        end = np.searchsorted(place[there], place[there] + SCALES[p.scale[j]])
        for i, (a, b) in enumerate(zip(range(len(there)), end.tolist(), strict=True)):
            window = np.bincount(own_words[a:b], minlength=len(words_j)) * weight
            yield int(there[i]), j, float(window @ passage / np.sqrt((window @ window) * (passage @ passage)))


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items whose sizes add up to about ``limit``."""
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from zip(cuts, cuts[1:], strict=False)


def _leaks_in(hashes: np.ndarray, bounds: np.ndarray, p: Passages) -> list[dict[int, tuple[float, float, float]]]:
    """For each text the leaked items with (cosine, lcs, answer)."""
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(len(bounds) - 1)]
    at = _lookup(hashes, p.vocabulary)
    there = np.flatnonzero(at >= 0)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[there]
    tried: dict[tuple[int, int, bool], int] = {}
    own = at[there].tolist()
    latent = ((*c, False) for c in _candidates(at[there], owner, there, p))
    listed = ((*c, True) for c in _listed_candidates(at[there], owner, there, p))
    for i, j, cosine, exact in chain(latent, listed):
        passage = p.words[j]
        n = len(passage)
        if n < 3:
            continue
        # Rare words that are missing in and around the window bound what can be in common.
        rare = p.rare[j]
        near = rare.intersection(own[max(0, i - n // 2) : i + n + n // 2])
        if len(near) < PARAPHRASE * len(rare) and len(rare) - len(near) > (1 - VERBATIM) * n:
            continue
        text, place = int(owner[i]), int(there[i])
        # Windows that start a few words on see the same region.
        if place - tried.get((text, j, exact), -(1 << 60)) < max(2, n // 8):
            continue
        tried[text, j, exact] = place
        lo, hi = max(int(bounds[text]), place - n // 2), min(int(bounds[text + 1]), place + n + n // 2)
        region = hashes[lo:hi]
        share = lcs_length(passage, region) / n
        if share < PARAPHRASE:
            continue
        answer = passage[-max(1, n // 4) :]
        in_answer = lcs_length(answer, region) / len(answer)
        if share < VERBATIM:
            if in_answer < PARAPHRASE or len(near) < PARAPHRASE * len(rare):
                continue
        item = int(p.item[j])
        out[text][item] = max(out[text].get(item, (0.0, 0.0, 0.0)), (cosine, share, in_answer), key=lambda x: (x[1], x[0]))
    for text, item in _short_leaks(hashes, bounds, p):
        out[text][item] = (1.0, 1.0, 1.0)
    return out


def find_leaks(df: DataFrame, text_col: str, blocks: list[Passages], leaks_col: str = "leaks") -> DataFrame:
    """All columns of ``df`` and the benchmark items each text holds, by item."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
    names = list(df.columns)
    out = df.withColumn(leaks_col, F.array().cast(ArrayType(LEAK)))
    for block in blocks:
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for batch in batches:
                for part in slices(batch, text_col, PART_BYTES):
                    hashes, bounds = words(texts_of(part, text_col))
                    found = _leaks_in(hashes, bounds, p)
                    rows = part.column(leaks_col).to_pylist()
                    for row, new in zip(rows, found, strict=True):
                        row += [dict(item_id=i, cosine=c, lcs=x, answer=a) for i, (c, x, a) in sorted(new.items())]
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(rows, kind)], [*names, leaks_col])

        out = out.mapInArrow(run, StructType([*df.schema.fields, StructField(leaks_col, ArrayType(LEAK))]))
    return out
