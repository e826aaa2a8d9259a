"""Toxicity by class-conditional Kneser-Ney models of order two.

Two word models are counted, one on toxic and one on ordinary training documents. Both
share what stands in for rare expressions: the continuation counts (in how many contexts
a word occurs, whatever the class) and the backoff weights. With discount D, a context v
that has discounted mass in both classes, and pooled backoff weight g,

    P_c(w)   = (1 - g)    * max(n_c(w) - D, 0) / sum  + g    * N1+(. w) / N1+(. .)
    P_c(w|v) = (1 - g(v)) * max(n_c(v w) - D, 0) / sum + g(v) * P_c(w)

so an expression too rare for either class has the same probability in both and says
nothing. The start of a text is a context like any word. A text's features are
length-normalised differences of log-likelihoods: the most
toxic span of 1, 4 and 16 words and the whole text. A logistic regression turns them
into a score. It is fitted on documents scored by models of the *other* folds of the
training documents, and the discount is the one that gives the least loss there.

Counts cover every word and pair of every training document, each expression once a
document and each text once however many copies it has, or a repeated word would pass for
a frequent one. A task adds up its own words and pairs, Spark adds up the tasks. No word,
context or pair is dropped for want of room: written are all that two documents have, and
the others enter by sums alone, as their discounted count is 0 under every discount.
``HELD`` entries of the finished table, those of most documents, are held by every task;
what is beyond them is joined to the distinct expressions of blocks of texts. Bounded is
the fit of the logistic regression: ``FIT_ROWS`` documents (expected).

Defined results: a null or empty text has the score of features 0; a document with
several labels is toxic if one says so; labels that are null teach nothing; without both
classes in the training rows every score is the share of toxic ones (0 if there is no
row); repeated rows count as rows; texts are read whole; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from triskel.llm.text import mix, slices, texts_of, words
from triskel.session import materialise

FOLDS = 4
DISCOUNTS = (1.5, 3.0, 6.0, 12.0, 24.0, 48.0, 96.0)
SPANS = (1, 4, 16)
FIT_ROWS, FIT_BLOCKS, LEAST_COUNT = 20_000, 4, 2
HELD, BLOCK_CHARS = 1 << 21, 1 << 23
BROADCAST_LABELS = 4_000_000
START, ALL = 0x53, 0x41  # stand among the hashes of words for the start of a text and for the sums over all words
SLOTS = 1 << 27  # of the bitmap that tells which keys are worth a join
COUNTS = [f"n{i}" for i in range(2 * FOLDS)]
AFTER = [f"after{f}" for f in range(FOLDS)]


@dataclass
class ToxicityModel:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted, of the words and pairs held
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # difference of their log-likelihoods
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(SPANS) + 1))
    bias: float = 0.0
    discount: float = 0.0
    rest: DataFrame | None = None  # key and x of the entries not held
    marks: np.ndarray | None = None  # bitmap of their keys

    @cached_property
    def places(self) -> pd.Index:
        """Index of the keys, made once by each worker."""
        return pd.Index(self.keys)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ self.weights + self.bias, -500, 500)))


def expressions(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, hash of the word before it or ``START``, bounds of the texts."""
    hashes, bounds = words(texts)
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    first = bounds[:-1]
    before[first[first < len(hashes)]] = START
    return hashes, before, bounds


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a pair among those of words, as ``_pair_key`` in Spark."""
    return (before << np.uint64(1)) ^ word


def _pair_key() -> Column:
    return F.shiftleft("v", 1).bitwiseXOR(F.col("w"))


def distinct(values: np.ndarray) -> np.ndarray:
    """A place of each distinct value. ``np.unique`` gives the first one, for which it
    sorts stably; that takes four times as long."""
    order = np.argsort(values)
    ranked = values[order]
    return order[np.append(np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1])]


def marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(SLOTS - 1)
    return (marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _marks(keys: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of the column ``key``; a key not marked is not among them."""
    slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1)) + 1  # Spark numbers positions and buckets from 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    marks = np.zeros((SLOTS // 32768, 4096), np.uint8)
    for part in parts.toLocalIterator():
        marks[part["b"] - 1] = np.frombuffer(part["bits"], np.uint8)
    return marks.reshape(-1)


def spans(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, features) of the values of their words."""
    out = np.zeros((len(bounds) - 1, len(SPANS) + 1))
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    starts = bounds[:-1][some]
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(value))
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    for j, n in enumerate(SPANS):
        out[some, j] = np.maximum.reduceat((total[np.minimum(at + n, end)] - total[at]) / n, starts)
    out[some, -1] = (total[bounds[1:][some]] - total[starts]) / np.diff(bounds)[some]
    return out


def labelled(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train) -> DataFrame:
    """text, toxic and fold of the training documents that have a label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    docs = documents.where(train).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    few = labels.count() <= BROADCAST_LABELS  # else Spark shuffles both sides
    # Of equal texts one stands for all; it is toxic if one of them is.
    digest = docs.select("id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    digest = digest.join(F.broadcast(known) if few else known, "id")
    known = materialise(digest.groupBy("digest").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")).drop("digest"))
    known = F.broadcast(known) if few else known
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int")
    return docs.join(known, "id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), fold.alias("fold"))


def _counted(rows: DataFrame, pairs: bool) -> DataFrame:
    """The number of documents with each pair (v, w), or each word, in each (class, fold),
    summed in the task, then by Spark. A word also has the number of pairs it begins
    (after: by fold) and ends (before), each pair once a document; the word ``ALL`` has
    the sums over all words.

    Most pairs of a task are of one document: they leave it in a row for each kind (class
    and fold), words in one with a column for each."""
    names = COUNTS if pairs else [*COUNTS, *AFTER, "before"]
    ids = ["v", "w"] if pairs else ["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.Table:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            if pairs:
                v, w, kinds = columns
                found = pa.table({"v": v.view(np.int64), "w": w.view(np.int64), "kind": kinds})
                found = found.group_by(["v", "w", "kind"], use_threads=False).aggregate([([], "count_all")]).rename_columns([*ids, "kind", "n"])
                return found.take(np.argsort(found.column("v").to_numpy()))  # neighbours alike: shuffled files get smaller
            at, keys = pd.factorize(columns[0])
            counts = np.bincount(at * len(names) + columns[1], minlength=len(names) * len(keys)).reshape(-1, len(names))
            counts = np.vstack([counts, counts.sum(axis=0)]).astype(np.int32)
            keys = np.append(keys, np.uint64(ALL)).view(np.int64)
            return pa.table({"key": keys} | {n: counts[:, i].copy() for i, n in enumerate(names)})

        for batch in batches:
            for part in slices(batch, "text"):
                fold = part.column("fold").to_numpy().astype(np.int8)
                kind = part.column("toxic").to_numpy().astype(np.int8) * np.int8(FOLDS) + fold
                hashes, before, bounds = expressions(texts_of(part, "text"))
                owner, pair = np.repeat(np.arange(len(kind)), np.diff(bounds)), pair_key(before, hashes)
                seeds = mix(np.arange(len(kind)).astype(np.uint64))[owner]
                once = distinct(mix(pair) + seeds)
                if pairs:
                    held.append((before[once], hashes[once], kind[owner[once]]))
                    size += len(once)
                else:
                    single = distinct(mix(hashes) + seeds)
                    held.append((hashes[single], kind[owner[single]]))
                    held.append((before[once], fold[owner[once]] + np.int8(2 * FOLDS)))
                    held.append((hashes[once], np.full(len(once), 3 * FOLDS, np.int8)))
                    size += len(single) + 2 * len(once)
                if size > (2_000_000 if pairs else 4_000_000):
                    yield from flush().to_batches()
                    held, size = [], 0
        if held:
            yield from flush().to_batches()

    counted = rows.mapInArrow(run, "v bigint, w bigint, kind tinyint, n bigint" if pairs else ", ".join(["key bigint", *[f"{n} int" for n in names]]))
    sums = [F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0) if pairs else n).alias(n) for i, n in enumerate(names)]
    # Dealt out as they are: a second sum in the task would find next to nothing to add up.
    return counted.repartition(*ids).groupBy(*ids).agg(*sums)


def _least(counted: DataFrame, count: str, rows: int) -> int:
    """The least count that no more than ``rows`` rows reach: from the counts of counts,
    so that nothing is sorted."""
    many = counted.groupBy(count).count().toPandas().sort_values(count, ascending=False)
    fits = many[many["count"].cumsum() <= rows]
    return int(fits[count].min()) if len(fits) else (1 << 62)


def _contexts(pairs: DataFrame) -> DataFrame:
    """key and masses of the contexts: by fold, for the models of the other folds that have
    a mass of both classes there, the masses under each discount."""
    folds = F.array(*[F.struct(F.lit(f).alias("fold"), *[_in_class(c, _others(f)).alias(f"n{c}") for c in (0, 1)]) for f in range(FOLDS)])
    pairs = pairs.select("v", F.inline(folds)).where(F.greatest("n0", "n1") > min(DISCOUNTS))  # the others have no mass
    n0, n1 = F.col("n0"), F.col("n1")
    masses = [m for d in DISCOUNTS for m in _discounted(n0, n1, d)]
    by_fold = pairs.groupBy("v", "fold").agg(F.array(*masses).cast("array<float>").alias("masses")).where("masses[0] > 0 and masses[1] > 0")
    return by_fold.groupBy(F.col("v").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("fold", "masses"))).alias("masses"))


def _in_class(c: int, folds: tuple[int, ...] = tuple(range(FOLDS))) -> Column:
    return sum((F.col(f"n{c * FOLDS + f}") for f in folds), F.lit(0))


def _others(fold: int) -> tuple[int, ...]:
    return tuple(f for f in range(FOLDS) if f != fold)


def _masses(d: float, folds: tuple[int, ...]) -> list[Column]:
    """Discounted mass of both classes, and what the pooled counts have beyond 2 d."""
    return _discounted(_in_class(0, folds), _in_class(1, folds), d)


def _discounted(n0: Column, n1: Column, d: float) -> list[Column]:
    return [F.sum(F.greatest(n0 - d, F.lit(0.0))), F.sum(F.greatest(n1 - d, F.lit(0.0))), F.sum(F.greatest(n0 + n1 - 2 * d, F.lit(0.0)))]


def fit_toxicity(rows: DataFrame) -> ToxicityModel:
    """A model of ``labelled`` rows."""
    per_class = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = _in_class(0) + _in_class(1)
    both = len(per_class) == 2
    if both:
        # Continuation counts: in how many contexts a word stands, in either class. A pair
        # is counted once for each of its documents by ``before``, so that pairs of one
        # document need not be kept.
        pairs = materialise(_counted(rows, True).where(total >= LEAST_COUNT))
        again = pairs.groupBy(F.col("w").alias("key")).agg(F.sum(total - 1).alias("again"))
        known = _counted(rows, False).where((total >= LEAST_COUNT) | F.col("key").isin(START, ALL))
        follows = (F.col("before") - F.coalesce("again", F.lit(0))).alias("follows")
        lexicon = materialise(known.join(again, "key", "left").select("key", *COUNTS, *AFTER, follows))
        over_all = lexicon.where(F.col("key") == ALL).first()
        lexicon = lexicon.where(F.col("key") != ALL)
        both = over_all is not None and sum(over_all[n] for n in COUNTS) > 0
    if not both:
        p = np.clip(per_class.get(1, 0) / max(1, sum(per_class.values())), 1e-9, 1 - 1e-9)
        return ToxicityModel(bias=float(np.log(p / (1 - p))))
    pairs = pairs.withColumn("key", _pair_key())
    contexts = over_all["follows"] - (pairs.agg(F.sum(total - 1)).first()[0] or 0)

    def unigrams(sets: list[tuple[float, tuple[int, ...]]]) -> np.ndarray:
        """Masses of both classes and backoff weight of the words, for each discount and set of folds."""
        found = np.nan_to_num(np.array(lexicon.agg(*[m for d, folds in sets for m in _masses(d, folds)]).first(), np.float64)).reshape(-1, 3)
        n = np.array([sum(over_all[COUNTS[c * FOLDS + f]] for c in (0, 1) for f in folds) for _, folds in sets], np.float64)
        found[:, 2] = (n - found[:, 2]) / np.maximum(n, 1)
        return found

    # Each fold is scored by the models of the other ones.
    crossed = [(d, _others(f)) for f in range(FOLDS) for d in DISCOUNTS]
    base = unigrams(crossed).reshape(FOLDS, len(DISCOUNTS), 3)
    features, toxic = _sampled_features(rows, FIT_ROWS / sum(per_class.values()), lexicon, pairs, base, float(contexts))
    best = None
    for k, d in enumerate(DISCOUNTS):
        weights, loss = _logistic(features[k], toxic)
        if best is None or loss < best[0]:
            best = (loss, d, weights)
    _, d, weights = best
    model = ToxicityModel(weights=weights[:-1], bias=float(weights[-1]), discount=d)
    _hold(model, _table(lexicon, pairs, d, unigrams([(d, tuple(range(FOLDS)))])[0], float(contexts)))
    return model


def _table(lexicon: DataFrame, pairs: DataFrame, d: float, base: np.ndarray, contexts: float) -> DataFrame | None:
    """key, x (difference of log-likelihoods) and uses (documents) of all that says
    something under discount ``d``; a pair that has no entry is worth its second word."""
    if not base[:2].all():
        return None
    every = tuple(range(FOLDS))
    n0, n1, uses = _in_class(0), _in_class(1), (_in_class(0) + _in_class(1)).alias("uses")

    def above(n: Column) -> Column:
        return F.greatest(n - d, F.lit(0.0))

    p = [float((1 - base[2]) / base[c]) * above((n0, n1)[c]) + float(base[2] / contexts) * F.col("follows") for c in (0, 1)]
    of_words = lexicon.where(F.col("key") != START).select(F.col("key").alias("w"), p[0].alias("p0"), p[1].alias("p1"), uses, (F.greatest(n0, n1) > d).alias("told"))
    m0, m1, beyond = _masses(d, every)
    pairs = pairs.where(F.greatest(n0, n1) > d)  # the others have no mass
    of_contexts = pairs.groupBy("v").agg(m0.alias("m0"), m1.alias("m1"), beyond.alias("beyond")).where("m0 > 0 and m1 > 0")
    started = lexicon.select(F.col("key").alias("v"), sum((F.col(a) for a in AFTER), F.lit(0)).alias("t"))
    of_contexts = of_contexts.join(started, "v").select("v", "m0", "m1", ((F.col("t") - F.col("beyond")) / F.col("t")).alias("g")).where("g > 0")
    own = pairs.select("key", "v", "w", n0.alias("n0"), n1.alias("n1"), uses)
    own = own.join(of_contexts, "v").join(of_words.drop("uses", "told"), "w")
    q = [(1 - F.col("g")) * above(F.col(f"n{c}")) / F.col(f"m{c}") + F.col("g") * F.col(f"p{c}") for c in (0, 1)]
    told = of_words.where("told").select(F.col("w").alias("key"), (F.log("p1") - F.log("p0")).cast("float").alias("x"), "uses")
    return materialise(told.union(own.select("key", (F.log(q[1]) - F.log(q[0])).cast("float").alias("x"), "uses")))


def _hold(model: ToxicityModel, table: DataFrame | None) -> None:
    if table is None:
        return
    if table.count() > HELD:
        least = _least(table, "uses", HELD)
        model.rest = table.where(F.col("uses") < least).select("key", "x")
        model.marks = _marks(model.rest)
        table = table.where(F.col("uses") >= least)
    held = table.select("key", "x").toPandas()
    keys = held["key"].to_numpy(np.int64).view(np.uint64)
    model.keys, first = np.unique(keys, return_index=True)
    model.values = held["x"].to_numpy(np.float32)[first]


def _wanted(df: DataFrame, text_col: str, block: str, marks: np.ndarray, held: np.ndarray) -> DataFrame:
    """block and key of the distinct words and pairs of its texts that have a mark and are not held."""
    shared = df.sparkSession.sparkContext.broadcast((marks, ToxicityModel(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, model = shared.value
        found, size = [], 0

        def flush() -> pa.RecordBatch:
            blocks, keys = (np.concatenate(c) for c in zip(*found, strict=True))
            once = distinct(mix(keys) + mix(blocks))
            once = once[np.argsort(keys[once])]  # neighbours alike: shuffled files get smaller
            return pa.RecordBatch.from_arrays([pa.array(blocks[once].astype(np.int32)), pa.array(keys[once].view(np.int64))], ["block", "key"])

        for batch in batches:
            for part in slices(batch, text_col):
                hashes, before, bounds = expressions(texts_of(part, text_col))
                keys = np.concatenate([hashes, before, pair_key(before, hashes)])
                blocks = np.tile(np.repeat(part.column(block).to_numpy().astype(np.uint64), np.diff(bounds)), 3)
                once = distinct(mix(keys) + mix(blocks))
                once = once[marked(bits, keys[once])]
                once = once[model.places.get_indexer(keys[once]) < 0]
                found.append((blocks[once], keys[once]))
                size += len(once)
                if size > 2_000_000:
                    yield flush()
                    found, size = [], 0
        if found:
            yield flush()

    return df.select(block, text_col).mapInArrow(run, "block int, key bigint")


def _sampled_features(rows: DataFrame, share: float, lexicon: DataFrame, pairs: DataFrame, base: np.ndarray, contexts: float) -> tuple[np.ndarray, np.ndarray]:
    """Features under each discount, and labels, of rows drawn by their texts' hashes."""
    drawn = F.xxhash64("text")
    if share < 1:
        rows = rows.where(F.pmod(drawn, F.lit(1 << 30)) < int(share * (1 << 30)))
    block = (F.col("fold") * FIT_BLOCKS + F.pmod(drawn, F.lit(FIT_BLOCKS))).cast("int").alias("block")
    rows = materialise(rows.select("text", "toxic", "fold", block).repartition(FOLDS * FIT_BLOCKS, "block"))
    known = pairs.where(F.greatest(_in_class(0), _in_class(1)) >= LEAST_COUNT)
    marks = _marks(known.select("key").union(lexicon.select("key")))
    wanted = _wanted(rows, "text", "block", marks, np.zeros(0, np.uint64))
    follows = F.when(F.col("key") != START, F.col("follows")).alias("follows")
    of_words = lexicon.join(_contexts(known), "key", "left").select("key", *COUNTS, follows, *AFTER, "masses")
    none = [F.lit(None).cast(of_words.schema[c].dataType).alias(c) for c in ("follows", *AFTER, "masses")]
    found = wanted.join(of_words.union(known.select("key", *COUNTS, *none)), "key")
    fold = F.floor(F.col("block") / FIT_BLOCKS).cast("int")

    def others(names: list[str]) -> Column:
        return sum((F.when(fold != f, F.col(n)).otherwise(0) for f, n in enumerate(names)), F.lit(0))

    n = [others(COUNTS[c * FOLDS : (c + 1) * FOLDS]).alias(f"n{c}") for c in (0, 1)]
    found = found.select("block", "key", *n, "follows", others(AFTER).alias("t"), F.element_at("masses", fold).alias("masses"))

    def run(texts: pa.Table, entries: pa.Table) -> pa.Table:
        keys = entries.column("key").to_numpy().view(np.uint64)
        keys, first = np.unique(keys, return_index=True)
        entries = entries.take(pa.array(first))
        if not len(keys):
            return _rows_of(texts.column("toxic").combine_chunks(), np.zeros((texts.num_rows, len(DISCOUNTS) * (len(SPANS) + 1))))
        fold = texts.column("fold")[0].as_py()
        n = np.array([entries.column(f"n{c}").to_numpy() for c in (0, 1)], np.float64)
        is_word, is_context = (entries.column(c).is_valid().to_numpy() for c in ("follows", "masses"))
        lexicon, follows, n_word = keys[is_word], entries.column("follows").drop_null().to_numpy(), n[:, is_word]
        started, own = keys[is_context], entries.filter(pa.array(is_context))
        mass = np.zeros((len(started), len(DISCOUNTS), 3))
        if len(started):
            mass[:] = own.column("masses").combine_chunks().flatten().to_numpy().reshape(mass.shape)
            t = np.maximum(own.column("t").to_numpy(), 1.0)[:, None]
            mass[:, :, 2] = (t - mass[:, :, 2]) / t
        by_class, by_word = [], []
        for k, d in enumerate(DISCOUNTS):
            m0, m1, g = base[fold, k]
            above = np.maximum(n_word - d, 0)
            p = (1 - g) * above / np.array([[m0], [m1]]) + g * follows / contexts if m0 and m1 else np.ones_like(above)
            by_class.append(p)
            by_word.append(np.log(p[1]) - np.log(p[0]))
        started, lexicon, entered = pd.Index(started), pd.Index(lexicon), pd.Index(keys)
        out = []
        for batch in texts.to_batches():
            for part in slices(batch, "text"):
                hashes, before, bounds = expressions(texts_of(part, "text"))
                v, w, pair = started.get_indexer(before), lexicon.get_indexer(hashes), entered.get_indexer(pair_key(before, hashes))
                known, paired = np.flatnonzero(w >= 0), np.flatnonzero((w >= 0) & (v >= 0) & (pair >= 0))
                features = np.zeros((part.num_rows, len(DISCOUNTS), len(SPANS) + 1))
                for k, d in enumerate(DISCOUNTS):
                    if not base[fold, k, :2].all():
                        continue
                    p, value = by_class[k], np.zeros(len(hashes))
                    value[known] = by_word[k][w[known]]
                    at = paired[(mass[v[paired], k] > 0).all(axis=1)]
                    m, above = mass[v[at], k], np.maximum(n[:, pair[at]] - d, 0)
                    q = [(1 - m[:, 2]) * above[c] / m[:, c] + m[:, 2] * p[c][w[at]] for c in (0, 1)]
                    value[at] = np.log(q[1]) - np.log(q[0])
                    features[:, k] = spans(value, bounds)
                out.append(features.reshape(part.num_rows, -1))
        return _rows_of(texts.column("toxic").combine_chunks(), np.concatenate(out))

    grouped = rows.groupBy("block").cogroup(found.groupBy("block"))
    found = grouped.applyInArrow(run, "toxic int, x array<double>").toPandas()
    if found.empty:
        return np.zeros((len(DISCOUNTS), 0, len(SPANS) + 1)), np.zeros(0)
    x = np.array(found["x"].tolist()).reshape(len(found), len(DISCOUNTS), -1).transpose(1, 0, 2)
    return x, found["toxic"].to_numpy(np.float64)


def _rows_of(toxic: pa.Array, x: np.ndarray) -> pa.Table:
    return pa.table({"toxic": toxic, "x": pa.array(list(x), pa.list_(pa.float64()))})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights (the bias last) by damped Newton steps, and the mean loss."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-9

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (penalty * v * v).sum()) if len(y) else 0.0

    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) / len(y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty + 1e-9)
        step, size, now = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w, loss(w)


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str, score_col: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``df`` and the score: in one narrow pass if tasks hold all
    entries of the model, else in blocks of texts to which the other entries are joined."""
    keep = df.columns if keep is None else keep
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep or c == text_col])
    marks, rest, held = model.marks, model.rest, ToxicityModel(model.keys, model.values, model.weights, model.bias, model.discount)
    shared = df.sparkSession.sparkContext.broadcast(held)

    def scored(batches: Iterator[pa.RecordBatch], keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = shared.value
        # The last value is read for a key that has no place.
        entries = [(k, np.append(x, np.float32(0))) for k, x in ((m.places, m.values), (pd.Index(keys), values)) if len(k)]

        def look_up(wanted: np.ndarray, value: np.ndarray) -> None:
            for own, x in entries:
                at = own.get_indexer(wanted)
                np.copyto(value, x[at], where=at >= 0)

        for batch in batches:
            for part in slices(batch, text_col):
                hashes, before, bounds = expressions(texts_of(part, text_col))
                value = np.zeros(len(hashes))
                look_up(hashes, value)
                look_up(pair_key(before, hashes), value)
                score = pa.array(m.score(spans(value, bounds)), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], score], [*keep, score_col])

    schema = StructType([*[df.schema[c] for c in keep], StructField(score_col, DoubleType())])
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    if rest is None:
        return df.mapInArrow(lambda batches: scored(batches, *none), schema)
    chars = df.agg(F.sum(F.length(text_col))).first()[0] or 0
    # By all columns, or the copies of one text would lie in one block.
    spread = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map" not in f.dataType.simpleString()])
    block = "__block"
    dealt = df.withColumn(block, F.pmod(spread, F.lit(1 + chars // BLOCK_CHARS)).cast(IntegerType()))
    found = _wanted(dealt, text_col, block, marks, model.keys).join(rest, "key")

    def run(texts: pa.Table, entries: pa.Table) -> pa.Table:
        keys, first = np.unique(entries.column("key").to_numpy().view(np.uint64), return_index=True)
        values = entries.column("x").to_numpy()[first].astype(np.float32)
        texts = texts.drop_columns([block])
        parts = list(scored(texts.to_batches(), keys, values))
        return pa.Table.from_batches(parts)

    return dealt.groupBy(block).cogroup(found.groupBy("block")).applyInArrow(run, schema)
