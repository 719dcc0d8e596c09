"""Scoring texts with a log-bilinear model trained in numpy by noise-contrastive estimation.

Words fall into classes: the end, each of the most frequent words, and the rest by their shape. The log-bilinear model
gives the class of a token after the classes of the two before it, normalised over all classes by batched matrix
products. Within a class of many words a second one gives the word after the class before it, normalised over the
class: each word with enough occurrences has a vector of its own, the rest of the class has one together, and is parted
by smoothed shares of counts. Counts of all words, of all class triples and of all pairs of a class and a word come from
the whole training corpus. Counts of frequent words go out to the tasks in a table of bounded size; a rare word's count
meets its documents in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, written
from .textarrays import FOLD, buffers, hashes, words

#: Frequent words with a class of their own.
TOP = 60
#: Words in the table of counts that goes to the tasks, at most.
TABLE = 400_000
CLASSES = 128
WIDTH = 24
NOISE = 10
#: Words of shared classes with vectors of their own: those that occur so often, the most frequent up to a number that
#: bounds the table of words after classes (4 MB; a word more costs a column, whatever the corpus).
OFTEN, OWN_WORDS = 50, 8_192
#: Passes over the counts of all triples, and of all pairs of a class and a word.
STEPS, WORD_STEPS = 300, 200
RATE = 0.05
#: First classes of contexts in a part of a pass.
PART = 16
#: Tokens that a task holds before it counts them.
HELD = 2_000_000

END_HASH = 0x1F2E3D4C5B6A7988
END_CLASS = 0
_SHAPES = 60

_KIND = np.zeros(256, np.uint8)  # bits that tell which bytes a word has
_KIND[161:192] = [1 << (b & 3) for b in range(161, 192)]
_LAST = np.zeros(256, np.uint8)
_LAST[list(b".!?")], _LAST[list(b",;:")] = 1, 2
_LAST[[b for b in range(33, 128) if not chr(b).isalnum() and _LAST[b] == 0]] = 3


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, class by shape from 0) of each token of a column, an end after each text's words."""
    data, offsets = buffers(column)
    data = FOLD[data]
    n = len(offsets) - 1
    of, start, end = words(data, offsets)
    if len(of):
        value = hashes(data, start, end)
        kinds = np.bitwise_or.reduceat(_KIND[data], start)
        low = np.where(kinds & 1, 1, np.where(kinds & 2, 2, np.where(kinds & 4, 3, np.where(kinds & 8, 4, 0))))
        size = end - start
        shape = (low * 4 + _LAST[data[end - 1]]) * 3 + (size > 4) + (size > 8)
    else:
        value, shape = np.empty(0, np.uint64), np.empty(0, np.int64)
    last = np.cumsum(np.bincount(of, minlength=n) + 1) - 1
    total = len(of) + n
    word = np.ones(total, bool)
    word[last] = False
    text, out, shapes = np.repeat(np.arange(n), np.diff(np.concatenate([[-1], last]))), np.full(total, END_HASH, np.uint64), np.full(total, -1, np.int64)
    out[word], shapes[word] = value, shape
    return text, out, shapes


@dataclass
class Vocabulary:
    """Frequent words: hashes in order, their counts and classes. Classes from 1 are words, then come the shapes.

    slots: the number of a word with a vector in its shape, else -1; after all words come the rests of the shapes.
    shape_of: the shape of each such word.
    """

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    slots: np.ndarray
    shape_of: np.ndarray

    def slot(self, row: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The slot of each token; -1 for those that are classes of their own."""
        own = self.slots[row] if len(self.slots) else np.full(len(row), -1)
        own = np.where((row >= 0) & (own >= 0), own, len(self.shape_of) + shape)
        alone = (shape < 0) if not len(self.classes) else (shape < 0) | (row >= 0) & (self.classes[row] > 0)
        return np.where(alone, -1, own)

    @property
    def members(self) -> np.ndarray:
        """The shape of each slot."""
        return np.concatenate([self.shape_of, np.arange(_SHAPES)])

    def look_up(self, value: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row or -1, class) of each token."""
        if not len(self.hashes):
            return np.full(len(value), -1), np.where(shape < 0, END_CLASS, 1 + TOP + shape)
        row = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        row = np.where(self.hashes[row] == value, row, -1)
        own = np.where(row >= 0, self.classes[row], 0)
        return row, np.where(shape < 0, END_CLASS, np.where(own > 0, own, 1 + TOP + shape))


@dataclass
class LogBilinear:
    """score(class | a, b) = (first[a] + second[b]) . out[class] + bias[class], for the classes a, b just before."""

    first: np.ndarray
    second: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, rows: int = 4096) -> np.ndarray:
        """Normalised log10 probabilities, [before, just before, class], in batches of contexts."""
        n = len(self.bias)
        table = np.empty((n * n, n), np.float32)
        for at in range(0, n * n, rows):
            pair = np.arange(at, min(n * n, at + rows))
            s = (self.first[pair // n] + self.second[pair % n]) @ self.out.T + self.bias
            s -= s.max(axis=1, keepdims=True)
            table[pair] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)
        return table.reshape(n, n, n)


def train(triples: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = 0) -> LogBilinear:
    """Noise-contrastive estimation; the noise is the classes' shares.

    Each step is a pass over all triples with their counts, and the noise counts with its expectation: nothing is drawn,
    and a step's cost depends on the number of classes alone.
    """
    rng = np.random.default_rng(seed)
    share = np.bincount(triples[:, 2], counts, CLASSES) + 0.5 if len(triples) else np.ones(CLASSES)
    share = share / share.sum()
    model = LogBilinear(*(rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32) for _ in range(3)), np.log(share).astype(np.float32))
    if not len(triples):
        return model
    true = np.zeros((CLASSES, CLASSES, CLASSES), np.float32)
    np.add.at(true, tuple(triples.T), counts / counts.sum())
    noise, log_noise = (NOISE * share).astype(np.float32), np.log(NOISE * share).astype(np.float32)
    total = true.sum(axis=2, keepdims=True)
    parts = [model.first, model.second, model.out, model.bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    for step in range(1, steps + 1):
        grads = [np.zeros_like(p) for p in parts]
        for at in range(0, CLASSES, PART):
            own = slice(at, at + PART)
            context = (model.first[own, None] + model.second).reshape(-1, WIDTH)
            seen = true[own].reshape(-1, CLASSES)
            g = context @ model.out.T + (model.bias - log_noise)
            g = (seen + total[own].reshape(-1, 1) * noise) / (1 + np.exp(-np.clip(g, -60, 60))) - seen
            g_context = (g @ model.out).reshape(-1, CLASSES, WIDTH)
            grads[0][own] = g_context.sum(axis=1)
            grads[1] += g_context.sum(axis=0)
            grads[2] += g.T @ context
            grads[3] += g.sum(axis=0)
        rate = RATE * (1 - 0.9 * step / steps)
        for p, g, m in zip(parts, grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    return model


@dataclass
class Words:
    """score(word | class before) = after[class before] . out[word] + bias[word], among the words of one shape."""

    after: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    members: np.ndarray

    def log_probabilities(self) -> np.ndarray:
        """Log10 probabilities, [class before, slot], normalised over the slots of each shape."""
        s = (self.after @ self.out.T + self.bias).astype(np.float64)
        total = np.zeros((len(self.after), _SHAPES))
        most = np.full((len(self.after), _SHAPES), -np.inf)
        np.maximum.at(most.T, self.members, s.T)
        np.add.at(total.T, self.members, np.exp(s - most[:, self.members]).T)
        return ((s - (most + np.log(total))[:, self.members]) / np.log(10)).astype(np.float32)


def train_words(pairs: np.ndarray, counts: np.ndarray, members: np.ndarray, steps: int = WORD_STEPS, seed: int = 1) -> Words:
    """Noise-contrastive estimation within each shape, by whole passes over all pairs (class before, slot).

    The noise of a shape is the shares of its slots; it counts with its expectation.
    """
    rng = np.random.default_rng(seed)
    share = np.bincount(pairs[:, 1], counts, len(members)) + 0.5 if len(pairs) else np.full(len(members), 0.5)
    share = share / np.bincount(members, share, _SHAPES)[members]
    model = Words(rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32), np.zeros((len(members), WIDTH), np.float32), np.log(share).astype(np.float32), members)
    if not len(pairs):
        return model
    true = np.zeros((CLASSES, len(members)), np.float32)
    true[pairs[:, 0], pairs[:, 1]] = counts / counts.sum()
    total = np.zeros((CLASSES, _SHAPES), np.float32)
    np.add.at(total.T, members, true.T)
    weight, log_noise = true + total[:, members] * (NOISE * share).astype(np.float32), np.log(NOISE * share).astype(np.float32)
    parts = [model.after, model.out, model.bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    for step in range(1, steps + 1):
        g = model.after @ model.out.T
        g += model.bias - log_noise
        np.clip(g, -60, 60, out=g)
        np.exp(-g, out=g)
        g += 1
        np.divide(weight, g, out=g)
        g -= true
        rate = RATE * (1 - 0.9 * step / steps)
        for p, d, m in zip(parts, (g @ model.out, g.T @ model.after, g.sum(axis=0)), moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.999 * m[1] + 0.001 * d * d
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    return model


def _counted(keys: list[np.ndarray], more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, first, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
    return key, np.concatenate(more)[first], n


@dataclass
class Model:
    vocabulary: Vocabulary
    language: LogBilinear
    words: Words
    counts: DataFrame  # hash, shape, n of every token of the training corpus, written
    total: int
    distinct: int
    log_rest: np.ndarray  # log10 of the smoothed total of each shape's words without vectors


def learn(docs: DataFrame, text_col: str = "text", use: Column | None = None, table: int = TABLE, steps: int = STEPS, often: int = OFTEN, own_words: int = OWN_WORDS) -> Model:
    """The model from all rows where `use` holds (a null is not)."""
    rows = docs if use is None else docs.where(use)
    rows = rows.select(F.lit(0).alias("k"), text_or_empty(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shapes, held = [], [], 0
        for batch in slices(batches):
            _, value, shape = tokens(batch.column(1))
            keys.append(value)
            shapes.append(shape)
            held += len(value)
            if held > HELD:
                yield _batch(*_counted(keys, shapes))
                keys, shapes, held = [], [], 0
        if keys:
            yield _batch(*_counted(keys, shapes))

    def _batch(key: np.ndarray, shape: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(n)], names=["hash", "shape", "n"])

    counts = written(rows.mapInArrow(count, "hash long, shape int, n long").groupBy("hash").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")), "counts")
    end = END_HASH  # fits a signed long
    words_only = counts.where(F.col("hash") != end)
    by_shape = {r["shape"]: (r["t"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect()}
    total, distinct = sum(t for t, _ in by_shape.values()), sum(v for _, v in by_shape.values())
    top = words_only.orderBy(F.desc("n"), "hash").limit(TOP).collect()
    vocabulary = _frequent(counts, top, table, often, own_words)
    held = np.flatnonzero(vocabulary.slots >= 0)
    taken = [(r["shape"], r["n"]) for r in top] + list(zip(vocabulary.shape_of[vocabulary.slots[held]].tolist(), vocabulary.counts[held].tolist(), strict=True))
    gone, kinds = np.zeros(_SHAPES), np.zeros(_SHAPES)
    for shape, n in taken:
        gone[shape] += n
        kinds[shape] += 1
    log_rest = np.log10([by_shape.get(k, (0, 0))[0] - gone[k] + 0.5 * (by_shape.get(k, (0, 0))[1] - kinds[k] + 1) for k in range(_SHAPES)])
    members = vocabulary.members
    spread = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def triple(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES**3 + CLASSES * len(members), np.int64)
        for batch in slices(batches):
            _, value, shape = tokens(batch.column(1))
            row, kind = spread.value.look_up(value, shape)
            slot = spread.value.slot(row, shape)
            pair = CLASSES**3 + _before(kind) * len(members) + slot
            at, n = np.unique(np.concatenate([_codes(kind), pair[slot >= 0]]), return_counts=True)
            seen[at] += n
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], names=["code", "n"])

    seen = written(rows.mapInArrow(triple, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "triples")

    def trained(first: int, last: int, *sizes: int):
        """Codes from first to last as columns of digits, and their counts; one kind at a time is on the driver."""
        got = seen.where((F.col("code") >= first) & (F.col("code") < last)).select((F.col("code") - first).cast("int").alias("code"), F.col("n").cast("double").alias("n")).toArrow()
        code, digits = got["code"].to_numpy(), []
        for size in reversed(sizes):
            digits.insert(0, code % size)
            code = code // size
        return np.column_stack(digits), got["n"].to_numpy()

    language = train(*trained(0, CLASSES**3, CLASSES, CLASSES, CLASSES), steps)
    own = train_words(*trained(CLASSES**3, CLASSES**3 + CLASSES * len(members), CLASSES, len(members)), members)
    return Model(vocabulary, language, own, counts, total, distinct, log_rest)


def _before(kind: np.ndarray) -> np.ndarray:
    """The class of the token before each; before a text's first there is an end."""
    return np.concatenate([[END_CLASS], kind[:-1]])[: len(kind)]


def _codes(kind: np.ndarray) -> np.ndarray:
    """A number for each token and the two before it; before a text's first there are ends."""
    one = _before(kind)
    two = np.concatenate([[END_CLASS, END_CLASS], kind[:-2]])[: len(kind)]
    two = np.where(one == END_CLASS, END_CLASS, two)
    return (two * CLASSES + one) * CLASSES + kind


def _frequent(counts: DataFrame, top: list, table: int, often: int, own_words: int) -> Vocabulary:
    """The words with the highest counts: all with at least the count that keeps their number to `table`, and those that are classes. Of those that
    have no class of their own, the ones that occur `often` get slots, own_words at most."""
    sizes = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("v")).orderBy(F.desc("n"))
    least, held = (1 << 20) + 1, 0
    for r in sizes.toLocalIterator():
        if held + r["v"] > table:
            break
        least, held = r["n"], held + r["v"]
    always = F.col("hash").isin([END_HASH, *(r["hash"] for r in top)])  # the end and the words that are classes
    got = counts.where((F.col("n") >= least) | always).select("hash", "n", "shape").toPandas()
    known, n = np.ascontiguousarray(got["hash"].to_numpy(np.int64)).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(known)
    known, n, shape = known[order], n[order], got["shape"].to_numpy(np.int64)[order]
    classes = np.zeros(len(known), np.int16)
    for k, r in enumerate(top):
        place = np.searchsorted(known, np.uint64(r["hash"] & (1 << 64) - 1))
        if place < len(known) and known[place] == np.uint64(r["hash"] & (1 << 64) - 1):
            classes[place] = k + 1
    slots = np.full(len(known), -1, np.int32)
    free = np.flatnonzero((classes == 0) & (shape >= 0) & (n >= often))
    chosen = free[np.argsort(-n[free], kind="stable")[:own_words]]
    slots[chosen] = np.arange(len(chosen))
    return Vocabulary(known, n, classes, slots, shape[chosen])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score): a row for each row of docs.

    A null or empty text is its end alone. base_score is the log10 probability under the smoothed counts of single
    tokens, score under the model. Repeated rows come back as often. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    spread = spark.sparkContext.broadcast((model.vocabulary, model.language, model.words, model.log_rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, language, own_words, log_rest = spread.value
        table, word_table = language.log_probabilities().ravel(), own_words.log_probabilities()
        held = len(vocabulary.shape_of)
        log_count = np.log10(vocabulary.counts + 0.5) if len(vocabulary.counts) else np.zeros(1)
        for batch in slices(batches):
            n = batch.num_rows
            text, value, shape = tokens(batch.column(1))
            row, kinds = vocabulary.look_up(value, shape)
            logs = np.where(row >= 0, log_count[row], 0.0)
            slot = vocabulary.slot(row, shape)
            own = table[_codes(kinds)].astype(np.float64) + np.where(slot >= 0, word_table[_before(kinds), slot], 0.0)
            own += np.where(slot >= held, logs - log_rest[np.maximum(shape, 0)], 0.0)
            rare = np.flatnonzero(row < 0)
            cut = np.searchsorted(text[rare], np.arange(n + 1)).astype(np.int32)
            yield pa.record_batch([
                batch.column(0), pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text, row >= 0, n).astype(np.int64)),
                pa.array(np.bincount(text, logs, n)), pa.array(np.bincount(text, own, n)), pa.ListArray.from_arrays(pa.array(cut), pa.array(value[rare].view(np.int64))),
            ], names=[id_col, "n_tokens", "n_known", "base", "own", "rare"])

    fields = f"`{id_col}` {kind}, n_tokens long, n_known long, base double, own double, rare array<long>"
    held = written(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id()), "scored")
    # A rare token's count comes by its hash. Its document's own figures don't travel: they are joined at the end.
    rare = held.select("row", F.explode("rare").alias("hash")).groupBy("row", "hash").agg(F.count("*").alias("times"))
    logs = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    met = rare.join(model.counts.select("hash", "n"), "hash", "left")
    sums = met.groupBy("row").agg(F.sum(logs * F.col("times")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"))
    whole = held.select(id_col, "n_tokens", "n_known", "base", "own", F.col("row").alias("of")).join(sums, F.col("of") == F.col("row"), "left")
    more = F.coalesce("more", F.lit(0.0))
    norm = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return whole.select(
        id_col, "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("own") + more).alias("score"),
    )
