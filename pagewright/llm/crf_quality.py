"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features and those of its neighbours score the two labels, transitions score adjacent
ones; a document's label stands for all its lines in training. A document's quality is the mean of its lines'
forward-backward marginals, weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .textarrays import buffers, hashes, lines, words

#: Labelled documents that are learned from, in the mean at most, and lines in a row of each of them.
SAMPLE_ROWS, SAMPLE_LINES = 6000, 400
EPOCHS = 12
RATE = 0.05
DECAY = 1e-4
#: Documents in a training step, and steps at least; a small sample gets more epochs.
STEP = 128
STEPS = 400

# Classes of bytes: 0 other, 1 a-z, 2 A-Z, 3 digits, 4 blanks, 5 marks of prose, 6 exclamation, 7 symbols, 8 from 0x80.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[9, 11, 12, 13, 32]] = 4
for _marks, _at in ((b".,;:'\"?()-", 5), (b"!", 6), (b"#*$%&|<>~^_=+@\\/{}[]`", 7)):
    _CLASS[list(_marks)] = _at
_KINDS = 9
#: Features of a line itself.
OWN = 23


#: Lines and bytes of lines whose features are held at a time, at most (one line is never cut).
PART_LINES, PART_BYTES = 1 << 15, 1 << 19


def _parts(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lines of bounded number and size."""
    at, n = 0, len(start)
    while at < n:
        to = max(at + 1, min(at + PART_LINES, int(np.searchsorted(end, start[at] + PART_BYTES, "right"))))
        yield at, min(to, n)
        at = min(to, n)


def own_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first line, features of the lines themselves), part by part. What lines need of those before is handed on."""
    text, start, end = lines(data, offsets)
    n = len(text)
    value = np.empty(n, np.uint64)
    for i, j in _parts(start, end):
        part = data[start[i] : end[j - 1]]
        value[i:j] = hashes(part, start[i:j] - start[i], end[i:j] - start[i])
    first = np.zeros(n, bool)
    first[np.unique(value ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]] = True
    held = np.empty(0, np.int64), np.empty(0, np.uint64)  # text and hash of the last two words
    for i, j in _parts(start, end):
        part, low, high, of = data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i], text[i:j]
        size = high - low
        kinds = np.repeat(np.arange(j - i), size) * _KINDS
        counts = np.bincount(kinds + _CLASS[part[part != 10]], minlength=(j - i) * _KINDS).reshape(j - i, _KINDS).astype(np.float64)
        share = counts / np.maximum(size, 1)[:, None]
        letters = counts[:, 1] + counts[:, 2] + counts[:, 8]
        blanks = counts[:, 4]
        last = part[np.maximum(high - 1, 0)] if len(part) else np.zeros(j - i, np.uint8)
        own = np.zeros((j - i, OWN))
        own[:, 0] = np.log1p(size) / 5
        own[:, 1:9] = share[:, 1:9] * np.array([1, 3, 5, 3, 8, 8, 8, 3])
        own[:, 9] = np.log1p(blanks) / 3
        own[:, 10] = np.log1p(size / (blanks + 1)) / 2
        own[:, 11] = (size > 0) & np.isin(last, list(b".!?"))
        own[:, 12] = ~first[i:j] & (size > 0)
        own[:, 13] = counts[:, 2] > 0.5 * np.maximum(letters, 1)
        own[:, 14] = share[:, 7] > 0.03
        own[:, 15] = share[:, 6] > 0.03
        own[:, 16] = size == 0
        own[:, 17] = share[:, 5] < 0.002
        own[:, 18] = size < 25
        own[:, 19] = share[:, 3] > 0.1
        own[:, 20:23], held = _repeats(part, of, low, held)
        yield i, own


def _repeats(data: np.ndarray, text: np.ndarray, start: np.ndarray, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each line: shares of words equal to the word before and to the one before that, and if the first is large.

    before: text and hash of the two words that stand before these lines; those of the last two come back.
    """
    n = len(text)
    out = np.zeros((n, 3))
    heads = np.append(np.flatnonzero(np.append(True, text[1:] != text[:-1])), n)
    _, first, last = words(data, np.append(start, len(data))[heads])
    if not len(first):
        return out, before
    # lines that begin at one place are empty but for the last of them
    line = np.searchsorted(start, first, "right") - 1
    total = np.maximum(1, np.bincount(line, minlength=n))
    of, value = np.concatenate([before[0], text[line]]), np.concatenate([before[1], hashes(data, first, last)])
    line = np.concatenate([np.full(len(before[0]), -1), line])
    for k in (1, 2):
        same = np.flatnonzero((value[k:] == value[:-k]) & (of[k:] == of[:-k]) & (line[k:] >= 0)) + k
        out[:, k - 1] = np.bincount(line[same], minlength=n) / total
    out[:, 2] = out[:, 0] > 0.2
    return out, (of[-2:], value[-2:])


def features(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each line, weight, features with those of both neighbours and a constant).

    most: of a text with more lines, as many in a row are taken, from a place that depends on the text's size.
    """
    text, start, end = lines(data, offsets)
    size = end - start
    head = np.append(True, text[1:] != text[:-1])[: len(text)]
    tail = np.append(text[1:] != text[:-1], True)[: len(text)]
    count = np.bincount(text, minlength=len(offsets) - 1)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    spare = count - (most or max(1, len(text)))
    begin = np.where(spare > 0, np.diff(offsets) * 2654435761 % np.maximum(1, spare + 1), 0)
    chosen = (place >= begin[text]) & (place < begin[text] + most) if most else np.ones(len(text), bool)
    beside = chosen.copy()
    beside[:-1] |= chosen[1:]
    beside[1:] |= chosen[:-1]
    kept = [own[beside[at : at + len(own)]] for at, own in own_features(data, offsets)]
    own = np.concatenate(kept) if kept else np.zeros((0, OWN))
    row = np.cumsum(beside) - 1
    near = lambda edge, step: np.where(edge[chosen][:, None], 0, own[np.clip(row[chosen] + step, 0, max(0, len(own) - 1))])
    edges = np.column_stack([head, tail, np.ones(len(text))]).astype(np.float64)[chosen]
    return text[chosen], np.maximum(size, 1)[chosen], np.concatenate([own[row[chosen]], near(head, -1), near(tail, 1), edges], axis=1)


def line_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, weight, features times weights) of each line; the features of a part of the lines are held at a time."""
    text, start, end = lines(data, offsets)
    n = len(text)
    by = weights[: 3 * OWN].reshape(3, OWN).T  # of the line itself, as the line before, as the line after
    sums = np.empty((n, 3))
    for at, own in own_features(data, offsets):
        sums[at : at + len(own)] = own @ by
    same = text[1:] == text[:-1]
    score = sums[:, 0] + weights[-1]
    score[1:] += np.where(same, sums[:-1, 1], weights[-3])
    score[:-1] += np.where(same, sums[1:, 2], weights[-2])
    if n:
        score[0] += weights[-3]
        score[-1] += weights[-2]
    return text, np.maximum(end - start, 1), score


WIDTH = 3 * OWN + 3


@dataclass
class Field:
    """weights: score of good against bad for a line's features. moves[y, z]: score of label z after y."""

    weights: np.ndarray
    moves: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        return cls(np.zeros(WIDTH), np.zeros((2, 2)))


def _order(count: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents longest first, the first line of each, and how many have a line number k."""
    place = np.argsort(-count, kind="stable")
    start = begin[place]
    alive = np.searchsorted(-count[place], -np.arange(1, (count.max() if len(count) else 0) + 1), "right")
    return place, start, alive


#: Lines from which on a document's chain is folded in blocks.
LONG = 1024


def chains(score: np.ndarray, count: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of good at each line; count: lines of each document, in order.

    forward includes the line's own score, backward does not: their sum is the marginal's log odds. Documents go line by
    line side by side, those with many lines one by one in blocks.
    """
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    begin = np.cumsum(count) - count
    for k in np.flatnonzero(count > LONG):
        own = slice(begin[k], begin[k] + count[k])
        forward[own] = _folded(score[own], moves)
        backward[own] = _folded(score[own][::-1], moves.T)[::-1] - score[own]
    _, start, alive = _order(np.where(count > LONG, 0, count), begin)
    for k, n in enumerate(alive):
        at = start[:n] + k
        f = score[at]
        if k:
            g = forward[at - 1]
            f = f + np.logaddexp(moves[0, 1], g + moves[1, 1]) - np.logaddexp(moves[0, 0], g + moves[1, 0])
        forward[at] = f
    for k in range(len(alive) - 2, -1, -1):
        at = start[: alive[k + 1]] + k
        g = score[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(moves[1, 0], g + moves[1, 1]) - np.logaddexp(moves[0, 0], g + moves[0, 1])
    return forward, backward


def _folded(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward log odds of one long chain: products of 2 x 2 matrices within blocks side by side, then from block to block."""
    n = len(score)
    size = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // size)
    s = np.zeros(blocks * size)
    s[:n] = np.clip(score, -300, 300)
    s = s.reshape(blocks, size)
    low, high = np.exp(np.minimum(-s, 0)), np.exp(np.minimum(s, 0))  # a label's factor; the larger is 1
    move = np.exp(moves - moves.max())
    whole = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(size):
        whole = whole @ move
        whole[:, :, 0] *= low[:, t, None]
        whole[:, :, 1] *= high[:, t, None]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    at = np.empty((blocks, 2))
    at[0] = 1.0
    state = np.array([1.0, 1.0])
    for t in range(size):  # no line stands before the first: its block begins without a move
        state = (state if t == 0 else state @ move) * (low[0, t], high[0, t])
        state = state / state.max()
    for k in range(1, blocks):
        at[k] = state
        state = state @ whole[k]
        state = state / state.max()
    out = np.empty((blocks, size))
    for t in range(size):
        at = at @ move
        if t == 0:
            at[0] = 1.0
        at[:, 0] *= low[:, t]
        at[:, 1] *= high[:, t]
        at /= at.max(axis=1, keepdims=True)
        out[:, t] = np.log(at[:, 1]) - np.log(at[:, 0])
    return out.ravel()[:n]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(x: np.ndarray, count: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Field:
    """Maximum conditional likelihood of the labels, by Adam over steps of whole documents."""
    out = Field.blank()
    if not len(count):
        return out
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-STEPS // max(1, len(count) // STEP)))
    start = np.cumsum(count) - count
    first, second, t = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(count)), max(1, len(count) // STEP)):
            n = count[part]
            rows = np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, want = x[rows], np.repeat(label[part], n).astype(np.float64)
            score = own @ out.weights
            forward, backward = chains(score, n, out.moves)
            each = np.repeat(1 / n, n) / len(part)  # a document counts as much as another, however many lines it has
            slope = own.T @ ((_sigmoid(forward + backward) - want) * each)
            follows = np.ones(len(rows), bool)
            follows[np.cumsum(n) - n] = False
            to = np.flatnonzero(follows)
            pair = np.zeros((len(to), 2, 2)) + out.moves
            pair[:, 1, :] += forward[to - 1][:, None]
            pair[:, :, 1] += (score + backward)[to][:, None]
            pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            move = np.einsum("k,kij->ij", each[to], pair) if len(to) else np.zeros((2, 2))
            same = np.bincount(want[to].astype(np.int64), each[to], 2) if len(to) else np.zeros(2)
            move[0, 0] -= same[0]
            move[1, 1] -= same[1]
            grad = np.concatenate([slope + DECAY * out.weights, (move + 0.01 * out.moves).ravel()])
            t += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            step = RATE * (1 - epoch / epochs) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            out.weights = out.weights - step[:WIDTH]
            out.moves = out.moves - step[WIDTH:].reshape(2, 2)
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", use: Column | None = None, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, sample_lines: int = SAMPLE_LINES) -> Field:
    """The field from a sample of labelled documents, `sample_rows` in the mean at most, those where `use` holds; of a
    document of more than `sample_lines` lines as many in a row are learned.

    Labels that are neither 0 nor 1 and null ids are left out; an id with both labels is taken with both. use reads
    id_col. Only the lines' features of the sample reach the driver. With no labelled document every score is a half.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").distinct()
    if use is not None:
        marks = marks.withColumnRenamed("id", id_col).where(use).withColumnRenamed(id_col, "id")
    n = marks.count()
    share = min(1.0, sample_rows / max(1, n))
    marks = marks.where(F.pmod(F.xxhash64(F.lit("quality"), F.col("id").cast("string")), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(marks), "id").select("label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, _, x = features(*buffers(batch.column(1)), sample_lines)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            x = x.astype(np.float32)
            yield pa.record_batch([batch.column(0), pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["label", "x"])

    got = rows.mapInArrow(measure, "label int, x binary").collect()
    got.sort(key=lambda r: (bytes(r["x"]), r["label"]))  # whatever order the tasks ended in
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]
    count = np.array([len(y) for y in x], np.int64)
    return fit(np.concatenate(x).astype(np.float64) if x else np.empty((0, WIDTH)), count, np.array([r["label"] for r in got], np.int64), epochs)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, lines): a row for each row of docs; score from 0 to 1, higher for better.

    A null, empty or blank text has score 0. Lines are split at newlines; a text may have any number of them, each costs
    some hundred bytes. Equal texts have equal scores. Other columns of docs are not read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good, count = _scored(batch.column(1), field)
            yield pa.record_batch([batch.column(0), pa.array(good), pa.array(count)], names=[id_col, "score", "lines"])

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, lines long")


def _scored(column: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    n = len(offsets) - 1
    text, weight, scores = line_scores(data, offsets, field.weights)
    count = np.bincount(text, minlength=n)
    forward, backward = chains(scores, count, field.moves)
    weight = weight.astype(np.float64)
    good = np.bincount(text, _sigmoid(forward + backward) * weight, n) / np.maximum(1, np.bincount(text, weight, n))
    solid = np.concatenate([[0], np.cumsum(~np.isin(data, [9, 10, 11, 12, 13, 32]))])
    return np.where(solid[offsets[1:]] > solid[offsets[:-1]], good, 0.0), count


def keep_good(docs: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs whose score is `threshold` at least, with all their columns."""
    place = docs.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=place):
            good, _ = _scored(pc.fill_null(batch.column(place), ""), field)
            yield batch.filter(pa.array(good >= threshold))

    return docs.mapInArrow(run, docs.schema)
