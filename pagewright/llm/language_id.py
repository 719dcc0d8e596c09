"""Language identification by interpolated Kneser-Ney models over characters.

For each order there is one sorted array of hashed n-grams for all languages together, with a row of smoothed
probabilities, one for each language, beside it; one lookup serves all languages. The language with the lowest
cross-entropy for a character wins; a text that is harder than nearly all calibration texts of the winner is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

ORDER = 4
DISCOUNT = 0.75
#: Rows of a language that are learned from, in the mean at most; a language with fewer gives all.
SAMPLE_ROWS = 1500
#: A language with fewer rows is learned from all of them and never rejected; of others a fifth is held out to calibrate.
FEW_ROWS = 50
#: Share of a language's calibration texts that rejection may turn away.
REJECTED = 0.005
#: Texts with fewer letters are never rejected.
MIN_LETTERS = 40
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Characters of a text, and symbols of texts, that are worked on at a time.
STRETCH = 1 << 18


def symbols(text: str) -> np.ndarray:
    """Code points, folded to 16 bits, of the lower-case text: letters as they are, any run of others as one space.

    A text that begins with others begins with no space.
    """
    text, out, before = text.lower(), [], False
    for at in range(0, len(text), STRETCH):
        points = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[np.minimum(points, 0x10FFFF)]
        kept = np.where(letter, (points & 0xFFFF) ^ (points >> 16), 32).astype(np.uint16)
        out.append(kept[letter | np.concatenate([[before], letter[:-1]])])
        before = bool(letter[-1])
    return np.concatenate(out).astype(np.uint16) if out else np.empty(0, np.uint16)


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000))
    return _table[0]


def grams(marks: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each symbol, packed in 16 bits each; spaces stand before the text."""
    marks = marks.astype(np.uint64)
    out = marks.copy()
    for k in range(1, order):
        out[k:] |= marks[:-k] << np.uint64(16 * k)
        out[:k] |= np.uint64(32) << np.uint64(16 * k)
    return out


@dataclass
class Table:
    """Hashed n-grams in order, with values[row, language]; found through the first bits of the hash."""

    hashes: np.ndarray
    values: np.ndarray
    bits: int = 0
    first: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        hashed = keys * _MIX
        order = np.argsort(hashed)
        out = cls(hashed[order], values[order], max(4, int(len(keys)).bit_length() + 1))
        out.first = np.searchsorted(out.hashes >> np.uint64(64 - out.bits), np.arange((1 << out.bits) + 1, dtype=np.uint64)).astype(np.int32)
        return out

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hashes):
            return out
        hashed = keys * _MIX
        bucket = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        same = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashed
        out[same] = at[same]
        open_ = np.flatnonzero(~same & (at + 1 < end))
        while len(open_):
            at[open_] += 1
            hit = self.hashes[at[open_]] == hashed[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            open_ = open_[at[open_] + 1 < end[open_]]
        return out


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[Table]  # for each order from 1: probabilities
    contexts: list[Table]  # for each order from 2: weights of the lower order after a context
    floor: np.ndarray  # probability of a symbol never seen, for each language
    limit: np.ndarray | None = None  # highest cross-entropy that isn't rejected

    def probabilities(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """Probability of each packed n-gram's last symbol after the others, [key, language]."""
        order = order or self.order
        table = self.grams[order - 1]
        row = table.rows(keys)
        out = table.values[np.maximum(row, 0)] if len(table.values) else np.empty((len(keys), len(self.languages)), np.float32)
        lack = np.flatnonzero(row < 0)
        if len(lack):
            out[lack] = self.backed_off(keys[lack], order)
        return out

    def backed_off(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 1:
            return np.broadcast_to(self.floor, (len(keys), len(self.languages)))
        lower = self.probabilities(keys & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        table = self.contexts[order - 2]
        row = table.rows(keys >> np.uint64(16))
        weight = table.values[np.maximum(row, 0)] if len(table.values) else np.ones((len(keys), len(self.languages)), np.float32)
        return np.where(row[:, None] < 0, 1, weight) * lower

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats for a symbol [text, language], letters of each text), a stretch at a time."""
        out, sizes, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        keys: list[np.ndarray] = []
        of: list[int] = []
        held = 0

        def add() -> None:
            logs = np.log(self.probabilities(np.concatenate(keys)))
            starts = np.cumsum([0, *(len(x) for x in keys[:-1])])
            np.add.at(out, of, -np.add.reduceat(logs, starts, axis=0, dtype=np.float64))

        for k, text in enumerate(texts):
            marks = symbols(text)
            sizes[k], letters[k] = len(marks), np.count_nonzero(marks != 32)
            for at in range(0, len(marks), STRETCH):
                back = min(at, self.order - 1)  # symbols before the stretch that its first n-grams hold
                keys.append(grams(marks[at - back : at + STRETCH], self.order)[back:])
                of.append(k)
                held += len(keys[-1])
                if held >= STRETCH:
                    add()
                    keys.clear()
                    of.clear()
                    held = 0
        if keys:
            add()
        return out / np.maximum(sizes, 1)[:, None], letters


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """The models from each language's packed n-grams of the highest order and their counts."""
    languages = sorted(counts)
    by: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for language in languages:
        keys, n = counts[language]
        levels = [(keys, n.astype(np.float64))]
        for k in range(order - 1, 0, -1):  # how many symbols stand before the shorter n-gram
            shorter, seen = np.unique(levels[0][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
            levels.insert(0, (shorter, seen.astype(np.float64)))
        by.append(levels)
    size = max(1, len(np.unique(np.concatenate([x[0][0] for x in by])))) + 1 if by else 1
    model = Model(languages, order, [], [], np.full(len(languages), 0.0, np.float32))
    total = np.array([max(1.0, x[0][1].sum()) for x in by])
    spread = np.array([discount * len(x[0][0]) for x in by]) / total
    model.floor = (np.where(spread > 0, spread, 1.0) / size).astype(np.float32)
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([x[k - 1][0] for x in by])) if by else np.empty(0, np.uint64)
        context = union >> np.uint64(16)
        own = np.zeros((len(union), len(languages)))
        if k > 1:
            heads = np.unique(context)
            weight = np.ones((len(heads), len(languages)), np.float32)
        for at, levels in enumerate(by):
            keys, n = levels[k - 1]
            row = np.searchsorted(union, keys)
            if k == 1:
                own[row, at] = np.maximum(n - discount, 0) / total[at]
                continue
            head = np.searchsorted(heads, keys >> np.uint64(16))
            whole = np.bincount(head, n, len(heads))
            kinds = np.bincount(head, None, len(heads))
            seen = whole > 0
            weight[seen, at] = discount * kinds[seen] / whole[seen]
            own[row, at] = np.maximum(n - discount, 0) / whole[head]
        if k == 1:
            values = own + model.floor
        else:
            model.contexts.append(Table.of(heads, weight))
            lower = model.probabilities(union & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
            values = own + weight[np.searchsorted(heads, context)] * lower
        model.grams.append(Table.of(union, values.astype(np.float32)))
    return model


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, text, lang) whose hashed id is below a bound for the language: `most` of each language in the mean.

    fifth: whether a row calibrates, which those of a language with few rows never do.
    """
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    many = F.col("lang").isin([k for k, n in sizes.items() if min(n, most) >= FEW_ROWS])
    fifth = many & (F.pmod(F.xxhash64(F.lit("fifth"), "id"), F.lit(5)) == 0)
    share = F.lit(0.0)
    for language, n in sizes.items():
        share = F.when(F.col("lang") == language, min(1.0, most / n)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < share * (1 << 30)).withColumn("fifth", fifth)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", use: Column | None = None, sample_rows: int = SAMPLE_ROWS, order: int = ORDER) -> Model:
    """The model from rows with a language, those where `use` holds; a fifth of the sample calibrates rejection,
    but for languages with few rows, which give all to the counts.

    Counts come together by language and n-gram in the distribution; their number is bounded by the n-grams of the
    sample. Languages are those of the learned rows; with none, the model knows no language.
    """
    rows = docs if use is None else docs.where(use)
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sampled = _sample(rows, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, lang = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for language in sorted(set(lang)):
                keys = [grams(symbols(t), order) for t, x in zip(text, lang, strict=True) if x == language]
                keys, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.record_batch([pa.array([language] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sampled.where("not fifth").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: (np.ascontiguousarray(x["gram"].to_numpy()).view(np.uint64), x["n"].to_numpy()) for k, x in counted.groupby("lang")}
    for k, (keys, n) in counts.items():
        place = np.argsort(keys)
        counts[k] = keys[place], n[place]
    model = estimate(counts, order)
    if model.languages:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = {x: k for k, x in enumerate(shared.value.languages)}
            for batch in slices(batches):
                entropy, letters = shared.value.entropy(batch.column(1).to_pylist())
                own = [(x, float(entropy[k, place[x]])) for k, x in enumerate(batch.column(0).to_pylist()) if x in place and letters[k] >= MIN_LETTERS]
                yield pa.record_batch([pa.array([x for x, _ in own], pa.string()), pa.array([y for _, y in own], pa.float64())], names=["lang", "entropy"])

        measured = sampled.where("fifth").select("lang", "text").mapInArrow(measure, "lang string, entropy double").toPandas()
        limits = {k: float(np.quantile(x["entropy"], 1 - REJECTED)) for k, x in measured.groupby("lang")}
        model.limit = np.array([limits.get(x, np.inf) for x in model.languages])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, cross_entropy, rejected): a row for each row of docs.

    A null text and one without a letter are `und` with score 0. score is the winner's posterior for the text's first
    hundred symbols' worth of evidence, equal priors. rejected: harder than the calibration allows, or no language
    known (then `und`). Languages that a text is equally near to are taken in order of name. Equal texts are treated
    alike. Other columns of docs are not read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], object)
        for batch in slices(batches):
            entropy, letters = known.entropy(batch.column(1).to_pylist())
            n = batch.num_rows
            if not known.languages:
                best, score, least, rejected = np.full(n, -1), np.zeros(n), np.zeros(n), np.ones(n, bool)
            else:
                best = np.argmin(entropy, axis=1)
                least = entropy[np.arange(n), best]
                weight = np.minimum(letters, 100)[:, None]
                score = 1 / np.exp(np.maximum((least[:, None] - entropy) * weight, -700)).sum(axis=1)
                limit = known.limit[best] if known.limit is not None else np.inf
                rejected = (least > limit) & (letters >= MIN_LETTERS) | (letters == 0)
                best, score = np.where(letters == 0, -1, best), np.where(letters == 0, 0.0, np.clip(score, 0, 1))
            yield pa.record_batch([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(least), pa.array(rejected)], names=[id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
