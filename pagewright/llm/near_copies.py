"""Near copies by SimHash fingerprints of word shingles, tiled exact comparison, and exact Jaccard similarity.

A text's fingerprint has the majority bits over its set of shingle hashes. Fingerprints within RADIUS bits are found by
simhash.links, none is lost; such texts join one block. Texts of similarity 0.8 differ in some 10 bits, beyond what keys of
64 bits can promise, so texts that share one of BANDS keys of ROWS minima join a block too, along edges whose number is
linear in the texts: a pair of similarity s shares no key with the chance (1 - s**ROWS)**BANDS, 5e-5 at 0.8, 2e-10 at 0.9.

A block is compared in tiles, in numpy: a fingerprint against all that no link has reached yet, by exclusive-or and bit
counts within WIDE bits, then the sets of those that are left, exactly. A bit of two sets of similarity 0.8 or more differs
with the chance 3/16 at most, so that WIDE loses one of them with 1.1e-6 at most; of unlike texts a fifth goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, split_off, text_or_empty, written
from .components import connected_components
from .simhash import RADIUS, first_row, keep_least, majority, named
from .simhash import links as fingerprint_links
from .textarrays import FOLD, buffers, hashes, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Differing bits within which fingerprints of a block's tile go on to the exact check.
WIDE = 28
#: Texts and shingles in a tile; a task compares two tiles at most at a time.
TILE, TILE_SHINGLES = 4096, 4_000_000

_RANDOM = np.random.Generator(np.random.PCG64(20240301))
_FLIP, _TIMES, _PLACE = (_RANDOM.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, 64))


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def shingles(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): text k has hashes[offsets[k]:offsets[k + 1]], each of its shingles once, in order.

    Words are those of simhash.fingerprint. A text with fewer words than a shingle is one shingle, one without a word none.
    """
    data, offsets = buffers(column)
    data, n = FOLD[data], len(offsets) - 1
    of, start, end = words(data, offsets)
    own = hashes(data, start, end) if len(of) else np.empty(0, np.uint64)
    size = np.bincount(of, minlength=n)
    runs = np.maximum(size - shingle + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(n), runs)
    at = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(np.cumsum(size) - size, runs)
    value = np.zeros(len(text), np.uint64)
    for k in range(shingle):
        there = k < size[text]
        value[there] += own[at[there] + k] * _PLACE[k]
    value = _mixed(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1]))[: len(text)]
    return value[first], np.searchsorted(text[first], np.arange(n + 1))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, text_key, fp, size, bits, keys): a row for each row of docs. fp stands for the text's set of shingles, bits
    is its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, offsets = shingles(batch.column(1), shingle)
            n, size = batch.num_rows, np.diff(offsets)
            total = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(_mixed(value), out=total[1:])
            fp = _mixed(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64))
            full = np.flatnonzero(size)
            keys = np.zeros((n, BANDS), np.uint64)
            for band in range(BANDS if len(full) else 0):
                for row in range(band * ROWS, (band + 1) * ROWS):
                    least = np.minimum.reduceat((value ^ _FLIP[row]) * _TIMES[row], offsets[full])
                    keys[full, band] = _mixed(keys[full, band] * _PLACE[0] + least)
                keys[full, band] = _mixed(keys[full, band] + _PLACE[1 + band])
            cut = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(cut), pa.array(keys[full].ravel().view(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(majority(value, offsets).view(np.int64)), listed], names=[id_col, "text_key", "fp", "size", "bits", "keys"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, text_key long, fp long, size long, bits long, keys array<long>")


def forest(value: np.ndarray, offsets: np.ndarray, bits: np.ndarray, similarity: float = SIMILARITY, wide: int = WIDE) -> np.ndarray:
    """For each set of hashes, a set of its component: the same one for all sets that links of `similarity` connect.

    bits: the sets' fingerprints. Those that differ in more than `wide` bits are not compared further.
    """
    size = np.diff(offsets)
    n = len(size)
    order = np.argsort(size, kind="stable")  # a link's sizes differ by the similarity at most: partners are one range
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    _, code = np.unique(value, return_inverse=True)
    own = [code[offsets[k] : offsets[k + 1]] for k in order]
    size, bits = size[order], bits[order]
    marked = np.zeros(len(value) + 1, bool)
    root = np.full(n, -1)
    left, sizes, reached = np.arange(n), size, 0
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], queue, reached = seed, [seed], reached + 1
        while queue:
            at = queue.pop()
            if reached * 8 > len(left):  # leave out those that have a component
                left, reached = left[root[left] < 0], 0
                sizes = size[left]
            lo, hi = np.searchsorted(sizes, max(1, size[at] * similarity - 1e-6), "left"), np.searchsorted(sizes, size[at] / similarity + 1e-6, "right")
            some = left[lo:hi]
            some = some[(np.bitwise_count(bits[some] ^ bits[at]) <= wide) & (root[some] < 0)]
            if not len(some):
                continue
            marked[own[at]] = True
            both = np.add.reduceat(marked[np.concatenate([own[k] for k in some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
            marked[own[at]] = False
            near = some[both >= similarity * (size[at] + size[some] - both) - 1e-9]
            root[near], reached = seed, reached + len(near)
            queue.extend(near.tolist())
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _blocks(held: DataFrame, distinct: DataFrame) -> DataFrame:
    """(fp, root): the distinct sets with a near fingerprint or a key of another one, and what names their block."""
    full = distinct.where("size > 0")
    leads = written(full.groupBy("bits").agg(F.min("fp").alias("lead")), "leads")
    near = fingerprint_links(leads.select(F.col("bits").alias("fp")), RADIUS)
    ends = [leads.select(F.col("bits").alias(f"{x}_bits"), F.col("lead").alias(f"{x}_lead")) for x in "ab"]
    alike = full.join(leads, "bits").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    alike = alike.union(near.join(ends[0], F.col("a") == F.col("a_bits")).join(ends[1], F.col("b") == F.col("b_bits")).select("a_lead", "b_lead"))
    keyed = held.select("fp", F.explode("keys").alias("key"))
    least = F.first("fp").over(Window.partitionBy("key").orderBy("fp").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    roots = connected_components(keyed.select(F.col("fp").alias("a"), least.alias("b")).union(alike))
    return roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())


def links(docs: DataFrame, held: DataFrame, distinct: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect what the links of `similarity` within the blocks connect, among the sets' fp."""
    blocks = written(_blocks(held, distinct), "blocks")
    members = distinct.select("fp", F.xxhash64("rep").alias("key"), "size", "bits").join(blocks.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of")).drop("of")
    whole = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int").alias("t"))
    members = members.join(whole.withColumnRenamed("root", "of"), F.col("root") == F.col("of"))
    wanted = written(members.select("fp", F.col("key").alias("of"), "root", "t", "bits"), "members")
    # of exact copies only the first row's text is wanted
    key = F.xxhash64(F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_or_empty(text_col))))
    some, _ = split_off(docs.select(id_col, text_col), key, wanted.select("of"))
    met = some.select(text_or_empty(text_col).alias("text"), key.alias("key")).join(wanted.hint("merge"), F.col("key") == F.col("of"))
    met = (
        met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("t")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "text", "bits")
    )
    met = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        fps, bits, value, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        to = forest(value, np.concatenate([[0], np.cumsum(size)]), bits.view(np.uint64), similarity)
        moved = np.flatnonzero(to != np.arange(len(to)))
        return fps[moved], fps[to[moved]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, group = [], None
        for batch in slices(batches, column=4):
            key = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            fps, bits = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            value, offsets = shingles(batch.column(4), shingle)
            found = []
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if parts and group != tuple(key[lo]):
                    found.append(edges(parts))
                    parts = []
                group = tuple(key[lo])
                parts.append((fps[lo:hi], bits[lo:hi], value[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1])))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])
        if parts:
            yield pa.record_batch([pa.array(x) for x in edges(parts)], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(id_col, text_key, fp, component_id, component_key): a row for each row of docs.

    component_id is the least id among the documents reachable over links of `similarity` or more, component_key as in
    simhash.near_duplicates. Texts without a word are copies of one another. Repeated rows stay, with the same values. A
    null id is a component's id only where the component has no other. Other columns of docs are not read.
    """
    held = written(sketches(docs, id_col, text_col, shingle), "sketches")
    distinct = written(held.groupBy("fp").agg(first_row(id_col).alias("rep"), F.min("size").alias("size"), F.min("bits").alias("bits")), "distinct")
    return named(held, distinct, links(docs, held, distinct, id_col, text_col, shingle, similarity, tile), id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """docs with one row of each component; as simhash.keep_one."""
    return keep_least(docs, near_copies(docs, id_col, text_col, **options), id_col, text_col)
