"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared once each, however many documents carry them. Two of them within the radius agree on all of
m - radius out of m blocks of their bits for some choice of blocks, so each goes under one key for each choice; m grows
with the number of fingerprints, so that a key stays short of company. The fingerprints of a key are split into tiles
of bounded size by population count; pairs of tiles whose counts differ beyond the radius are never formed, the others
are compared by exclusive-or and bit counts in numpy, and each comparison hands on a spanning forest of its links. Every pair within the radius meets in some tile pair: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, free, slices, split_off, text_or_empty, written
from .components import connected_components

RADIUS = 4
SHINGLE = 4
#: Fingerprints in a tile; a task compares two tiles at most at a time.
TILE = 4096
#: Rows compared with one another at a time within a tile pair.
RUN = 256
#: Fingerprints expected under one key; beyond that, more blocks are cut.
COMPANY = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64 majority bits over the XXH64 of all shingles, repeats included; 0 for a text without a word."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), 42)
    counts, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        n = len(part) - shingle + 1
        hashes = np.fromiter((digest(b" ".join(x), 42) for x in zip(*(part[k:] for k in range(shingle)), strict=False)), np.uint64, n)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def majority(value: np.ndarray, offsets: np.ndarray, run: int = 1 << 16) -> np.ndarray:
    """The 64 majority bits over each of some sets of hashes, value[offsets[k]:offsets[k + 1]]; 0 for an empty one."""
    size = np.diff(offsets)
    of, counts = np.repeat(np.arange(len(size)), size), np.zeros((len(size), 64), np.int64)
    for at in range(0, len(value), run):
        part = of[at : at + run]
        bits = np.unpackbits(np.ascontiguousarray(value[at : at + run]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        counts[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, text_key, fp): a row for each row of docs; fp holds the 64 bits as a signed long. Null text: no word, fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.fromiter((fingerprint(x, shingle) for x in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=[id_col, "text_key", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, text_key long, fp long")


def blocks_for(n: int, radius: int = RADIUS, company: int = COMPANY) -> int:
    """The least number of blocks with which a key has the company wanted at most."""
    m = radius + 1
    while m < 16 and n / 2 ** (64 * (m - radius) // m) > company:
        m += 1
    return m


def masks(m: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of m - radius out of m blocks."""
    cuts = [64 * k // m for k in range(m + 1)]
    block = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(m)]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(m), m - radius)]


def _hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i and j pairwise; a label is the least index of its tree."""
    while len(i):
        li, lj = labels[i], labels[j]
        apart = li != lj
        i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
        if not len(i):
            break
        np.minimum.at(labels, np.maximum(li, lj), np.minimum(li, lj))
        while True:
            above = labels[labels]
            if (above == labels).all():
                break
            labels = above
    return labels


def forest(fps: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among fps; with side, of the links between the two sides only."""
    count = np.bitwise_count(fps)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order].astype(np.int64)
    side = None if side is None else side[order]
    labels = np.arange(len(fps))
    for at in range(0, len(fps), RUN):
        rows = fps[at : at + RUN]
        end = np.searchsorted(count, count[min(at + RUN, len(fps)) - 1] + radius, "right")
        for to in range(at, end, 16 * RUN):
            columns = fps[to : min(end, to + 16 * RUN)]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ columns[None, :]) <= radius)
            i, j = i + at, j + to
            keep = (i < j) if side is None else (i < j) & (side[i] != side[j])
            labels = _hook(labels, i[keep], j[keep])
    moved = np.nonzero(labels != np.arange(len(fps)))[0]
    return fps[moved], fps[labels[moved]]


def _tiles(keyed: DataFrame, tile: int) -> DataFrame:
    """(way, key, pop, first, parts): the tiles of each key's fingerprints with pop bits set, numbered from `first`.

    Tiles are runs of population counts, about `tile` fingerprints each; a single count with more of them has `parts`
    tiles. A key has a row for each of 65 counts at most. Keys with one fingerprint have none.
    """
    size = keyed.groupBy("way", "key", "pop").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("way", "key")
    upto = whole.orderBy("pop").rowsBetween(Window.unboundedPreceding, -1)
    placed = size.withColumn("all", F.sum("n").over(whole)).where(F.col("all") > 1).withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    # a count with parts of its own starts a new run of tiles, and so does the count after it
    before = F.coalesce(F.sum(F.when(F.col("parts") > 1, 0).otherwise(F.col("n"))).over(upto), F.lit(0))
    run = F.floor(before / tile)
    wide = placed.withColumns({"run": run, "wide": F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("parts") + 1).otherwise(0)).over(upto), F.lit(0))})
    return wide.select("way", "key", "pop", (F.col("run") + F.col("wide") + F.when(F.col("parts") > 1, 1).otherwise(0)).cast("int").alias("first"), "parts")


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(way, key, i, j): the pairs of tiles, i <= j, whose population counts differ by the radius at most."""
    own = tiles.select("way", "key", "pop", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("i"))
    spans = own.groupBy("way", "key", "i").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
    other = spans.select(F.col("way").alias("w"), F.col("key").alias("k"), F.col("i").alias("j"), F.col("low").alias("low_j"))
    near = (F.col("way") == F.col("w")) & (F.col("key") == F.col("k")) & (F.col("i") <= F.col("j")) & (F.col("low_j") - F.col("high") <= radius)
    return spans.join(other, near).select("way", "key", "i", "j")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect what the links within the radius connect, among the distinct longs of column fp."""
    ways = masks(blocks_for(distinct.count(), radius), radius)
    signed = [x - (1 << 64) if x >> 63 else x for x in ways]
    keyed = distinct.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in signed])).alias("way", "key"))
    tiles = written(_tiles(keyed, tile), "tiles")
    pairs = tile_pairs(tiles, radius)
    sides = pairs.select("way", "key", F.col("i").alias("own"), "i", "j").unionByName(pairs.where("i < j").select("way", "key", F.col("j").alias("own"), "i", "j"))
    part = F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = keyed.join(tiles, ["way", "key", "pop"]).select("way", "key", part.alias("own"), "fp").join(sides, ["way", "key", "own"])
    met = met.select("way", "key", "i", "j", "own", "fp").repartition("way", "key", "i", "j").sortWithinPartitions("way", "key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 6), np.int64)
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)])
            rows = np.concatenate([held, rows]) if len(held) else rows
            if not len(rows):
                continue
            cuts = np.nonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))[0] + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from _groups(rows[:last], cuts[:-1], radius)
            held = rows[last:]
        yield from _groups(held, np.empty(0, np.int64), radius)

    return met.mapInArrow(compare, "a long, b long").distinct()


def _groups(rows: np.ndarray, cuts: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    a, b = [], []
    fps = np.ascontiguousarray(rows[:, 5]).view(np.uint64)
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        across = rows[lo, 2] != rows[lo, 3]
        x, y = forest(fps[lo:hi], rows[lo:hi, 4] if across else None, radius)
        if len(x):
            a.append(x)
            b.append(y)
    if a:
        yield pa.record_batch([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(id_col, text_key, fp, component_id, component_key): a row for each row of docs.

    component_id is the least id among the documents reachable over links of at most `radius` differing bits, and
    component_key the text_key of its text (the least one, if several rows share the id). Texts that are null, empty or
    blank have fingerprint 0 and link as any other. Repeated rows stay, with the same values. A null id comes after all
    others: it is a component's id only where the component has no other. Other columns of docs are not read.
    """
    held = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(held.groupBy("fp").agg(first_row(id_col).alias("rep")), "distinct")
    return named(held, distinct, links(distinct.select("fp"), radius, tile), id_col)


def first_row(id_col: str) -> Column:
    """The least (late, id, key) of some rows: null ids are late."""
    return F.min(F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.col("text_key").alias("key")))


def named(held: DataFrame, distinct: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """(id_col, text_key, fp, component_id, component_key) for each row of held, where edges (a, b) link the rows (fp, rep) of distinct."""
    roots = connected_components(edges)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    of = written(rooted.join(least, "root").select(F.col("fp").alias("of"), F.col("first.id").alias("component_id"), F.col("first.key").alias("component_key")), "named")
    return held.join(of, F.col("fp") == F.col("of")).select(id_col, "text_key", "fp", "component_id", "component_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """docs with one row of each component: that of component_id and component_key. See keep_least."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row for each component in found: the row whose id and text are the component's.

    Rows are told apart by id and text, so a text that shares its id with a copy stays. Null ids are ids like others,
    the last in order. Of rows equal in both one stays, whichever; if their other columns differ, which is open. Only
    documents that have a copy are shuffled.
    """
    key = lambda id_, text_key: F.xxhash64(F.col(id_).isNull(), F.col(id_), text_key)
    text_key = F.xxhash64(text_or_empty(text_col))
    stays = F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    of = free(docs, "_of")
    rows = written(found.select(key(id_col, F.col("text_key")).alias(of), stays.alias("stays")), "near")
    gone = written(rows.where("not stays").select(of).distinct(), "copies")
    some, rest = split_off(docs, key(id_col, text_key), gone)
    kept = some.join(gone.hint("merge"), key(id_col, text_key) == F.col(of), "left_anti").unionByName(rest)
    twice = written(rows.where("stays").groupBy(of).count().where("count > 1").select(of), "repeated")
    if twice.isEmpty():
        return kept
    some, rest = split_off(kept, key(id_col, text_key), twice)
    return some.dropDuplicates([id_col, text_col]).unionByName(rest)
