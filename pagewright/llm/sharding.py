"""Sharding by a k-d tree over metadata: weighted medians, found in the distribution, along the widest dimension.

Only counts by node and bin reach the driver. A node's median is narrowed down bin by bin on a sort key that starts
with the dimension's value and goes on with the text's checksum and the id. The dimensions are read off the text, so
that equal texts are one point: a cut falls between points, and through one only where a group of equal texts is too
heavy to stay whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .ranks import ranked

#: Bins of a node in one round of narrowing; a power of two.
BINS = 4096
#: A median is near enough when the bin that holds it has this share of the node's bytes at most.
CLOSE = 5e-4
#: Bits of a sort key: the value's bin along its dimension, the text's checksum, a hash of the id. Rounds of narrowing
#: by the default bins end on each border.
VALUE_BITS, TEXT_BITS, ID_BITS = 16, 20, 24
#: A group of equal texts with a greater share of a node's bytes may be cut, by id.
SPLIT = 5e-3
DIMENSIONS = ("log_size", "log_lines", "width")


@dataclass
class Node:
    low: int
    shards: int
    dimension: str = ""
    cut: int = 0


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size (bytes and 1 for the end), checksum and the default dimensions of each document: bytes, lines, bytes of a character."""
    text = text_or_empty(text_col)
    size = F.octet_length(text)
    return docs.select(
        F.col(id_col),
        (size + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.log2(size + 1.0).alias("log_size"),
        F.log2(size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1.0).alias("log_lines"),
        ((size + 1.0) / (F.length(text) + 1.0)).alias("width"),
    )


def _key(dimension: str, low: float, high: float, id_col: str) -> Column:
    """The sort key: `dimension` between low and high in VALUE_BITS, then checksum and id."""
    span = (high - low) or 1.0
    top = (1 << VALUE_BITS) - 1
    value = F.least(F.lit(top), F.greatest(F.lit(0), F.floor((F.col(dimension) - low) / span * top))).cast("long")
    text = F.shiftright(F.col("text_crc32"), 32 - TEXT_BITS)
    own = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << ID_BITS))
    return F.shiftleft(value, TEXT_BITS + ID_BITS) + F.shiftleft(text, ID_BITS) + own


def kd_shards(meta: DataFrame, dimensions: list[str], shards: int, id_col: str = "doc_id", weight: str = "size", bins: int = BINS, close: float = CLOSE) -> DataFrame:
    """meta with `shard`: leaves of a k-d tree of near equal weight, numbered from 0 along the cuts.

    Each level splits every node with more than one shard at the weighted quantile that gives both sides their number
    of shards. A node is a range of shards [low, low + shards). Nulls in a dimension count as its least value.
    """
    held = meta.withColumn("_low", F.lit(0)).withColumns({d: F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in dimensions})
    bounds = held.agg(*(f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max)))).first()
    level = [Node(0, shards)]
    while any(x.shards > 1 for x in level):
        split = [x for x in level if x.shards > 1]
        spread = held.groupBy("_low").agg(F.sum(weight).alias("w"), *(f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))))
        stats = {r["_low"]: r for r in spread.collect()}
        keys = F.lit(None).cast("long")
        goal: dict[int, float] = {}
        for node in split:
            seen = stats.get(node.low)
            if seen is None:
                continue
            width = lambda d, s=seen: (s[f"max_{d}"] - s[f"min_{d}"]) / ((bounds[f"max_{d}"] - bounds[f"min_{d}"]) or 1.0)
            node.dimension = max(dimensions, key=width)
            goal[node.low] = seen["w"] * (node.shards // 2) / node.shards
            low, high = seen[f"min_{node.dimension}"], seen[f"max_{node.dimension}"]
            keys = F.when(F.col("_low") == node.low, _key(node.dimension, low, high, id_col)).otherwise(keys)
        keyed = written(held.withColumn("_key", keys), "keyed")
        _cuts(keyed, {x.low: x for x in split if x.low in goal}, goal, {k: stats[k]["w"] for k in goal}, weight, bins, close)
        to = F.col("_low")
        for node in split:
            to = F.when((F.col("_low") == node.low) & (F.col("_key") >= node.cut), node.low + node.shards // 2).otherwise(to)
        held = keyed.withColumn("_low", to).drop("_key")
        level = [y for x in level for y in ([x] if x.shards == 1 else [Node(x.low, x.shards // 2), Node(x.low + x.shards // 2, x.shards - x.shards // 2)])]
    return held.withColumn("shard", F.col("_low").cast("int")).drop("_low")


def _cuts(keyed: DataFrame, nodes: dict[int, Node], goal: dict[int, float], total: dict[int, int], weight: str, bins: int, close: float) -> None:
    """Sets each node's cut: the weight of keys below it is the goal, within `close` of the node's weight, SPLIT of it
    where that keeps equal texts together, or one key."""
    window = {k: (0, 1 << (VALUE_BITS + TEXT_BITS + ID_BITS), 0) for k in nodes}  # first key, keys, weight before
    while window:
        bin_of = F.lit(None).cast("long")
        for k, (first, n, _) in window.items():
            inside = (F.col("_low") == k) & (F.col("_key") >= first) & (F.col("_key") < first + n)
            bin_of = F.when(inside, F.shiftright(F.col("_key") - first, max(1, n // bins).bit_length() - 1)).otherwise(bin_of)
        counts = keyed.select("_low", bin_of.alias("b"), weight).where("b is not null").groupBy("_low", "b").agg(F.sum(weight).alias("w"))
        found: dict[int, list[tuple[int, int]]] = {}
        for r in counts.collect():
            found.setdefault(r["_low"], []).append((r["b"], r["w"]))
        for k in list(window):
            first, n, before = window.pop(k)
            step = max(1, n // bins)
            for b, w in sorted(found.get(k, [])):
                if before + w >= goal[k]:
                    # a bin as wide as a point holds equal texts: it is cut only if it is heavy
                    if step > 1 and w > (max(close, SPLIT) if step == 1 << ID_BITS else close) * total[k]:
                        window[k] = (first + b * step, step, before)
                    else:
                        nearer = before + w - goal[k] < goal[k] - before
                        nodes[k].cut = first + (b + nearer) * step
                    break
                before += w
            else:
                nodes[k].cut = first + n


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): `shards` leaves, or as many as keep to target_bytes.

    slot runs from 0 without gaps in each shard. Null and empty texts have size 1 and are equal texts. Equal texts lie in
    one shard, but for groups with more than SPLIT of a node's bytes, which may be cut. Repeated rows have slots of their
    own, in order of id and checksum; which of two equal rows comes first is open. Rows without an id are placed like
    others. An empty table gives no rows.
    """
    meta = written(metadata(docs, id_col, text_col), "metadata")
    seen = meta.agg(F.count("*").alias("n"), F.sum("size").alias("w")).first()
    shards = shards or max(1, ceil((seen.w or 0) / (target_bytes or 1 << 30)))
    placed = written(kd_shards(meta, list(dimensions), shards, id_col).select(id_col, "size", "text_crc32", "shard"), "placed")
    return ranked(placed, "shard", [id_col, "text_crc32"], "slot", seen.n)


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes docs to one folder a shard under path; documents are joined by id."""
    of = placed.select(F.col(id_col).alias("_of"), "shard").distinct()
    docs.join(of, F.col(id_col) == F.col("_of")).drop("_of").write.partitionBy("shard").parquet(path)
