"""Packing token pieces into sequences: shortest pack first over the histogram of lengths.

Documents are tokenised once and cut into pieces of at most the sequence length. The histogram of piece lengths, one
count for each length, is all that reaches the driver. There, lengths are placed longest first, always into the
shortest packs with room, as counts of packing patterns. A piece finds its place in a pattern by its rank among the
pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, written
from .ranks import ranked

LENGTH = 1024
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: Characters that are encoded at a time, at least, and of a run without a blank or of blanks that is left to tokenizers.
STRETCH, RUN = 1 << 17, 1000

#: Fixed value: how the JSON form says that bytes are merged within words, each with one blank before it.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Encoder:
    """The ids of tokenizers for a JSON vocabulary.

    A long text is encoded in stretches, cut before words: words are made of what follows one blank, so a text falls
    apart before each blank with a solid character behind it that begins no added token. Where the JSON form holds plain
    byte-level merges in order of their ids, a faster engine with the same merges and added tokens encodes the
    stretches; those with very long runs, and all of other vocabularies, are encoded by tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        added, model = rules["added_tokens"], rules["model"]
        level = {k: v for k, v in (rules["pre_tokenizer"] or {}).items() if k in _BYTE_LEVEL}
        plain = level == _BYTE_LEVEL and rules["normalizer"] is None and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] and rules["normalizer"] or " " in x["content"] for x in added)
        heads = "".join(sorted({re.escape(x["content"][0]) for x in added}))
        self.cut = re.compile(rf" (?=[^\s{heads}])") if plain else None
        self.fast = self._faster(model, added) if plain and model["type"] == "BPE" else None

    @staticmethod
    def _faster(model: dict, added: list[dict]):
        import public_tokenizers
        import tiktoken

        byte = _characters()
        special = {x["content"]: x["id"] for x in added}
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        others = {k: model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)}
        if others or model.get("ignore_merges") or made != sorted(made):
            return None
        ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _encoded(self, text: str) -> np.ndarray:
        if self.fast is None or len(text) >= RUN and (" " * RUN in text or max(map(len, text.split(" "))) >= RUN):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids."""
        out, at = [], 0
        while at < len(text):
            found = self.cut.search(text, at + STRETCH) if self.cut and len(text) - at > STRETCH else None
            end = found.start() if found else len(text)
            out.append(self._encoded(text[at:end]))
            at = end
        return np.concatenate(out).astype("<u4") if out else np.empty(0, "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of a JSON vocabulary file, by default the public 50k byte-level BPE; made once in a process."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path(VOCABULARY))
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(text: str, path: str | None = None, end: int = END) -> np.ndarray:
    """Ids of a text as little-endian unsigned 32-bit numbers, then the end id."""
    return np.append(encoder(path).ids(text), np.uint32(end)).astype("<u4")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens[, ids]): each document's ids in pieces of `length` and a rest."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, start, size, crc, total, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = token_ids(text, path, end)
                for at in range(0, len(own), length):
                    part = own[at : at + length]
                    rows.append(row)
                    start.append(at)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(own))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>" if with_ids else ""
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long{more}")


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs): shortest pack first, lengths placed longest first."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room: list[int] = []

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        if not packs.get(space):
            packs[space] = []
            heappush(room, -space)
        packs[space].append((pattern, count))

    for size in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left = histogram[size]
        while left and room and -room[0] >= size:
            space = -room[0]
            pattern, count = packs[space].pop()
            if not packs[space]:
                heappop(room)
            used = min(count, left)
            if count > used:
                put(space, pattern, count - used)
            put(space - size, (*pattern, size), used)
            left -= used
        each = length // size  # a pack that was just opened is the shortest, until another piece doesn't fit
        if left // each:
            put(length - each * size, (size,) * each, left // each)
        if left % each:
            put(length - left % each * size, (size,) * (left % each), left % each and 1)
    return [x for space in sorted(packs) for x in packs[space]]


def places(found: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> dict[str, np.ndarray]:
    """For each place in a pattern: length and first rank of the pieces that go there, first sequence, offset."""
    rank, rows, sequence = [0] * (length + 1), [], 0
    for pattern, count in found:
        offset = 0
        for size in pattern:
            rows.append((size, rank[size], sequence, offset))
            rank[size] += count
            offset += size
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "sequence": table[:, 2] - table[:, 1], "offset": table[:, 3]}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset; with_ids also carries the ids themselves.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they come. Pieces of one length take
    their places in order of id, start, tokens and checksum; pieces equal in all of these are alike. An empty table gives
    no piece. Other columns of docs are not read.
    """
    held = written(pieces(docs, id_col, text_col, length, path, end, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(places(patterns(histogram, length), length))
    order = [id_col, "start", "doc_tokens", "ids_crc32"]
    numbered = ranked(held, "length", order, "rank", sum(histogram.values()))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        for batch in batches:
            key = (batch.column("length").to_numpy() << 48) + batch.column("rank").to_numpy()
            row = np.searchsorted(at["key"], key, "right") - 1
            sequence = at["sequence"][row] + batch.column("rank").to_numpy()
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(at["offset"][row])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return numbered.select(*held.columns, "rank").mapInArrow(put, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """(sequence_id, ids, tokens): the padded sequences of pack(..., with_ids=True); one whose length is a power of two isn't padded."""
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)).alias("ids"))
    n = F.size("ids")
    lack = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(length - n)
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), lack)).alias("ids"), n.cast("long").alias("tokens"))
