"""Benchmark decontamination with a generalised suffix automaton over words.

The automata of the normalised test items are built on the driver, one after the other, each over a block of bounded
size, and broadcast; documents stream past some of them at a time, word by word. The longest match that ends at each
word says which windows occur: a match of at least `window` words lies wholly inside occurrences, and an item shorter
than that counts as one window of its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from math import ceil

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, free, slices, split_off, text_or_empty, written

WINDOW = 10
#: Bytes of test items for one automaton, in the mean (some 20 MB of memory).
BLOCK_BYTES = 600_000
#: Automata that a task holds at a time; more of them mean another pass over the documents.
PASS_BLOCKS = 8

#: Lower case for A-Z; digits, a-z and bytes from 0x80 stay; all else parts words. Bytes keep their places.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window.

    Nearly all states have one transition: its word and target stand in flat arrays, those beyond the first in `more`.
    A window is a number: its state times window + 1, plus its words.
    """

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        number = lambda w: self.number.setdefault(w, len(self.number))
        kept = [(str(k), [number(x) for x in w]) for k, w in items if w]
        for _, words in kept:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._windows(kept)

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        return self.more[state].get(word, -1) if state in self.more else -1

    def _point(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _add(self, link: int, length: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.word) - 1

    def _extend(self, last: int, word: int) -> int:
        at = self._next(last, word)
        if at >= 0:
            return at if self.length[at] == self.length[last] + 1 else self._clone(last, word, at)
        new = self._add(0, self.length[last] + 1)
        p = last
        while p >= 0 and self._next(p, word) < 0:
            self._point(p, word, new)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, word)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._add(self.link[q], self.length[p] + 1)
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self._next(p, word) == q:
            self._point(p, word, copy)
            p = self.link[p]
        return copy

    def _windows(self, items: list[tuple[str, list[int]]]) -> None:
        """of: window -> an item, or several; own, several: windows that end where a state ends, one or more of them."""
        step = self.window + 1
        of: dict[int, set[int]] = {}
        self.items = sorted({item for item, _ in items})
        place = {item: k for k, item in enumerate(self.items)}
        sizes: dict[int, set[int]] = {}
        for item, words in items:
            n = min(self.window, len(words))
            end = 0
            for at, word in enumerate(words):
                end = self._next(end, word)
                state = end
                if at + 1 >= n:
                    while self.length[self.link[state]] >= n:
                        state = self.link[state]
                    # one window at most for a state and a length: strings of a state are suffixes of one another
                    of.setdefault(state * step + n, set()).add(place[item])
                    sizes.setdefault(state, set()).add(n)
        self.of = {k: next(iter(v)) if len(v) == 1 else tuple(sorted(v)) for k, v in of.items()}
        self.own, self.several = array("q", [-1]) * len(self.word), {}
        for state in sorted(range(1, len(self.word)), key=self.length.__getitem__):
            above = self.link[state]
            ends = self.several.get(above, (self.own[above],) if self.own[above] >= 0 else ())
            if state in sizes:
                ends = (*(state * step + n for n in sorted(sizes[state], reverse=True)), *ends)
            if ends:
                self.own[state] = ends[0]
            if len(ends) > 1:
                self.several[state] = ends

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of words inside window occurrences, and the items with an occurring window."""
        first, target, more, link, length, own, several, step = self.word, self.to, self.more, self.link, self.length, self.own, self.several, self.window + 1
        number = self.number.get
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = matched = 0
        for at, raw in enumerate(words):
            word = number(raw)
            if word is None:
                state = matched = 0
                continue
            while True:
                if first[state] == word:
                    to = target[state]
                else:
                    to = more[state].get(word, -1) if state in more else -1
                if to >= 0 or not state:
                    break
                state = link[state]
                matched = length[state]
            if to < 0:
                continue
            state, matched = to, matched + 1
            if own[state] < 0:
                continue
            most = 0
            for key in several[state] if state in several else (own[state],):
                n = key % step
                if n <= matched:
                    found.add(key)
                    most = n if n > most else most
            if most:
                start = at + 1 - most
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        held = [self.of[x] for x in found]
        return spans, {self.items[k] for x in held for k in (x if isinstance(x, tuple) else (x,))}


def _passes(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[list[Broadcast]]:
    """Automata over all items, each over about block_bytes of text, as many at a time as a pass takes.

    The driver holds one automaton at a time; a broadcast one lies in files and in the block manager.
    """
    context = items.sparkSession.sparkContext
    held = written(items.select(F.col(id_col).alias("item"), text_or_empty(text_col).alias("text")).where(F.col("item").isNotNull()).distinct(), "items")
    blocks = max(1, ceil((held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    out = []
    for k in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        out.append(context.broadcast(SuffixAutomaton([(r.item, words_of(r.text.encode())) for r in sorted(rows, key=lambda r: (str(r.item), r.text))], window)))
        if len(out) == PASS_BLOCKS or k == blocks - 1:
            yield out
            out = []


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scanned(docs: DataFrame, automata: list[Broadcast], text_col: str, keys: list[Column]) -> DataFrame:
    """The keys of each row, n_words, spans and items of some automata together."""
    rows = docs.select(*keys, text_or_empty(text_col).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    names, place = [*rows.columns[:-1], "n_words", "spans", "items"], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=place):
            counts, spans, items = [], [], []
            for text in as_bytes(batch.column(place)):
                words = words_of(text)
                got = [x.value.scan(words) for x in automata]
                whole = got[0][0] if len(got) == 1 else _merged(y for x, _ in got for y in x)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in whole])
                items.append(sorted(set().union(*(y for _, y in got))))
            columns = [*batch.columns[:place], pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"{fields}, n_words long, spans array<struct<start:int,end:int>>, items array<string>")


def _joined(spans: Column) -> Column:
    """The spans in order, those that meet made one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, x: F.array(F.struct(last(acc).start.alias("start"), F.greatest(last(acc).end, x.end).alias("end")))
    add = lambda acc, x: F.when((F.size(acc) > 0) & (last(acc).end >= x.start), F.concat(F.slice(acc, 1, F.size(acc) - 1), longer(acc, x))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), empty, add)


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: id_col, text_key, n_words, spans (of words, merged, end exclusive), items.

    Words: A-Z in lower case, then runs without 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F. Null, empty and wordless texts have no
    words, spans or items. Items without words or id have no window. Item ids come back as text, each once, sorted.
    Repeated rows of docs come back as often. Other columns of docs are not read.
    """
    keys = [F.col(id_col), F.xxhash64(text_or_empty(text_col)).alias("text_key")]
    first, more = None, None
    for automata in _passes(items, item_col, item_text, window, block_bytes):
        found = _scanned(docs, automata, text_col, keys)
        if first is None:
            first = found
            continue
        # more passes: what each finds beyond the first comes together by document
        got = written(found.where("size(spans) > 0").select(id_col, "text_key", "spans", "items").distinct(), "overlaps")
        more = got if more is None else more.union(got)
    if more is None:
        return first
    more = more.groupBy(id_col, "text_key").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    more = more.select(F.col(id_col).alias("of"), F.col("text_key").alias("of_key"), "s", "i")
    both = first.join(more, F.col(id_col).eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    spans = F.when(F.col("s").isNull(), F.col("spans")).otherwise(_joined(F.concat("spans", "s")))
    names = F.when(F.col("i").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", "i"))))
    return both.select(id_col, "text_key", "n_words", spans.alias("spans"), names.alias("items"))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_span: int = WINDOW, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with every matched span of min_span words or of a whole shorter item cut from its text.

    A document of which more than max_coverage of the words are matched goes whole. Columns are those of docs; an n_chars
    column gets the code points of the new text. Null texts stay null. Rows whose text is not cut stay as they are. Every
    block of items sees the whole text; the spans of all of them count and are cut together. Texts with spans are
    shuffled to meet them, the others pass by.
    """
    key = F.xxhash64(text_or_empty(text_col))  # what is cut depends on the text alone
    hits = None
    for automata in _passes(items, item_col, item_text, window, block_bytes):
        found = _scanned(docs, automata, text_col, [key.alias("_key")]).where("size(spans) > 0").drop("items")
        got = written(found.distinct(), "spans")
        hits = got if hits is None else hits.union(got)
    spans = hits.groupBy("_key").agg(F.max("n_words").alias("words"), _joined(F.flatten(F.collect_list("spans"))).alias("spans"))
    long = F.filter("spans", lambda x: (x.end - x.start >= min(min_span, window)) | (x.end - x.start < window))
    hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x.end - x.start)
    of, cuts, keep = free(docs, "_key"), free(docs, "_spans"), free(docs, "_keep")
    spans = spans.withColumn("spans", long).select(F.col("_key").alias(of), F.col("spans").alias(cuts), (hit <= max_coverage * F.col("words")).alias(keep))
    spans = written(spans.where(F.size(cuts) > 0), "cuts")
    some, rest = split_off(docs, key, spans.select(of))
    met = some.join(spans.hint("merge"), key == F.col(of), "left").where(F.coalesce(keep, F.lit(True)))
    schema, names = docs.schema, docs.schema.fieldNames()
    place, count = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=place):
            own = batch.select(range(len(names)))
            spans_of = batch.column(len(names)).to_pylist()
            changed = [bool(x) for x in spans_of]
            columns = list(own.columns)
            if any(changed):
                raw = own.column(place).cast(pa.binary()).to_pylist()
                texts = [cut_spans(x, [(y["start"], y["end"]) for y in cut]) if cut else x for x, cut in zip(raw, spans_of, strict=True)]
                columns[place] = pa.array(texts, pa.binary()).cast(pa.string()).cast(own.schema.field(place).type)
                if count is not None:
                    size = pc.utf8_length(columns[place]).cast(own.schema.field(count).type)
                    columns[count] = pc.if_else(pa.array(changed), size, columns[count])
            yield pa.RecordBatch.from_arrays(columns, schema=own.schema)

    return met.select(*(F.col(f"`{c}`") for c in names), cuts).mapInArrow(run, schema).unionByName(rest)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
hits AS (SELECT doc_id, places.n, i, item_id FROM places JOIN windows ON places.n = windows.n AND places.s = windows.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
