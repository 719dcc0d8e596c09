"""Matching over postings: one shuffle brings a page's positions together, all else is column expressions.

A query's leaves (terms, prefixes) become array columns of positions on a row for each page that has one of them.
Words, phrases, proximity, alternatives and quorums are conditions over these columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import Index

K1, B = 1.2, 0.75
#: What a term found on half of the pages or more weighs.
FLOOR = 1e-6


@dataclass(frozen=True)
class Leaf:
    """A term, or all terms that start with it."""

    text: str
    prefix: bool = False

    def holds(self, term: Column) -> Column:
        return term.startswith(self.text) if self.prefix else term == self.text


@dataclass(frozen=True)
class Phrase:
    """Leaves that stand one after the other; a single leaf is a word."""

    leaves: tuple[Leaf, ...]

    @staticmethod
    def of(*words: str) -> Phrase:
        return Phrase(tuple(Leaf(w) for w in words))


@dataclass(frozen=True)
class Near:
    """Words within `distance` words of one another, in any order."""

    words: tuple[str, ...]
    distance: int


@dataclass(frozen=True)
class AnyOf:
    parts: tuple[object, ...]


@dataclass(frozen=True)
class AllOf:
    parts: tuple[object, ...]


@dataclass(frozen=True)
class AtLeast:
    """`count` of the parts or more."""

    parts: tuple[object, ...]
    count: int


@dataclass(frozen=True)
class Without:
    """The first on a page that doesn't hold the second, which is not scored."""

    keep: object
    drop: object


def leaves_of(node: object) -> list[Leaf]:
    if isinstance(node, Phrase):
        return list(node.leaves)
    if isinstance(node, Near):
        return [Leaf(w) for w in node.words]
    if isinstance(node, Without):
        return [*leaves_of(node.keep), *leaves_of(node.drop)]
    return [x for part in node.parts for x in leaves_of(part)]


def phrases_of(node: object) -> list[Phrase]:
    """The phrases that are scored, each once: every alternative and every member of a proximity is one."""
    if isinstance(node, Phrase):
        found = [node]
    elif isinstance(node, Near):
        found = [Phrase.of(w) for w in node.words]
    elif isinstance(node, Without):
        found = phrases_of(node.keep)
    else:
        found = [x for part in node.parts for x in phrases_of(part)]
    return list(dict.fromkeys(found))


class Matcher:
    """Positions of some leaves by page, and the conditions and counts that they allow."""

    def __init__(self, index: Index, nodes: list[object]) -> None:
        self.index = index
        self.leaves = list(dict.fromkeys(x for n in nodes for x in leaves_of(n)))
        self.column = {x: f"p{k}" for k, x in enumerate(self.leaves)}
        term = F.col("term")
        wanted = reduce(lambda a, b: a | b, [x.holds(term) for x in self.leaves if x.prefix] + [term.isin([x.text for x in self.leaves if not x.prefix])])
        held = []
        for x in self.leaves:
            own = F.when(x.holds(term), F.col("positions"))
            held.append((F.sort_array(F.flatten(F.collect_list(own))) if x.prefix else F.coalesce(F.max(own), F.array().cast("array<int>"))).alias(self.column[x]))
        self.pages = index.postings.where(wanted).groupBy("doc_id", "page").agg(F.max("dl").alias("dl"), *held)

    def places(self, phrase: Phrase) -> Column:
        """Where the phrase begins on the page."""
        first = F.col(self.column[phrase.leaves[0]])
        if len(phrase.leaves) == 1:
            return first
        return F.filter(first, lambda at: reduce(lambda a, b: a & b, [F.array_contains(self.column[x], at + k) for k, x in enumerate(phrase.leaves) if k]))

    def holds(self, node: object) -> Column:
        if isinstance(node, Phrase):
            return F.size(self.places(node)) > 0
        if isinstance(node, Near):
            every = [F.col(self.column[Leaf(w)]) for w in node.words]
            # a window of distance + 2 places that ends at some member holds all members
            within = lambda last: reduce(lambda a, b: a & b, [F.exists(x, lambda y: y.between(last - node.distance - 1, last)) for x in every])
            return F.exists(F.concat(*every), within)
        if isinstance(node, Without):
            return self.holds(node.keep) & ~self.holds(node.drop)
        parts = [self.holds(x) for x in node.parts]
        if isinstance(node, AtLeast):
            return reduce(lambda a, b: a + b, [x.cast("int") for x in parts]) >= node.count
        return reduce((lambda a, b: a | b) if isinstance(node, AnyOf) else (lambda a, b: a & b), parts)

    def matching(self, node: object) -> DataFrame:
        """(doc_id, page): the pages on which the node holds."""
        return self.pages.where(self.holds(node)).select("doc_id", "page")

    def scored(self, node: object, *flags: tuple[str, object]) -> DataFrame:
        """(doc_id, page, r, flags...): BM25 of the pages on which the node holds, negative, lower for better.

        Numbers of pages are the whole index's; a phrase's own is counted over all pages that have its words. Each flag
        says whether another node, over leaves of this matcher, holds on the page.
        """
        phrases = phrases_of(node)
        counts = [F.size(self.places(x)).alias(f"f{k}") for k, x in enumerate(phrases)]
        rows = self.pages.select("doc_id", "page", "dl", self.holds(node).alias("on"), *counts, *(self.holds(x).alias(name) for name, x in flags))
        n = float(self.index.n_pages)
        seen = rows.agg(*(F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"n{k}") for k in range(len(phrases))))
        weight = []
        for k in range(len(phrases)):
            idf = F.log((n - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
            f = F.col(f"f{k}")
            gain = f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / self.index.mean_length))
            weight.append(F.when(idf <= 0, FLOOR).otherwise(idf) * gain)
        # one row of counts, whatever the index's size
        met = rows.where("on").crossJoin(F.broadcast(seen))
        return met.select("doc_id", "page", (-reduce(lambda a, b: a + b, weight)).alias("r"), *(name for name, _ in flags))
