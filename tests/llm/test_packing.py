import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pagewright.llm import packing

from .fixtures import SCHEMA, documents, frame


def test_pieces_hold_each_id_once(spark):
    rows = documents()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows]
    got = packing.pack(frame(spark, clash=("start", "length", "rank", "ids", "offset")), length=256, with_ids=True).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 256
    for doc, own in zip((r[0] for r in rows), ids):
        mine = sorted(by[doc], key=lambda r: r.start)
        copies = [x[0] for x in Counter(r.start for r in mine).items() if x[0] == 0] and sum(r.start == 0 for r in mine)
        assert sum(r.length for r in mine) == copies * len(own) and {r.doc_tokens for r in mine} == {len(own)}
        for r in mine:
            assert r.ids == own[r.start : r.start + r.length]
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    for parts in packs.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 256
    assert sorted(packs) == list(range(len(packs)))


def test_added_tokens_inside_texts():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    for text in (f"a {mark} b", mark, mark * 3, f"one{mark}two\n\n{mark}  ", f" {mark} ", f"<|endoftext|{mark}|>", "<|ENDOFTEXT|>", "<|endoftext|", f"é  {mark}'s", f"a \n{mark}\n b", f"a  {mark}  b", f"a   <b  {mark}", f"\u00a0 {mark}\x1c x"):
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert packing.token_ids(f"a {mark} b").tolist() == [64, 220, 50256, 275, 0]


def test_cut_texts_have_the_ids_of_whole_ones(monkeypatch):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    marks = [" ", "  ", "   ", "\n", "\n ", " \n", "\t", "\u00a0", "\u2003 ", "\x1c", "\x85", "'s", " 's", "é", "ab", "Word", "12", " 7", "...", " <", "<|endoftext|>", "日本", "\U0001f600", "'", "’"]
    monkeypatch.setattr(packing, "STRETCH", 40)
    monkeypatch.setattr(packing, "RUN", 25)
    assert packing.encoder().fast is not None
    for _ in range(3000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 60)))
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_long_texts_of_one_kind():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" * 300_000, "ab " * 500_000, " \n" * 300_000):
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def plain_shortest_pack_first(histogram, length):
    """Each length, longest first, into the shortest pack, a new one if that has no room: what each pack holds."""
    packs = []
    for size in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = min(range(len(packs)), key=packs.__getitem__, default=None)
        if at is not None and packs[at] + size <= length:
            packs[at] += size
        else:
            packs.append(size)
    return sorted(packs)


def test_patterns_against_a_plain_version():
    rng = random.Random(12)
    for _ in range(60):
        length = rng.choice([16, 64, 100])
        histogram = {rng.randint(1, length): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
        found = packing.patterns(histogram, length)
        assert sorted(sum(p) for p, n in found for _ in range(n)) == plain_shortest_pack_first(histogram, length)


def test_pieces_hold_added_tokens(spark):
    rows = [(1, "a <|endoftext|> b", "en", "s", 1), (2, "a b", "en", "s", 1)]
    got = {r.doc_id: (r.ids, r.doc_tokens) for r in packing.pack(frame(spark, rows), with_ids=True).collect()}
    assert got == {1: ([64, 220, 50256, 275, 0], 5), 2: ([64, 275, 0], 3)}


def test_patterns_place_every_length_with_little_padding():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 1024): rng.randint(1, 300) for _ in range(rng.randint(1, 400))}
        found = packing.patterns(histogram)
        assert Counter({k: sum(n * p.count(k) for p, n in found) for k in histogram}) == Counter(histogram)
        assert all(sum(p) <= 1024 and n > 0 for p, n in found)
        total, packs = sum(k * n for k, n in histogram.items()), sum(n for _, n in found)
        assert packs <= max(1.5 * total / 1024 + 1, sum(n for k, n in histogram.items() if k > 512) + 0.6 * total / 1024 + 1)
    assert packing.patterns({}) == []
    assert packing.patterns({100: 25}) == [((100,) * 10, 2), ((100,) * 5, 1)]


def test_sequences_are_padded_unless_a_power_of_two(spark):
    got = packing.sequences(packing.pack(frame(spark), length=256, with_ids=True), length=256).collect()
    for r in got:
        assert len(r.ids) == 256 or len(r.ids) == r.tokens and r.tokens & (r.tokens - 1) == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
