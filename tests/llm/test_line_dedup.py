import random
from collections import Counter, defaultdict

import pytest

from pagewright.llm import line_dedup as d

from .fixtures import SCHEMA, documents, frame

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    for doc, text, _, site, _ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if cut := line.strip(WHITE):
                sites[cut].add(site or "")
                key = (doc is None, doc if doc is not None else 0, pos)
                first[cut] = min(first.get(cut, key), key)
    out = []
    for doc, text, *_ in rows:
        kept, gone = [], 0
        for pos, line in enumerate((text or "").split("\n")):
            cut = line.strip(WHITE)
            if cut and len(sites[cut]) >= min_sites and first[cut] != (doc is None, doc if doc is not None else 0, pos):
                gone += 1
            else:
                kept.append(line)
        out.append((doc, "\n".join(kept) if gone else text, gone))
    return Counter(out)


def rows_with_lines(seed=8):
    rng = random.Random(seed)
    shared = [f"Shared line number {k}" for k in range(30)]
    rows = []
    for k in range(200):
        lines = [f"own line {k} {j}" for j in range(rng.randint(0, 4))] + [f"  {x}\t" if rng.random() < 0.3 else x for x in shared if rng.random() < 0.02 * (shared.index(x) + 1)]
        rng.shuffle(lines)
        if k % 7 == 0:
            lines += ["", "  ", lines[0] if lines else "x"]
        rows.append((k, "\n".join(lines), "en", None if k % 15 == 0 else f"site{k % 14}", 1))
    return rows + documents() + [(3, rows[3][1], "en", "site3", 1)]


@pytest.mark.parametrize("min_sites", [3, 10])
def test_against_brute_force(spark, min_sites):
    rows = rows_with_lines()
    got = d.drop_lines(frame(spark, rows, clash=("hash", "pos", "key", "first", "sites", "_gone", "_gone_key", "_word")), min_sites=min_sites)
    assert got.columns[-1] == "n_removed_lines" and "sites" in got.columns
    assert Counter((r.doc_id, r.text, r.n_removed_lines) for r in got.collect()) == brute(rows, min_sites)


def test_many_sites_need_the_sketches(spark):
    rows = [(k, "everywhere\nhere and there\n" + str(k) if k % 10 else "everywhere", "en", f"w{k}", 1) for k in range(3000)]
    got = {r.doc_id: r.text for r in d.drop_lines(frame(spark, rows), min_sites=2950, lg_k=8).collect()}
    assert got[1] == "here and there\n1" and got[0] == "everywhere" and got[10] == ""


def test_empty_table(spark):
    assert d.drop_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_first_of_rows_without_ids_and_of_texts_of_one_id(spark):
    rows = [(None, "shared", "en", f"s{k}", 1) for k in range(3)] + [(1, f"again\n{k}", "en", f"s{k}", 1) for k in range(3)]
    got = d.drop_lines(frame(spark, rows), min_sites=3).collect()
    assert Counter(r.text for r in got if r.doc_id is None) == {"shared": 3}  # equal rows of an id are treated alike
    assert sum(r.text.startswith("again") for r in got) == 1 and sum(r.n_removed_lines for r in got) == 2


def test_a_long_text_of_repeated_lines(spark):
    rows = [(k, "same\n" * 200_000 + f"end {k}", "en", f"s{k}", 1) for k in range(3)]
    got = {r.doc_id: r.text for r in d.drop_lines(frame(spark, rows), min_sites=3).collect()}
    assert got[0] == "same\n" + "end 0" and got[1] == "end 1" and got[2] == "end 2"


@pytest.mark.parametrize("words", [1, 1 << 10])
def test_split_off_never_misses_a_row(spark, words):
    from pyspark.sql import functions as F

    from pagewright.llm.common import split_off

    rows = spark.range(3000).select("id", F.xxhash64("id").alias("k"))
    some, rest = split_off(rows, F.col("k"), rows.where("id % 50 = 0").select("k"), words)
    a, b = [r.id for r in some.collect()], [r.id for r in rest.collect()]
    assert sorted(a + b) == list(range(3000)) and {k for k in range(0, 3000, 50)} <= set(a)
    assert words == 1 or len(a) < 100
