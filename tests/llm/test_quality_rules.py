import math
import random
import re
from collections import Counter

from pagewright.llm import quality_rules as q
from pagewright.llm.common import written

from .fixtures import SCHEMA, documents, frame

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def base(text):
    text = text or ""
    w = re.findall(f"[^{WHITE}]+", text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(f"[^{WHITE}]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def prose(rng, lang, n):
    common = q.COMMON_WORDS[lang]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(n))


def rows_of_prose():
    rng = random.Random(6)
    rows = [(k, prose(rng, ["en", "fr"][k % 2], rng.randint(60, 300)), ["en", "fr"][k % 2], "s", 1) for k in range(60)]
    rows += [(100 + k, " ".join(f"{w}***" for w in prose(rng, "en", 120).split()), "en", "s", 1) for k in range(3)]
    rows += [(200 + k, " | ".join("x" * rng.randint(3, 9) + str(rng.random()) for _ in range(90)), None, "s", 1) for k in range(3)]
    rows += [(300, "\n".join(["a b c d e\x0bf"] * 20), "en", "s", 1), (301, "one two three four\n" * 3 + prose(rng, "en", 100), "en", "s", 1)]
    return rows


def test_base_against_brute_force(spark):
    rows = documents() + rows_of_prose()
    got = q.judge(frame(spark, rows, clash=("w", "h", "words", "classes", "id", "kept"))).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert have == Counter((r[0], *base(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_divergence_tells_prose_from_junk(spark):
    got = {r.doc_id: r for r in q.judge(frame(spark, rows_of_prose())).collect()}
    assert all(got[k].kept for k in range(60))
    assert not any(got[k].kept for k in (100, 101, 102, 200, 201, 202, 300))


def test_distance_against_a_plain_version(spark):
    from pyspark.sql import functions as F

    counts, reference = [3, 0, 5, 2], [10, 4, 0, 7]
    df = spark.createDataFrame([(counts, 10), ([0, 0, 0, 0], 0)], "c array<long>, n long")
    got = [r.d for r in df.select(q.distance(F.col("c"), F.col("n"), reference).alias("d")).collect()]
    p, r = [x / 10 for x in counts], [x / 21 for x in reference]
    want = sum(a * math.log2(2 * a / (a + b)) if a else 0 for a, b in zip(p, r)) + sum(b * math.log2(2 * b / (a + b)) if b else 0 for a, b in zip(p, r))
    assert abs(got[0] - math.sqrt(want / 2)) < 1e-12 and got[1] == 1.0


def test_without_references_and_empty(spark):
    assert q.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    got = q.judge(frame(spark, rows_of_prose()).drop("lang")).collect()
    assert all(r.words_distance is None and r.kept == (not r.base_failed) for r in got)


def rows_of_other_languages():
    rng = random.Random(8)
    small = {"it": "il che di la per un sono con non una del si da come gli".split(), "ru": "и в не на я что он с как это по но из у за".split()}
    letters = {"it": "aeiorstnlcd", "ru": "абвгдеиклмнопрст"}

    def text(lang, n):
        return " ".join(rng.choice(small[lang]) if rng.random() < 0.4 else "".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 9))) for _ in range(n))

    rows = [(1000 + k, text(lang, rng.randint(80, 300)), lang, "s", 1) for k, lang in enumerate(["it", "ru"] * 60)]
    rows += [(2000 + k, text("ru", 150), "bg", "s", 1) for k in range(3)]  # too few to learn from
    rows += [(3000 + k, " ".join(f"{w}#*$%" for w in text("it", 120).split()), "it", "s", 1) for k in range(3)]
    return [*rows, (4000, "", "it", "s", 1), (4001, None, "ru", "s", 1), (4002, text("it", 60), "", "s", 1)]


def test_every_language_has_its_own_reference(spark, tmp_path):
    import duckdb

    rows = rows_of_prose() + rows_of_other_languages()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    got = {r.doc_id: r for r in q.judge(docs).collect()}
    assert all(got[k].kept for k in (*range(1000, 1120), *range(2000, 2003), 4002))
    assert not any(got[k].kept for k in (*range(3000, 3003), 4000, 4001, 100, 200))
    assert got[2000].words_distance is None and got[1000].words_distance < 0.4 > got[1001].words_distance
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(q.oracle_sql()).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got.values())


def test_learned_words_against_a_plain_count(spark):
    rows = rows_of_other_languages()
    got = {r.of: r for r in q.learned(written(q.measured(frame(spark, rows)), "measured")).collect()}
    assert set(got) == {"it", "ru"}
    for lang in got:
        texts = [r[1] for r in rows if r[2] == lang and not base(r[1])[-1]]
        words = Counter(w for t in texts for w in re.findall(f"[^{WHITE}]+", t))
        top = sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))[: q.LEARNED_WORDS]
        assert got[lang].own == [w for w, _ in top]
        assert abs(sum(got[lang].own_words) - 1) < 1e-9 and abs(got[lang].own_words[0] - top[0][1] / sum(words.values())) < 1e-12
