"""Small tables with the hard cases: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

SYLLABLES = ["the", "on", "er", "an", "ti", "re", "ou", "ble", "st", "ha", "nd", "ing"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def documents(seed=1, n=120):
    rng = random.Random(seed)
    rows, base = [], words(rng, 90)
    for k in range(n):
        w = words(rng, rng.choice([0, 1, 2, 5, 30, 80, 200]))
        if k % 6 == 0:
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = "changed"
        text = " ".join(w) if k % 5 else "\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7))
        rows.append((k, text, ["en", "fr", None][k % 3], f"s{k % 4}", len(text)))
    rows += [(900, None, "en", None, None), (901, "", None, "s1", 0), (902, " \n\t ", "fr", "s1", 4), (None, "no id here at all", "en", "s2", 17)]
    rows += [rows[7], rows[7]]
    rows.append((903, " ".join(words(rng, 6000)), "en", "s3", 1))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, clash=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    for name in clash:
        df = df.withColumn(name, F.lit("clash"))
    return df
