import random

import corpus_pipeline as p

from .fixtures import SCHEMA, documents, frame
from .test_crf_quality import corpus


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = corpus(240)
    clean = [d for d, y in zip(docs, labels) if y[1]]
    items = [(k, " ".join(w for w in clean[k][1].split())) for k in range(2)]
    docs = [(k, t, "en", f"s{k % 12}", len(t)) for k, t, *_ in docs]
    copies = [(1000 + k, clean[5][1] + ("" if k % 2 else " end"), "en", f"s{k % 3}", 1) for k in range(8)]
    passage = clean[0][1].replace("\n", " ")
    leak = (2000, " ".join(rng.choice(["quiet", "river", "stone", "window", "letter", "garden"]) + str(rng.randint(0, 9)) for _ in range(90)) + ". " + passage, "en", "s1", 1)
    more = [(None if r[0] is None else r[0] + 5000, *r[1:]) for r in documents()]
    frame(spark, docs + copies + [leak] + more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == list(p.COLUMNS)
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    bad = {k for k, y, _ in labels if not y}
    assert len(bad & seen["quality"].keys()) < 0.1 * len(bad) and len(seen["quality"].keys() & {c[0] for c in clean}) > 0.95 * len(clean)
    assert len(seen["near_duplicates"].keys() & {*range(1000, 1008), clean[5][0]}) == 1
    assert passage in seen["near_duplicates"][2000] and passage[20:90] not in seen["benchmark"].get(2000, "")
    packed = p.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == seen["benchmark"].keys()


def test_run_over_hard_rows_and_empty_tables(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    for k in "ab":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
    assert p.run(spark, f"{tmp_path}/a").count() > 0
    assert p.run(spark, f"{tmp_path}/b").count() == 0
