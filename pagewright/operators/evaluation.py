"""Measures of retrieval: nDCG, precision, reciprocal rank, pooling, paired tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gain(grade):
    return F.pow(F.lit(2.0), grade) - 1


def ndcg(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg): run has query, item, rank from 1; judged has query, item, grade. Unjudged items have grade 0; the
    ideal order is over all judged items; a query without a positive grade has 0."""
    g = judged.select(F.col("query").alias("q"), F.col("item").alias("i"), "grade")
    met = run.where(F.col("rank") <= k).join(g, (F.col("query") == F.col("q")) & (F.col("item") == F.col("i")), "left")
    dcg = met.groupBy("query").agg(F.sum(_gain(F.coalesce("grade", F.lit(0))) / F.log2(F.col("rank") + 1)).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "item"))
    ideal = judged.withColumn("place", place).where(F.col("place") <= k).groupBy("query").agg(F.sum(_gain(F.col("grade")) / F.log2(F.col("place") + 1)).alias("ideal"))
    both = ideal.join(dcg, "query", "left")
    return both.select("query", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def precision_and_mrr(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query, precision, mrr): the share of the first k with a grade of 1 or more, and 1 / the first such rank."""
    g = judged.select(F.col("query").alias("q"), F.col("item").alias("i"), "grade")
    met = run.join(g, (F.col("query") == F.col("q")) & (F.col("item") == F.col("i")), "left").withColumn("good", F.coalesce("grade", F.lit(0)) >= 1)
    first = F.min(F.when(F.col("good"), F.col("rank")))
    return met.groupBy("query").agg((F.count_if(F.col("good") & (F.col("rank") <= k)) / k).alias("precision"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"))


def by_document(run: DataFrame) -> DataFrame:
    """(query, item, rank): pages' documents in the order of their first pages. run has query, doc, rank."""
    first = run.groupBy("query", F.col("doc").alias("item")).agg(F.min("rank").alias("first"))
    return first.select("query", "item", F.row_number().over(Window.partitionBy("query").orderBy("first", "item")).alias("rank"))


def win_tie_loss(a: DataFrame, b: DataFrame, close: float = 1e-9) -> DataFrame:
    """(win, tie, loss) of a against b by (query, ndcg); queries that only one has are left out."""
    d = a.alias("a").join(b.alias("b"), "query").select((F.col("a.ndcg") - F.col("b.ndcg")).alias("d"))
    return d.agg(F.count_if(F.col("d") > close).alias("win"), F.count_if(F.abs("d") <= close).alias("tie"), F.count_if(F.col("d") < -close).alias("loss"))


def pool(runs: list[DataFrame], depth: int = 10) -> DataFrame:
    """(query, item): what any run has among its first `depth`."""
    tops = [r.where(F.col("rank") <= depth).select("query", "item") for r in runs]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.distinct()


def paired_test(differences: list[float], draws: int = 2000, seed: int = 0) -> float:
    """Two-sided p of a sign-flip permutation test over the queries' differences."""
    d = np.asarray(differences, float)
    if not len(d) or not d.any():
        return 1.0
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (draws, len(d)))
    return float((np.count_nonzero(np.abs(signs @ d) >= abs(d.sum()) - 1e-12) + 1) / (draws + 1))
