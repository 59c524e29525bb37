"""Retrieval evaluation: metrics per query, means with subtotals, percentiles, paired bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def eval_metrics(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, mrr, ndcg at ``k``, and no_answer for queries without judgments (1 if nothing was found).

    ``hits`` has query_id, doc_id, rank, ``qrels`` query_id, doc_id, relevance from 0 to 3; gain 2**relevance - 1, discount log2(rank + 1).
    """
    good = qrels.filter("relevance > 0")
    gain = lambda c: F.pow(F.lit(2.0), c) - 1
    ideal = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.slice(F.sort_array(F.collect_list("relevance"), asc=False), 1, k).alias("best"))
    ideal = ideal.withColumn("ideal", F.aggregate(F.transform("best", lambda r, i: gain(r) / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)).drop("best")
    top = hits.filter(F.col("rank") <= k)
    got = top.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"), F.sum(gain(F.col("relevance")) / F.log2(F.col("rank") + 1)).alias("dcg"))
    any_hit = top.select("query_id").distinct().withColumn("hit", F.lit(True))
    out = queries.select("query_id").join(ideal, "query_id", "left").join(got, "query_id", "left").join(any_hit, "query_id", "left")
    answered = F.col("relevant").isNotNull()
    return out.select(
        "query_id",
        F.when(answered, F.round(F.coalesce("found", F.lit(0)) / F.col("relevant"), 6)).alias("recall"),
        F.when(answered, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"),
        F.when(answered, F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6)).alias("ndcg"),
        F.when(~answered, F.when(F.col("hit"), 0).otherwise(1)).cast("bigint").alias("no_answer"),
    )


def metric_means(metrics: DataFrame) -> DataFrame:
    """system, class (null: all), n and means over (system, class, metric columns); nulls don't count."""
    names = ("recall", "mrr", "ndcg", "no_answer")
    return metrics.groupingSets([["system"], ["system", "class"]], "system", "class").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in names))


def latency_percentiles(runs: DataFrame) -> DataFrame:
    """system, p50, p90, p95, p99 of ``ms``, by nearest rank."""
    return runs.groupBy("system").agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY ms)").alias(f"p{p}") for p in (50, 90, 95, 99)))


def mulberry32(seed: int):
    """The generator's values in [0, 1)."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = state
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def _draws(seed: int, first: int, count: int) -> np.ndarray:
    """Values ``first`` to ``first + count`` of :func:`mulberry32`: the i-th state is the seed and i + 1 times a constant, so none needs those before it."""
    mask = np.uint64(0xFFFFFFFF)
    t = (np.uint64(seed & 0xFFFFFFFF) + np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5)) & mask
    t = ((t ^ (t >> np.uint64(15))) * (t | np.uint64(1))) & mask
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask)) & mask
    return ((t ^ (t >> np.uint64(14))) & mask) / 4294967296


def paired_bootstrap(pairs: DataFrame, seed: int = 1, resamples: int = 10_000, level: float = 0.95, part: int = 250) -> DataFrame:
    """candidate, metric, mean, low, high of the differences (candidate, metric, query_id, difference).

    A group's differences are one array, one number a judged query; its resamples are dealt out ``part`` at a time, and each task draws its own range of the generator, so
    the result does not depend on how they are dealt. Only the resamples' means are sorted.
    """
    alpha = (1 - level) / 2
    held = pairs.filter("difference IS NOT NULL").groupBy("candidate", "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "difference"))), lambda x: x["difference"].cast("double")).alias("values"))
    parts = -(-resamples // part)
    dealt = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(F.xxhash64("candidate", "metric", "part"))

    def means(batches):
        for batch in batches:
            for candidate, metric, values, at in batch[["candidate", "metric", "values", "part"]].itertuples(index=False):
                values, first = np.asarray(values, np.float64), at * part
                count, n = min(part, resamples - first), len(values)
                step = max(1, 2_000_000 // n)
                for low in range(first, first + count, step):
                    some = min(step, first + count - low)
                    picks = (_draws(seed ^ fnv1a(f"{candidate}\0{metric}"), low * n, some * n) * n).astype(np.int64)
                    yield pd.DataFrame({"candidate": candidate, "metric": metric, "resample": np.arange(low, low + some), "resampled": values[picks.reshape(some, n)].mean(1)})

    drawn = dealt.mapInPandas(means, "candidate string, metric string, resample long, resampled double")
    placed = drawn.withColumn("place", F.row_number().over(W.partitionBy("candidate", "metric").orderBy("resampled", "resample")))
    at = lambda i: F.max(F.when(F.col("place") == i + 1, F.col("resampled")))
    ends = placed.groupBy("candidate", "metric").agg(at(math.floor(alpha * resamples)).alias("low"), at(max(0, math.ceil((1 - alpha) * resamples) - 1)).alias("high"))
    mean = held.select("candidate", "metric", (F.aggregate("values", F.lit(0.0), lambda s, x: s + x) / F.size("values")).alias("mean"))
    return mean.join(ends, ["candidate", "metric"]).select("candidate", "metric", "mean", "low", "high")


def paired(metrics: DataFrame, baseline: str, metric: str) -> DataFrame:
    """candidate, metric, query_id, difference of every other system to the baseline."""
    base = metrics.filter(F.col("system") == baseline).select("query_id", F.col(metric).alias("base"))
    return metrics.filter(F.col("system") != baseline).join(base, "query_id").select(F.col("system").alias("candidate"), F.lit(metric).alias("metric"), "query_id", (F.col(metric) - F.col("base")).alias("difference")).filter("difference IS NOT NULL")
