"""Change history: commits of notes, co-changed paths, and search by subject and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def commit_note_join(commits: DataFrame, paths: DataFrame, notes: DataFrame) -> DataFrame:
    return commits.join(paths, "hash").join(notes.select("id", "path"), "path").select("id", "path", "hash", "committed_at", "subject")


def git_history(commits: DataFrame, paths: DataFrame, notes: DataFrame, n: int = 5) -> DataFrame:
    """id, hash, rank: the newest ``n`` commits of each note."""
    w = W.partitionBy("id").orderBy(F.col("committed_at").desc(), "hash")
    return commit_note_join(commits, paths, notes).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n).select("id", "hash", "rank")


def cochange(paths: DataFrame, least: int = 2) -> DataFrame:
    """a, b, commits: pairs of paths that at least so many commits change together."""
    a, b = paths.select("hash", F.col("path").alias("a")), paths.select("hash", F.col("path").alias("b"))
    return a.join(b, "hash").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("commits")).filter(F.col("commits") >= least)


def strength(value: Column, query: str, terms: list[str]) -> Column:
    """2 and the query's length in thousandths if it occurs as it is, else the share of its terms that occur."""
    low = F.lower(value)
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return F.when(F.contains(low, F.lit(query)), 2 + len(query) / 1000).otherwise(hits / max(1, len(terms)))


def git_search(commits: DataFrame, paths: DataFrame, notes: DataFrame, query: str, terms: list[str], limit: int = 20) -> DataFrame:
    """id, score: notes by their matching commits, the i-th best counting for 1 / i.

    A commit scores four times its subject, twice its best path, and a little for being recent.
    """
    best = paths.groupBy("hash").agg(F.max(strength(F.col("path"), query, terms)).alias("by_path"))
    scored = commits.join(best, "hash", "left").select("hash", "committed_at", strength(F.col("subject"), query, terms).alias("by_subject"), F.coalesce("by_path", F.lit(0.0)).alias("by_path"))
    noted = scored.join(paths, "hash").join(notes.select("id", "path"), "path")
    recent = W.partitionBy("id").orderBy(F.col("committed_at").desc(), "hash")
    noted = noted.withColumn("index", F.row_number().over(recent) - 1).filter("by_subject > 0 OR by_path > 0")
    noted = noted.withColumn("score", F.col("by_subject") * 4 + F.col("by_path") * 2 + 1 / (100 + F.col("index")))
    place = W.partitionBy("id").orderBy(F.col("score").desc(), "hash")
    total = noted.withColumn("place", F.row_number().over(place)).groupBy("id").agg(F.round(F.sum(F.col("score") / F.col("place")), 6).alias("score"))
    return total.orderBy(F.col("score").desc(), "id").limit(limit)
