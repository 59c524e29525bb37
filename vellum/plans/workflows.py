"""Compositions of the operators: context for a decision, an explained change, a radar of plans.

Each returns lazy DataFrames; Spark schedules what an action needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, history, search
from ..operators.query import cumulative_budget


@dataclass(frozen=True)
class Knowledge:
    """The tables that workflows read; links are (source, target, line), history is commits and their paths."""

    notes: DataFrame
    links: DataFrame
    commits: DataFrame
    paths: DataFrame


def pack_context(hits: DataFrame, most_bytes: int) -> DataFrame:
    """rank, text of ranked hits (rank, title, snippet) as Markdown sections while they fit in so many UTF-8 bytes.

    ``hits`` is a top-k list, so the running sum's one partition is at most k rows.
    """
    text = F.concat(F.lit("## "), "title", F.lit("\n\n"), "snippet", F.lit("\n\n"))
    return cumulative_budget(hits.select("rank", text.alias("text")).withColumn("size", F.octet_length("text")), "size", "rank", most_bytes).select("rank", "text")


def decision_context(k: Knowledge, question: str, limit: int = 5, most_bytes: int = 32_768) -> dict[str, DataFrame]:
    phrase, terms = search.terms_of(k.notes.sparkSession, question)
    hits = search.exact_search(k.notes, phrase, terms, limit)
    found = k.notes.join(F.broadcast(hits.select("id", "score")), "id")
    snippets = found.select("id", "title", "score", search.exact_snippet(F.col("content"), phrase, terms).alias("snippet"))
    ranked = snippets.orderBy(F.col("score").desc(), "id").limit(limit).withColumn("rank", F.monotonically_increasing_id())
    past = history.git_history(k.commits, k.paths, k.notes.join(F.broadcast(hits.select("id")), "id", "left_semi"), 5)
    return {"hits": hits, "history": past, "context": pack_context(ranked, most_bytes)}


def explain_change(k: Knowledge, query: str, start: str, depth: int = 1, limit: int = 20) -> dict[str, DataFrame]:
    phrase, terms = search.terms_of(k.notes.sparkSession, query)
    near, _ = graph.neighbours(k.links, start, depth, limit)
    return {"hits": search.exact_search(k.notes, phrase, terms, limit), "commits": history.git_search(k.commits, k.paths, k.notes, phrase, terms, limit), "near": near}


def plan_radar(k: Knowledge, plans: DataFrame, limit: int = 15) -> dict[str, DataFrame]:
    """Plans (id, path) by how many notes link to them, and their newest commits."""
    ranked = graph.note_connections(plans, k.links).orderBy(F.col("inbound").desc(), "path").limit(limit)
    return {"plans": ranked, "history": history.git_history(k.commits, k.paths, plans.join(F.broadcast(ranked.select("id")), "id", "left_semi"), 5)}
