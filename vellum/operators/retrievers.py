"""Retrievers with one contract: a table of queries in; query_id, doc_id, rank and score out, for all queries at once.

No query is a loop on the driver: phrases and terms of all queries are found by one automaton, breadth-first search keeps its frontiers in tables keyed by query
and seed, and limits are cut by windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_text, search_terms
from .mentions import occurrences
from .query import checkpointed
from .search import IDENTITY, PHRASE, TERM, folded_fields, rrf_fuse

#: The groups of repository memory in the order in which they are listed.
GROUPS = ("maintainedKnowledge", "activePlans", "datedResearch", "reports", "historicalPlans")


def stable_hits(candidates: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """query_id, doc_id, rank, score of candidates (query_id, doc_id, score and what ``order`` names): each document once, at its first place."""
    once = W.partitionBy("query_id", "doc_id").orderBy(*order)
    first = candidates.withColumn("vellum_place", F.row_number().over(once)).filter("vellum_place = 1")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "doc_id", "rank", F.col("score").cast("double").alias("score"))


def _points(of: dict[str, int], field: Column) -> Column:
    out = F.lit(0)
    for name, n in of.items():
        out = F.when(field == name, n).otherwise(out)
    return out


def exact_scores(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, path, identity, score: exact search of many queries (query_id, text) over notes (id, path, title, aliases, tags, metadata_text, content).

    The same points as for one query; only notes that hold a phrase or term, or are one by name, meet a query. A null or blank query finds nothing.
    """
    asked = queries.select("query_id", norm_text(F.trim(F.coalesce("text", F.lit("")))).alias("what"), search_terms(F.coalesce("text", F.lit(""))).alias("terms")).filter("what <> ''")
    asked = checkpointed(asked)
    wanted = asked.select("query_id", F.lit("phrase").alias("kind"), "what").union(asked.select("query_id", F.lit("term"), F.explode("terms")))
    rows = folded_fields(notes)
    fields = F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"f_{k}").alias("content")) for k in PHRASE))
    texts = rows.select("id", F.explode(fields).alias("f")).filter("f.content <> ''").select(F.struct("id", "f.field").alias("id"), "f.content")
    found = occurrences(texts, wanted.select(F.col("what").alias("phrase")), fold=False, whole=False)
    found = found.select(F.col("id.id").alias("id"), F.col("id.field").alias("field"), F.col("phrase").alias("what")).join(wanted, "what")
    phrase = F.col("kind") == "phrase"
    hits = found.select("query_id", "id", phrase.alias("phrase"), F.lit(False).alias("identity"), F.when(~phrase, F.col("what")).alias("term"), F.when(phrase, _points(PHRASE, F.col("field"))).otherwise(_points(TERM, F.col("field"))).alias("points"))
    names = F.concat(F.array(F.struct(F.lit("title").alias("kind"), F.col("f_title").alias("what"))), F.transform(F.coalesce("f_aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("alias").alias("kind"), a.alias("what"))), F.transform(F.split("f_path", "\n"), lambda p: F.struct(F.lit("path").alias("kind"), p.alias("what"))))
    named = rows.select("id", F.explode(F.array_distinct(names)).alias("n")).select("id", "n.kind", "n.what").join(asked.select("query_id", "what"), "what")
    named = named.select("query_id", "id", "kind").distinct().select("query_id", "id", F.lit(False), F.lit(True), F.lit(None).cast("string"), _points(IDENTITY, F.col("kind")))
    summed = hits.union(named).groupBy("query_id", "id").agg(F.bool_or("phrase").alias("phrase"), F.bool_or("identity").alias("identity"), F.count_distinct("term").alias("matched"), F.sum("points").alias("points"))
    sizes = asked.select("query_id", F.size("terms").alias("n"))
    needed = F.when(F.col("n") <= 1, F.col("n")).otherwise(F.least(F.lit(3), F.ceil(F.col("n") / 2)))
    kept = summed.join(sizes, "query_id").filter(F.col("identity") | F.col("phrase") | (F.col("matched") >= needed)).filter("points > 0")
    share = F.when(F.col("n") > 0, F.floor(F.col("matched") * 100 / F.col("n") + 0.5)).otherwise(0)
    return kept.join(notes.select("id", "path"), "id").select("query_id", F.col("id").alias("doc_id"), "path", "identity", (F.col("points") + share).cast("bigint").alias("score"))


def exact_hits(scores: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of :func:`exact_scores` for each query: identities, then by score and path."""
    return stable_hits(scores, [F.desc("identity"), F.desc("score"), F.collate("path", "UNICODE")], limit)


def metadata_hits(leaves: DataFrame, filters: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """Notes that pass all of a query's filters (query_id, field, value), in the order of their folded paths.

    ``leaves`` has id, field and value, folded; several values of a field are an array's elements. ``paths`` has id and path. Scores are null.
    """
    asked = filters.select("query_id", "field", norm_text(F.col("value")).alias("value")).distinct()
    met = asked.join(leaves.distinct(), ["field", "value"]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("met"))
    whole = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"))
    passed = met.join(whole, "query_id").filter("met = all").join(paths.select("id", norm_text(F.col("path")).alias("path")), "id")
    return stable_hits(passed.select("query_id", F.col("id").alias("doc_id"), "path", F.lit(None).cast("double").alias("score")), ["path", "doc_id"], limit)


def neighbourhoods(edges: DataFrame, starts: DataFrame, depth: int, limit: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from many starts (query_id, seed_rank, seed): (query_id, seed_rank, node, distance), and which searches the limit cut.

    Each start is a search of its own, of at most ``limit`` nodes with itself. A level is one join of all frontiers with the edges (source, target). New nodes are admitted in
    the order of the node that reached them (code units) and then of the edge's ends (ICU), as many as the limit leaves; a window cuts each search, and each level is
    written, so that nothing comes to the driver and a lost executor repeats one level.
    """
    if not 1 <= depth <= 10 or not 1 <= limit <= 1000 or direction not in ("in", "out", "both"):
        raise ValueError("depth is 1 to 10, limit 1 to 1000, direction in, out or both")
    key = ["query_id", "seed_rank"]
    ends = lambda a, b: edges.select(F.col(a).alias("by"), F.col(b).alias("node"), F.collate("source", "UNICODE").alias("s"), F.collate("target", "UNICODE").alias("t"))
    ways = [ends("source", "target")] * (direction != "in") + [ends("target", "source")] * (direction != "out")
    steps = ways[0] if len(ways) == 1 else ways[0].union(ways[1])
    visited = starts.select(*key, F.col("seed").alias("node"), F.lit(0).alias("distance"))
    frontier, cut = visited, starts.select(*key).limit(0)
    for level in range(1, depth + 1):
        reached = frontier.select(*key, F.col("node").alias("by")).join(steps, "by").join(visited, [*key, "node"], "left_anti")
        best = reached.groupBy(*key, "node").agg(F.min(F.struct("by", "s", "t")).alias("order"))
        room = visited.groupBy(*key).agg((F.lit(limit) - F.count(F.lit(1))).alias("room"))
        place = F.row_number().over(W.partitionBy(*key).orderBy("order", "node"))
        # The window's own limit keeps one search's candidates from meeting in one task whole; one more than fit tells that it was cut.
        first = best.withColumn("place", place).filter(F.col("place") <= limit + 1).join(room, key).filter(F.col("place") <= F.col("room") + 1)
        first = checkpointed(first.select(*key, "node", F.lit(level).alias("distance"), (F.col("place") > F.col("room")).alias("over")))
        cut = cut.union(first.filter("over").select(*key))
        frontier = first.filter("NOT over").select(*key, "node", "distance")
        visited = checkpointed(visited.union(frontier))
    return visited, cut.distinct()


def graph_hits(nodes: DataFrame, limit: int) -> DataFrame:
    """Notes that the searches of a query's seeds reached, at the distance of the first seed that did: the nearest first, then by seed and path; score 1 / (distance + 1)."""
    inside = W.partitionBy("query_id", "seed_rank").orderBy("distance", F.collate("node", "UNICODE"))
    best = nodes.withColumn("index", F.row_number().over(inside)).groupBy("query_id", "node").agg(F.min(F.struct("seed_rank", "distance", "index")).alias("b"))
    flat = best.select("query_id", F.col("node").alias("doc_id"), "b.distance", "b.seed_rank", "b.index", (1 / (F.col("b.distance") + 1)).alias("score"))
    return stable_hits(flat, ["distance", "seed_rank", "index", F.collate("doc_id", "UNICODE")], limit)


def seeds_of(hits: DataFrame, most: int) -> DataFrame:
    """query_id, seed_rank, seed: the first hits of a search as starts of another."""
    return hits.filter(F.col("rank") <= most).select("query_id", F.col("rank").alias("seed_rank"), F.col("doc_id").alias("seed"))


def hybrid_hits(exact: DataFrame, index: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """query_id, doc_id, rank, score, exact, semantic: an exact lane and an index lane fused by rank; documents that are the query by name come first.

    ``exact`` has query_id, doc_id, rank and identity, ``index`` query_id, doc_id and rank.
    """
    lane = lambda t, name: t.select(F.lit(name).alias("lane"), F.lit(1.0).alias("weight"), "query_id", "doc_id", "rank")
    fused = rrf_fuse(lane(exact, "exact").unionByName(lane(index, "index")), k).drop("rank")
    pins = exact.groupBy("query_id", "doc_id").agg(F.bool_or("identity").alias("pin"), F.lit(True).alias("in_exact"))
    held = index.select("query_id", "doc_id", F.lit(True).alias("in_index")).distinct()
    out = fused.join(pins, ["query_id", "doc_id"], "left").join(held, ["query_id", "doc_id"], "left").na.fill(False, ["pin", "in_exact", "in_index"])
    w = W.partitionBy("query_id").orderBy(F.desc("pin"), F.desc("score"), F.collate("doc_id", "UNICODE"))
    ranked = out.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "doc_id", "rank", "score", F.col("in_exact").alias("exact"), F.col("in_index").alias("semantic"))


def path_hits(contexts: DataFrame, memory: DataFrame, limit: int) -> DataFrame:
    """Context hubs (query_id, doc_id, rank), then repository memory (query_id, group, doc_id, rank) group by group; scores are null."""
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group"))
    listed = contexts.select("query_id", "doc_id", F.lit(0).cast("bigint").alias("part"), "rank").unionByName(memory.select("query_id", "doc_id", place.alias("part"), "rank"))
    return stable_hits(listed.withColumn("score", F.lit(None).cast("double")), ["part", "rank", "doc_id"], limit)


def history_hits(named: DataFrame, searched: DataFrame, limit: int) -> DataFrame:
    """Notes that a query names and that have a history (query_id, doc_id, rank), then what a search of the history found (query_id, doc_id, rank, score), with its scores."""
    both = named.select("query_id", "doc_id", F.lit(0).alias("part"), F.col("rank").alias("place")).unionByName(searched.select("query_id", "doc_id", F.lit(1).alias("part"), F.col("rank").alias("place")))
    scored = both.join(searched.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
    return stable_hits(scored, ["part", "place", "doc_id"], limit)


def adapted(queries: DataFrame, lanes: dict[str, tuple[Column, DataFrame]]) -> DataFrame:
    """query_id, system, status, hits: for each system whether a query has its input (a condition on ``queries``), and how many hits it got."""
    parts = None
    for name, (has_input, hits) in lanes.items():
        counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        part = queries.select("query_id", F.coalesce(has_input, F.lit(False)).alias("given")).join(counted, "query_id", "left")
        part = part.select("query_id", F.lit(name).alias("system"), F.when(F.col("given"), "ready").otherwise("unavailable").alias("status"), F.when(F.col("given"), F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("hits"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
