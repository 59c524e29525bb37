"""Captured discussions: nested JSON flattened level by level, completeness, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bodies that stand for removed posts.
REMOVED = ("[deleted]", "[removed]")


def flatten(documents: DataFrame, replies: str = "replies", most_depth: int = 32) -> DataFrame:
    """document, sort, depth, id, author, body, kind of (document, json) trees, one level of replies a step.

    ``sort`` lists each ancestor's place among its siblings, so ordering by it gives reading order.
    Levels deeper than ``most_depth`` are an error and not dropped.
    """
    level = documents.select("document", F.array(F.lit(0)).alias("sort"), F.try_parse_json("json").alias("v")).filter("v IS NOT NULL")
    out = None
    for depth in range(most_depth + 1):
        text = lambda n: F.try_variant_get("v", f"$.{n}", "string")
        kind = F.when(text("kind") == "more", "more").when(text("body").isNull() | text("body").isin(*REMOVED), "unavailable").otherwise("content")
        rows = level.select("document", "sort", F.lit(depth).alias("depth"), text("id").alias("id"), text("author").alias("author"), text("body").alias("body"), kind.alias("kind"))
        out = rows if out is None else out.unionByName(rows)
        below = level.select("document", "sort", F.posexplode(F.try_variant_get("v", f"$.{replies}", "array<variant>")).alias("at", "v"))
        level = below.select("document", F.concat("sort", F.array("at")).alias("sort"), "v")
        if level.isEmpty():
            return out
    raise ValueError(f"a tree is deeper than {most_depth} levels")


def from_edges(items: DataFrame) -> DataFrame:
    """document, id, root, depth of flat items (document, id, parent): the reply forest of sites that list children or parents."""
    from .graph import thread_depths

    t = thread_depths(items.select(F.col("document").alias("conv_id"), F.col("id").alias("turn"), F.col("parent").alias("parent_turn")))
    return t.select(F.col("conv_id").alias("document"), F.col("turn").alias("id"), "root", "depth")


def counts(flat: DataFrame) -> DataFrame:
    """document, items, replies, unavailable, more."""
    return flat.groupBy("document").agg(F.count_if(F.col("kind") == "content").alias("items"), F.count_if((F.col("kind") == "content") & (F.col("depth") > 0)).alias("replies"), F.count_if(F.col("kind") == "unavailable").alias("unavailable"), F.count_if(F.col("kind") == "more").alias("more"))


def structured_status(counted: DataFrame) -> DataFrame:
    """document, status: ``unsupported`` without content, ``partial`` with placeholders left, else ``complete``."""
    return counted.select("document", F.when(F.col("items") == 0, "unsupported").when((F.col("more") > 0) | (F.col("unavailable") > F.col("items")), "partial").otherwise("complete").alias("status"))


def outline(flat: DataFrame) -> DataFrame:
    """document, text: the discussion as a Markdown outline. A document is one row, as long as the discussion."""
    body = F.when(F.col("kind") == "content", F.concat(F.lit("**"), F.coalesce("author", F.lit("?")), F.lit("**: "), F.regexp_replace("body", r"\s*\n\s*", " "))).otherwise(F.concat(F.lit("_"), "kind", F.lit("_")))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), body)
    rows = F.array_sort(F.collect_list(F.struct("sort", line.alias("line"))))
    return flat.groupBy("document").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
