"""Changes of notes and relations as an append-only table of assertions; the last one of each key holds.

``assertions`` has seq, op (``add`` or ``remove``), source, predicate, target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_predicate


def revision(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def current_relations(assertions: DataFrame) -> DataFrame:
    """source, predicate, target that were added last; adding or removing twice is once."""
    keyed = assertions.withColumn("predicate", normalize_predicate(F.col("predicate")))
    return keyed.groupBy("source", "predicate", "target").agg(F.max_by("op", "seq").alias("op")).filter("op = 'add'").drop("op")


def list_relations(assertions: DataFrame, note: str) -> DataFrame:
    out = current_relations(assertions)
    return out.filter(F.col("source") == note).select(F.lit("out").alias("direction"), "predicate", F.col("target").alias("other")).unionByName(out.filter(F.col("target") == note).select(F.lit("in").alias("direction"), "predicate", F.col("source").alias("other"))).orderBy("direction", "predicate", "other")


def create_notes(wanted: DataFrame, notes: DataFrame) -> DataFrame:
    """path, outcome: ``created`` where there is no such note, ``unchanged`` where it has the same text, else ``conflict``."""
    have = notes.select("path", revision(F.col("text")).alias("have"))
    state = F.when(F.col("have").isNull(), "created").when(F.col("have") == revision(F.col("text")), "unchanged").otherwise("conflict")
    return wanted.join(have, "path", "left").select("path", state.alias("outcome"))


def edit_notes(edits: DataFrame, notes: DataFrame) -> DataFrame:
    """path, outcome, text of edits (path, expected revision, text): those whose expected revision isn't the current one are ``stale``."""
    have = notes.select("path", F.col("text").alias("old"))
    outcome = F.when(F.col("old").isNull(), "missing").when(revision(F.col("old")) != F.col("expected"), "stale").otherwise("written")
    return edits.join(have, "path", "left").select("path", outcome.alias("outcome"), F.when(outcome == "written", F.col("text")).otherwise(F.col("old")).alias("text"))


def clip_markdown(title: Column, url: Column, date: Column, body: Column) -> Column:
    """A captured page as a note: front matter with quoted values, then the text."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\\"])", r"\\$1"), r"\s*\n\s*", " "), F.lit('"'))
    return F.concat(F.lit("---\ntitle: "), quoted(title), F.lit("\nsource: "), quoted(url), F.lit("\nclipped: "), date.cast("string"), F.lit("\n---\n\n# "), F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))
