"""Phrases in texts: an automaton over all phrases at once, and what is built on it: mentions, their support, judgments.

Phrases go to the tasks in blocks of bounded size; each block is one scan of the texts, which don't shuffle. A task walks each text once, whatever
the number of phrases, and gives a row for each (text, phrase) that is found. Nothing is looked up by words, so phrases inside words, beside letters of any
alphabet or without any letter are found alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .query import checkpointed

#: Bytes of phrases in a block; an automaton takes some fifty times as much.
BLOCK = 2 << 20
#: Fewest UTF-16 units of a phrase that can be a mention.
SHORTEST = 4
#: Pieces of evidence for a candidate.
PIECES = 100
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class Phrases:
    """Distinct phrases, and the automaton that finds them, built once a worker."""

    def __init__(self, phrases: list[str]):
        self.phrases = phrases

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, p in enumerate(self.phrases):
            out.add_word(p, i)
        out.make_automaton()
        return out

    def first(self, text: str, whole: bool) -> dict[int, int]:
        """Each phrase's first offset in the text, in code points.

        With ``whole``, an end of the phrase that is an ASCII letter or digit must not stand next to another one.
        """
        found: dict[int, int] = {}
        for last, i in self.automaton.iter(text) if self.phrases else ():
            if i in found:
                continue
            phrase = self.phrases[i]
            at = last + 1 - len(phrase)
            if whole and (phrase[0] in _WORD and at and text[at - 1] in _WORD or phrase[-1] in _WORD and last + 1 < len(text) and text[last + 1] in _WORD):
                continue
            found[i] = at
        return found


def occurrences(texts: DataFrame, phrases: DataFrame, fold: bool = True, whole: bool = True, block: int = BLOCK) -> DataFrame:
    """id, phrase, offset, line: the first place of each of the phrases (column ``phrase``) in each text (``id``, ``content``).

    ``fold`` compares in lower case and gives phrases in lower case; ``whole`` asks for word ends, see :meth:`Phrases.first`. Offsets count code points of the
    text as compared, lines from 1. Null texts hold nothing; null and empty phrases are in no text. Repeated phrases count once, repeated rows of
    ``texts`` each give their rows.
    """
    spark = texts.sparkSession
    wanted = phrases.select((F.lower("phrase") if fold else F.col("phrase")).alias("phrase")).filter("phrase <> ''").distinct()
    blocks = max(1, -(-(wanted.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0) // block))
    wanted = checkpointed(wanted.withColumn("block", F.expr(f"pmod(xxhash64(phrase), {blocks})")))
    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("phrase", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("line", T.LongType())])
    rows = texts.select("id", "content").filter("content <> ''")

    def found_in(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                at, names, offsets, lines = [], [], [], []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    folded = text.lower() if fold else text
                    for i, start in held.first(folded, whole).items():
                        at.append(r)
                        names.append(held.phrases[i])
                        offsets.append(start)
                        lines.append(text.count("\n", 0, start) + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.int64())], names=schema.names)

        return rows.mapInArrow(run, schema)

    parts = []
    for b in range(blocks):
        held = [r.phrase for r in wanted.filter(F.col("block") == b).select("phrase").collect()]
        part = found_in(spark.sparkContext.broadcast(Phrases(sorted(p.lower() for p in held) if fold else sorted(held))))
        parts.append(part if blocks == 1 else checkpointed(part))
    return reduce(DataFrame.union, parts)


def candidate_phrases(notes: DataFrame) -> DataFrame:
    """target, phrase: titles and aliases of notes (id, title, aliases), trimmed, of at least four UTF-16 units, with an ASCII letter."""
    all_of = notes.select(F.col("id").alias("target"), F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase"))
    trimmed = all_of.withColumn("phrase", F.regexp_replace("phrase", r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", ""))
    return trimmed.filter((_units("phrase") >= SHORTEST) & F.col("phrase").rlike("[A-Za-z]")).distinct()


def _units(column: str):
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(column, "UTF-16BE")) / 2


def mention_pairs(notes: DataFrame, phrases: DataFrame, linked: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, target, phrase, offset, line: where a note's text (id, content) names another note that it is not linked with.

    ``phrases`` has target and phrase. Phrases that several notes own are left out; of a target's phrases the longest that occurs counts, at its first
    place. ``linked`` has source and target, in either direction. The given spelling of a phrase comes back in lower case.
    """
    owned = phrases.select(F.lower("phrase").alias("phrase"), "target").distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("target")).filter("n = 1").drop("n")
    hits = occurrences(notes, owned, block=block).withColumnRenamed("id", "source").join(owned, "phrase").filter("source <> target")
    both = linked.select("source", "target").union(linked.select("target", "source")).distinct()
    hits = hits.join(both, ["source", "target"], "left_anti")
    first = W.partitionBy("source", "target").orderBy(_units("phrase").desc(), F.collate("phrase", "UNICODE"), "phrase", "offset")
    return hits.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("source", "target", "phrase", "offset", "line")


def mention_support(mentions: DataFrame, explicit: DataFrame, least: int = 1, pieces: int = PIECES) -> DataFrame:
    """source, target, support, truncated, evidence of mentions (source, target, line, phrase): a row for each direction.

    Pairs that ``explicit`` (source, target) joins in either direction are left out, as are pairs with less than ``least`` support.
    ``evidence`` holds the first ``pieces`` mentions by line and phrase; ``truncated`` tells that there are more. Supports are added up before the
    shuffle and evidence is cut before it, so no pair's mentions meet in one row or task.
    """
    both = explicit.select("source", "target").union(explicit.select("target", "source")).distinct()
    open_ = mentions.select("source", "target", "line", "phrase").join(both, ["source", "target"], "left_anti")
    support = open_.groupBy("source", "target").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    place = F.row_number().over(W.partitionBy("source", "target").orderBy("line", "phrase"))
    first = open_.withColumn("place", place).filter(F.col("place") <= pieces).groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("place", "line", "phrase"))).alias("e"))
    first = first.select("source", "target", F.transform("e", lambda x: F.struct(x["line"].alias("line"), x["phrase"].alias("phrase"))).alias("evidence"))
    return support.join(first, ["source", "target"]).select("source", "target", "support", (F.col("support") > pieces).alias("truncated"), "evidence")


def judgments(texts: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, item_id of the texts (id, content) that hold an item's text (item_id, text) as it is, anywhere."""
    found = occurrences(texts, items.select(F.col("text").alias("phrase")), fold=False, whole=False, block=block)
    return found.join(items.select("item_id", F.col("text").alias("phrase")), "phrase").select("id", "item_id")
