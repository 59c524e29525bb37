"""Metadata filters, orders and limits over notes.

Metadata is a string map from a lower-cased path to a leaf struct, or plain columns; a *missing*
value is a path that isn't there and differs from an explicit null.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_tag, norm_text

#: Limits of one request.
MOST_FILTERS, MOST_ONE_OF, MOST_VALUES, MOST_TAGS, MOST_SEGMENTS = 64, 64, 256, 64, 32


def check_budgets(filters=(), tags=(), limit: int | None = None) -> None:
    """Raise before a plan is built if a request exceeds its limits."""
    values = sum(len(f[2]) if f[1] == "one_of" else 1 for f in filters)
    if len(filters) > MOST_FILTERS or values > MOST_VALUES or any(f[1] == "one_of" and not 1 <= len(f[2]) <= MOST_ONE_OF for f in filters):
        raise ValueError("too many filters or values")
    if len(tags) > MOST_TAGS:
        raise ValueError("too many tags")
    if any(len(f[0].split(".")) > MOST_SEGMENTS for f in filters):
        raise ValueError("a path has too many segments")
    if limit is not None and limit < 0:
        raise ValueError("the limit is negative")


def at_path(metadata: Column, path: str) -> Column:
    """The VARIANT at a dotted path; SQL null where it is missing, a VARIANT null where it is null.

    A step into an object takes the key that is exactly the step, else the only key that is alike when folded: with several, or none, nothing is found. A step into
    an array is a position from 0, written without leading zeros. Steps are trimmed; an empty one finds nothing. Keys are folded by case, and
    compared with the composed and the decomposed form of the step. Any character may stand in a key.
    """
    steps = [s.strip() for s in path.split(".")]
    if not all(steps):
        return F.lit(None).cast("variant")
    out = metadata
    for step in steps:
        out = _step(out, step)
    return out


def _step(value: Column, step: str) -> Column:
    """One step of :func:`at_path`. The value is bound once, so that long paths stay short expressions."""
    wanted = [F.lit(f) for f in forms(step)]

    def into(v: Column) -> Column:
        held = F.try_variant_get(v, "$", "map<string,variant>")
        key = F.transform(F.array(F.map_keys(held)), lambda ks: F.when(F.array_contains(ks, step), F.lit(step)).otherwise(_only(F.filter(ks, lambda k: F.lower(k).isin(*wanted)))))
        found = F.transform(F.array(held), lambda m: F.try_element_at(m, key[0]))[0]
        if step == "0" or step.isascii() and step.isdigit() and step[0] != "0":
            return F.coalesce(F.get(F.try_variant_get(v, "$", "array<variant>"), F.lit(int(step))) if int(step) < 1 << 31 else F.lit(None).cast("variant"), found)
        return found

    return F.transform(F.array(value), into)[0]


def _only(keys: Column) -> Column:
    return F.when(F.size(keys) == 1, keys[0])


def forms(text: str) -> list[str]:
    """A text in lower case, composed and decomposed."""
    return sorted({unicodedata.normalize(f, unicodedata.normalize(f, text).lower()) for f in ("NFC", "NFD")})


def equals(value: Column, wanted) -> Column:
    """A scalar alike (texts folded, no coercion between kinds), or an array with an element alike, at any depth of arrays up to four."""

    def alike(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        if wanted is None:
            return F.is_variant_null(v)
        if isinstance(wanted, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == wanted)
        if isinstance(wanted, (int, float)):
            return kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (F.try_variant_get(v, "$", "double") == float(wanted))
        return (kind == "STRING") & F.lower(F.try_variant_get(v, "$", "string")).isin(*forms(str(wanted)))

    def inside(v: Column, levels: int) -> Column:
        here = F.coalesce(alike(v), F.lit(False))
        return here if not levels else here | F.coalesce(F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: inside(x, levels - 1)), F.lit(False))

    return inside(value, 4)


def filter_notes(notes: DataFrame, filters=(), tags=()) -> DataFrame:
    """Notes that pass all filters, (path, "equals" | "exists" | "one_of", value), and bear all tags.

    ``notes`` has a VARIANT ``metadata`` and normalised ``tags``.
    """
    check_budgets(filters, tags)
    out = notes
    for path, kind, value in filters:
        found = at_path(F.col("metadata"), path)
        if kind == "exists":
            out = out.filter(found.isNotNull() == bool(value))
        elif kind == "equals":
            out = out.filter(equals(found, value))
        else:
            any_of = F.lit(False)
            for v in value:
                any_of = any_of | equals(found, v)
            out = out.filter(any_of)
    return filter_tags(out, tags)


def filter_tags(notes: DataFrame, tags) -> DataFrame:
    """Notes with all tags; a tag that folds to nothing matches none."""
    for t in tags:
        wanted = norm_tag(F.lit(t))
        notes = notes.filter((wanted != "") & F.array_contains("tags", wanted))
    return notes


def filter_scopes(notes: DataFrame, selected) -> DataFrame:
    """Notes with any selected scope, exact and case-sensitive; none selected keeps all."""
    if not selected:
        return notes
    return notes.filter(F.col("scopes_valid") & F.arrays_overlap("scopes", F.array(*map(F.lit, selected))))


def sort_values(value: Column, path: str = "path", index: str = "note_idx") -> list[Column]:
    """What notes are ordered by: whether the value is missing, its kind, number, folded text, the folded path, input order."""
    kind = F.schema_of_variant(value)
    rank = F.when(value.isNull(), None).when(F.is_variant_null(value), 0).when(kind == "BOOLEAN", 1).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), 2).when(kind == "STRING", 3).when(kind.startswith("ARRAY"), 4).otherwise(5)
    number = F.when(rank == 1, F.try_variant_get(value, "$", "boolean").cast("double")).when(rank == 2, F.try_variant_get(value, "$", "double"))
    text = F.when(rank >= 3, norm_text(F.when(rank == 3, F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))))
    return [value.isNull(), rank, number, text, norm_text(F.col(path)), F.col(index)]


def sort_keys(value: Column, path: str = "path", index: str = "note_idx", descending: bool = False) -> list[Column]:
    """Order of notes by a VARIANT value: missing last either way, then kind, value, folded path, input order."""
    missing, rank, number, text, folded, place = sort_values(value, path, index)
    order = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return [missing.asc(), order(rank), order(number), order(text), folded.asc(), place.asc()]


def sort_column(value: Column, path: str = "path", index: str = "note_idx", descending: bool = False) -> list[Column]:
    """The same for a plain column, where SQL null is missing."""
    return [value.isNull().asc(), value.desc() if descending else value.asc(), F.col(path).asc(), F.col(index).asc()]


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with its ``total``, how many are ``returned``, and whether rows were left out."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    out = ranked.filter(F.col("rank") <= k).join(totals, group)
    return out.withColumns({"returned": F.least("total", F.lit(k)).cast("bigint"), "truncated": F.col("total") > k})


def bounded_details(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows with the count of all."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).limit(k).join(F.broadcast(total)).withColumns({"returned": F.least("total", F.lit(k)).cast("bigint"), "truncated": F.col("total") > k})


def percentile(df: DataFrame, value: str, *shares: float) -> DataFrame:
    """Nearest-rank percentiles."""
    return df.agg(*(F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * s)}") for s in shares))


def cumulative_budget(df: DataFrame, size: str, order: str, budget: int, partition: str | None = None) -> DataFrame:
    """Rows of each partition while the running size stays within the budget."""
    w = (W.partitionBy(partition) if partition else W.partitionBy()).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)



def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank``, the place in the order of ``keys`` from 1 on, by a range sort.

    Rows are dealt out by range and numbered within each partition; partitions' sizes give
    where each one starts. Only those sizes meet in one task.
    """
    dealt = checkpointed(rows.repartitionByRange(*keys).withColumn("vellum_part", F.spark_partition_id()))
    sizes = dealt.groupBy("vellum_part").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.select("vellum_part", (F.sum("n").over(W.orderBy("vellum_part")) - F.col("n")).alias("vellum_start"))
    place = F.row_number().over(W.partitionBy("vellum_part").orderBy(*keys))
    return dealt.withColumn("rank", place).join(F.broadcast(start), "vellum_part").withColumn("rank", (F.col("rank") + F.col("vellum_start")).cast("bigint")).drop("vellum_part", "vellum_start")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; one of its own only where the session has none, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints")
    return df.checkpoint()
