"""Repository scopes: prefix joins, deepest matches, classes of records, grouped context and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import calendar_date, canonical_path_error

#: States of plans.
ACTIVE = ("proposed", "accepted", "in-progress", "blocked")
TERMINAL = ("completed", "superseded", "cancelled")
#: Targets and notes that one step of a task pairs: so many of each, as hashes deal them; copies of one value stay together.
CELL = 4096


def scope_error(scopes: Column) -> Column:
    """Null for a valid list of 1 to 16 canonical scopes, else what is wrong with it. Folds in ASCII and simple case only."""
    folded = F.transform(scopes, F.lower)
    return (
        F.when(scopes.isNull(), "missing")
        .when(F.size(scopes) == 0, "empty")
        .when(F.size(scopes) > 16, "too many")
        .when(F.exists(scopes, lambda s: canonical_path_error(s).isNotNull()), "not canonical")
        .when(F.exists(scopes, lambda s: F.octet_length(s) > 1024), "too long")
        .when(F.aggregate(scopes, F.lit(0), lambda a, s: a + F.octet_length(s)) > 8192, "too long")
        .when(F.size(F.array_distinct(scopes)) < F.size(scopes), "repeated")
        .when(F.size(F.array_distinct(folded)) < F.size(scopes), "collision")
    )


def ancestors(path: Column) -> Column:
    """``.`` and every prefix of a path by whole segments, the path itself included."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def depth(scope: Column) -> Column:
    return F.when(scope == ".", 0).otherwise(F.size(F.split(scope, "/")))


def _paired(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """target, id, scope, depth, kind: each target (target, at) with each note (at, scope, id) of the same ``at``.

    There are as many rows as pairs, so pairs are made last and never shuffled: a scope's notes are arrays of a block, its targets are
    dealt to cells, and each cell of targets meets each block. What shuffles is a few thousandths of the pairs; no task holds a scope.
    """
    share = lambda n: F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(n)
    sizes = notes.groupBy("at", "scope").agg(share("blocks")).join(targets.groupBy("at").agg(share("cells")), "at")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["at", "scope", "cell", "block"]
    dealt = targets.join(sizes, "at").select("target", "at", "scope", F.pmod(F.xxhash64("target"), F.col("cells")).cast("int").alias("cell"), numbers("blocks").alias("block"))
    held = notes.join(sizes, ["at", "scope"]).select("at", "scope", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), numbers("cells").alias("cell"))
    held = held.groupBy(*key).agg(F.collect_list(F.struct("id")).alias("notes"))
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(parts, *key).join(held, key)
    met = met.select("target", "scope", depth(F.col("scope")).cast("bigint").alias("depth"), F.when(F.col("scope") == F.col("target"), "exact").otherwise("ancestor").alias("kind"), F.explode("notes").alias("note"))
    return met.select("target", "note.id", "scope", "depth", "kind")


def scope_matches(targets: DataFrame, scopes: DataFrame) -> DataFrame:
    """target, id, scope, depth, kind: scopes that hold each target, as an equi-join on the target's ancestors."""
    up = targets.select("target", F.explode(F.array_distinct(ancestors(F.col("target")))).alias("at"))
    return _paired(up, scopes.select(F.col("scope").alias("at"), "scope", "id"))


def deepest_match(matches: DataFrame) -> DataFrame:
    """Per target and note the deepest scope, ties by name. Shuffles every match: :func:`deepest_scopes` does not."""
    best = F.max_by(F.struct("scope", "kind", "depth"), F.struct("depth", "scope"))
    return matches.groupBy("target", "id").agg(best.alias("m")).select("target", "id", "m.scope", "m.depth", "m.kind")


def _nearest(targets: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, at): each target once with the deepest scope declared above it; (at, scope, id): the notes that hold there, each with its deepest scope.

    All targets of one nearest scope have the same notes, so these are found once a scope.
    """
    deepest = lambda c: F.max_by(c, F.struct(depth(F.col(c)), c))
    up = targets.select("target").distinct().select("target", F.explode(F.array_distinct(ancestors(F.col("target")))).alias("at"))
    nearest = up.join(scopes.select(F.col("scope").alias("at")).distinct(), "at").groupBy("target").agg(deepest("at").alias("at"))
    above = nearest.select("at").distinct().select("at", F.explode(F.array_distinct(ancestors(F.col("at")))).alias("scope"))
    return nearest, above.join(scopes, "scope").groupBy("at", "id").agg(deepest("scope").alias("scope")).select("at", "scope", "id")


def deepest_scopes(targets: DataFrame, scopes: DataFrame) -> DataFrame:
    """target, id, scope, depth, kind: per target and note the deepest scope that holds the target, as :func:`deepest_match` finds it."""
    return _paired(*_nearest(targets, scopes))


def classify(kind: Column, status: Column, path: Column, as_of: Column, generated: Column) -> Column:
    """Group of a record by type, status, place and dates; ``invalid: ...`` or ``ignored``."""
    plan = F.when(status.isin(*ACTIVE), "activePlans").when(status.isin(*TERMINAL), "historicalPlans").otherwise("invalid: status")
    research = F.when(~path.rlike(r"^projects/[^/]+/market/.+\.md$"), "invalid: place").when((status == "snapshot") & calendar_date(as_of).isNotNull(), "datedResearch").otherwise("invalid: snapshot")
    report = F.when(calendar_date(generated).isNotNull(), "reports").otherwise("invalid: date")
    return F.when(kind.isin("note", "concept"), "maintainedKnowledge").when(kind == "plan", plan).when(kind == "market-research", research).when(kind == "report", report).when(kind.isNull(), "invalid: type").otherwise("ignored")


def memory_context(targets: DataFrame, scopes: DataFrame, notes: DataFrame, k: int = 3) -> DataFrame:
    """For each target and group of notes (id, group, title, path) the first ``k`` by depth, title and path, with totals.

    Ranks and totals are the same for all targets of one nearest scope and are found once a scope; targets then meet at most ``k`` notes a group.
    Ranks need a group together, but each task first keeps the ``k`` best of what it holds: Spark's
    window group limit does so before the shuffle.
    """
    nearest, held = _nearest(targets, scopes)
    joined = held.select("at", "id", depth(F.col("scope")).alias("depth")).join(notes, "id")
    w = W.partitionBy("at", "group").orderBy(F.col("depth").desc(), "title", "path")
    ranked = joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    totals = joined.groupBy("at", "group").agg(F.count(F.lit(1)).alias("total"))
    best = ranked.join(totals, ["at", "group"]).select("at", "group", "id", F.col("rank").cast("bigint").alias("rank"), "total", (F.col("total") > k).alias("truncated"))
    return nearest.join(best, "at").select("target", "group", "id", "rank", "total", "truncated")


def scope_collisions(scopes: DataFrame) -> DataFrame:
    """id, scope of all that declare a scope which has more than one spelling."""
    odd = scopes.groupBy(F.lower("scope").alias("fold")).agg(F.count_distinct("scope").alias("spellings")).filter("spellings > 1")
    return scopes.withColumn("fold", F.lower("scope")).join(odd, "fold", "left_semi").select("id", "scope").distinct()


def audit_counts(scopes: DataFrame, notes: DataFrame) -> DataFrame:
    """One row of counters over notes (id, scopes) and their declarations."""
    counted = notes.select(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("scopes").isNotNull()).alias("declared"), F.count_if(F.col("scopes").isNotNull() & scope_error(F.col("scopes")).isNotNull()).alias("invalid"), F.coalesce(F.sum(F.when(F.col("scopes").isNotNull(), F.size("scopes"))), F.lit(0)).cast("bigint").alias("declarations"), F.coalesce(F.max(F.when(F.col("scopes").isNotNull(), F.size("scopes"))), F.lit(0)).cast("bigint").alias("most"))
    distinct = scopes.agg(F.count_distinct("scope").alias("distinct_scopes"))
    return counted.join(F.broadcast(distinct))


def scope_state(scopes: DataFrame, files: DataFrame) -> DataFrame:
    """scope, state: ``present`` if a file (path) is at or below it, ``invalid`` if it isn't canonical, else ``absent``."""
    there = files.select(F.explode(F.array_distinct(ancestors(F.col("path")))).alias("scope")).distinct().withColumn("there", F.lit(True))
    return scopes.select("scope").distinct().join(there, "scope", "left").select("scope", F.when(canonical_path_error(F.col("scope")).isNotNull(), "invalid").when(F.col("there"), "present").otherwise("absent").alias("state"))


def source_inbox(sources: DataFrame, links: DataFrame, maintained: DataFrame) -> DataFrame:
    """Sources (path, clipped) that no maintained note (path) links to, newest first and undated last."""
    used = links.join(maintained.select(F.col("path").alias("source")), "source", "left_semi").select(F.col("target").alias("path"))
    out = sources.join(maintained.select("path"), "path", "left_anti").join(used, "path", "left_anti")
    day = calendar_date(F.col("clipped"))
    return out.select("path", day.alias("clipped")).orderBy(F.col("clipped").desc_nulls_last(), "path")


def guide_inheritance(guides: DataFrame) -> DataFrame:
    """scope, guides, words: how many guides hold for each guide's scope (its own and those above), and their words."""
    up = guides.select(F.col("scope").alias("of"), F.explode(F.array_distinct(ancestors(F.col("scope")))).alias("scope"))
    return up.join(guides, "scope").groupBy(F.col("of").alias("scope")).agg(F.count(F.lit(1)).alias("guides"), F.sum("words").alias("words"))


def duplicate_bullets(bullets: DataFrame) -> DataFrame:
    """bullet, guides: bullets that stand more than once, by their exact text."""
    return bullets.groupBy("bullet").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("scope").alias("guides")).filter("n > 1")


def audit_guides(guides: DataFrame, bullets: DataFrame, most_words: int = 800, most_bullets: int = 40) -> DataFrame:
    """scope, words, bullets and advice for each guide over its budgets."""
    n = bullets.groupBy("scope").agg(F.count(F.lit(1)).alias("bullets"))
    out = guides.join(n, "scope", "left").select("scope", "words", F.coalesce("bullets", F.lit(0)).alias("bullets"))
    return out.withColumn("advice", F.when((F.col("words") > 2 * most_words) | (F.col("bullets") > 2 * most_bullets), "high").when((F.col("words") > most_words) | (F.col("bullets") > most_bullets), "low").otherwise("none"))


def snapshot_diff(base: DataFrame, now: DataFrame) -> DataFrame:
    """scope, before, after where a guide's words grew."""
    return base.select("scope", F.col("words").alias("before")).join(now.select("scope", F.col("words").alias("after")), "scope", "full_outer").select("scope", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).filter("after > before")


def marker_reciprocity(markers: DataFrame, hubs: DataFrame) -> DataFrame:
    """scope, issue: guide markers (scope, hub) without their hub note (hub, scope), hubs without a marker, and pairs that disagree."""
    both = markers.select(F.col("scope").alias("marked"), "hub").join(hubs.select("hub", F.col("scope").alias("declared")), "hub", "full_outer")
    issue = F.when(F.col("declared").isNull(), "hub missing").when(F.col("marked").isNull(), "marker missing").when(F.col("marked") != F.col("declared"), "scope differs")
    return both.select(F.coalesce("marked", "declared").alias("scope"), issue.alias("issue")).filter("issue IS NOT NULL")


def inspect_context(targets: DataFrame, guides: DataFrame, hubs: DataFrame) -> DataFrame:
    """target, role, scope, rank: guides that hold for a target from the root down, hubs from the deepest up."""
    up = targets.select("target", F.explode(F.array_distinct(ancestors(F.col("target")))).alias("scope"))
    far = depth(F.col("scope"))
    w = W.partitionBy("target")
    g = up.join(guides.select("scope").distinct(), "scope").select("target", F.lit("guide").alias("role"), "scope", F.row_number().over(w.orderBy(far, "scope")).cast("bigint").alias("rank"))
    h = up.join(hubs.select("scope").distinct(), "scope").select("target", F.lit("hub").alias("role"), "scope", F.row_number().over(w.orderBy(far.desc(), "scope")).cast("bigint").alias("rank"))
    return g.unionByName(h)


def analyze_contexts(markers: DataFrame, hubs: DataFrame) -> DataFrame:
    """scope, issue: what breaks the pairing of guides and hubs, and scopes that differ only by case or aren't canonical."""
    scopes = markers.select("scope").union(hubs.select("scope")).distinct()
    folded = scope_collisions(scopes.select(F.col("scope").alias("id"), "scope")).select("scope", F.lit("collision").alias("issue"))
    wrong = scopes.select("scope", canonical_path_error(F.col("scope")).alias("issue")).filter("issue IS NOT NULL")
    return marker_reciprocity(markers, hubs).unionByName(folded).unionByName(wrong)
