"""Links and relations: resolution, dedupe, counts, orphans, neighbours, support.

Links are keyed by path and have no self-links; relations are keyed by id and keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .query import checkpointed

CATALOG = "index.md"


def resolve_links(notes: DataFrame, raw: DataFrame) -> DataFrame:
    """source, target_raw, line, pos, kind, target, candidates of each raw link (source, target, line, pos).

    Anchors are cut; nothing left is a link to the note itself. Other file extensions are
    attachments. A leading dot resolves against the source's folder, by path only. Else the exact id,
    then, without a slash, the basename: one note of that name resolves, more are ambiguous, none broken.
    Two equi-joins; the basenames are grouped first.
    """
    bare = F.regexp_replace(F.col("target"), "[#^].*$", "")
    name = F.regexp_replace(F.try_url_decode(F.regexp_replace(F.coalesce(bare, F.lit("")), r"\+", "%2B")), r"\.md$", "")
    folder = F.regexp_replace(F.col("source"), "[^/]*$", "")
    steps = F.split(F.concat(folder, F.col("name")), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.when(F.size(a) == 0, F.array(F.lit(".."))).otherwise(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(F.concat(a, F.array(s))))
    links = raw.withColumn("name", F.trim(name)).withColumn("wanted", F.when(F.col("name").startswith("."), F.array_join(walked, "/")).otherwise(F.col("name")))
    ids = notes.select(F.col("id").alias("found_id"), F.col("path").alias("found_path"))
    names = notes.groupBy(F.lower(F.substring_index("id", "/", -1)).alias("base")).agg(F.sort_array(F.collect_set("path")).alias("paths"))
    links = links.join(ids, links["wanted"] == ids["found_id"], "left")
    links = links.withColumn("lookup", F.when(F.col("found_id").isNull() & ~F.contains("wanted", F.lit("/")) & ~F.col("name").startswith("."), F.lower("wanted")))
    links = links.join(names, links["lookup"] == names["base"], "left")
    extension = F.regexp_extract(F.col("name"), r"\.([A-Za-z0-9]{1,8})$", 1)
    kind = (
        F.when(F.col("name") == "", "self")
        .when(F.col("found_id").isNotNull(), "resolved")
        .when(F.size("paths") == 1, "resolved")
        .when(F.size("paths") > 1, "ambiguous")
        .when((extension != "") & ~F.col("name").startswith(".."), "attachment")
        .otherwise("broken")
    )
    target = F.when(kind == "self", F.col("source")).when(kind == "resolved", F.coalesce("found_path", F.try_element_at("paths", F.lit(1))))
    return links.select("source", F.col("target").alias("target_raw"), "line", "pos", kind.alias("kind"), target.alias("target"), F.when(kind == "ambiguous", F.col("paths")).alias("candidates"))


def contextual_links(links: DataFrame, catalog: str = CATALOG) -> DataFrame:
    """source, target, line: no self-links, none of the catalog, each pair once with its first line.

    The minimum of a struct is combined before the shuffle, so no window is needed.
    """
    kept = links.filter((F.col("source") != F.col("target")) & (F.col("source") != catalog) & (F.col("target") != catalog))
    return kept.groupBy("source", "target").agg(F.min("line").alias("line"))


def resolve_relations(notes: DataFrame, declared: DataFrame) -> DataFrame:
    """source, predicate, target, kind: ``resolved``, ``malformed`` (a bare name that only a basename fits) or ``broken``."""
    ids = notes.select(F.col("id").alias("found"))
    names = notes.select(F.substring_index("id", "/", -1).alias("base")).distinct()
    out = declared.distinct().join(ids, F.col("target") == F.col("found"), "left")
    out = out.withColumn("lookup", F.when(F.col("found").isNull() & ~F.contains("target", F.lit("/")), F.col("target")))
    out = out.join(names, F.col("lookup") == F.col("base"), "left")
    return out.select("source", "predicate", "target", F.when(F.col("found").isNotNull(), "resolved").when(F.col("base").isNotNull(), "malformed").otherwise("broken").alias("kind"))


def lookup_note(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, outcome, id: exact id, else the only id alike but for case, else the only basename, title or alias.

    Three ranked equi-joins, the first rank that finds anything decides.
    """
    folded = F.lower("query")
    by = [
        notes.select(F.col("id").alias("key"), "id").join(queries, F.col("key") == F.col("query")).select("query", F.lit(1).alias("rank"), "id"),
        notes.select(F.lower("id").alias("key"), "id").join(queries, F.col("key") == folded).select("query", F.lit(2).alias("rank"), "id"),
        notes.select("id", F.explode(F.array_distinct(F.concat(F.array(F.lower(F.substring_index("id", "/", -1)), F.lower("title")), F.transform("aliases", F.lower)))).alias("key")).join(queries, F.col("key") == folded).select("query", F.lit(3).alias("rank"), "id"),
    ]
    found = by[0].unionByName(by[1]).unionByName(by[2]).groupBy("query", "rank").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    best = found.groupBy("query").agg(F.min_by(F.struct("n", "id"), "rank").alias("b"))
    return queries.join(best, "query", "left").select("query", F.when(F.col("b").isNull(), "missing").when(F.col("b.n") == 1, "found").otherwise("ambiguous").alias("outcome"), F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"))


def note_connections(notes: DataFrame, links: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """id, path and how many links and relations come in and go out; zero where there is none."""
    ends = links.select(F.col("source").alias("path"), F.lit(0).alias("inbound"), F.lit(1).alias("outbound")).unionByName(links.select(F.col("target").alias("path"), F.lit(1).alias("inbound"), F.lit(0).alias("outbound")))
    out = notes.join(ends.groupBy("path").agg(F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound")), "path", "left")
    if relations is not None:
        both = relations.select(F.col("source").alias("id"), F.lit(0).alias("rin"), F.lit(1).alias("rout")).unionByName(relations.select(F.col("target").alias("id"), F.lit(1).alias("rin"), F.lit(0).alias("rout")))
        out = out.join(both.groupBy("id").agg(F.sum("rin").alias("inbound_relations"), F.sum("rout").alias("outbound_relations")), "id", "left")
    counts = [c for c in ("inbound", "outbound", "inbound_relations", "outbound_relations") if c in out.columns]
    return out.select("id", "path", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts))


def backlinks(links: DataFrame) -> DataFrame:
    return links.select("target", "source", "line").orderBy("target", "source", "line")


def orphans(notes: DataFrame, links: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Notes that no link and no relation touches: one anti-join on the union of all ends."""
    out = notes.join(links.select(F.col("source").alias("path")).union(links.select("target")), "path", "left_anti")
    if relations is not None:
        out = out.join(relations.select(F.col("source").alias("id")).union(relations.select("target")), "id", "left_anti")
    return out.select("id", "path")


def edges_among(links: DataFrame, results: DataFrame) -> DataFrame:
    """Links with both ends among the results' paths."""
    return links.join(results.select(F.col("path").alias("source")), "source", "left_semi").join(results.select(F.col("path").alias("target")), "target", "left_semi").select("source", "target", "line")


def reciprocal(relations: DataFrame) -> DataFrame:
    """Pairs of notes with the same predicate both ways, once each."""
    back = relations.select(F.col("target").alias("source"), "predicate", F.col("source").alias("target"))
    return relations.join(back, ["source", "predicate", "target"], "left_semi").filter("source < target")


def relation_hygiene(resolved: DataFrame) -> DataFrame:
    """kind, source, predicate, target: relations to self, both ways, malformed and broken."""
    self_ = resolved.filter("kind = 'resolved' AND source = target").select(F.lit("self").alias("kind"), "source", "predicate", "target")
    both = reciprocal(resolved.filter("kind = 'resolved'").select("source", "predicate", "target")).select(F.lit("reciprocal").alias("kind"), "source", "predicate", "target")
    return self_.unionByName(both).unionByName(resolved.filter("kind <> 'resolved'").select("kind", "source", "predicate", "target"))


def catalog_groups(notes: DataFrame) -> DataFrame:
    """group, n, lines: notes by first path segment (``Notes`` at the top), as sorted catalog lines."""
    group = F.when(F.contains("id", F.lit("/")), F.substring_index("id", "/", 1)).otherwise("Notes")
    line = F.concat(F.lit("- [["), F.col("id"), F.lit("]] "), F.coalesce("title", F.lit("")))
    return notes.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def replace_catalog(index: str, catalog: str, start: str, end: str) -> str:
    """The index text with the region between its two marks replaced; marks must be one pair, in order."""
    if index.count(start) != 1 or index.count(end) != 1 or index.index(start) > index.index(end):
        raise ValueError("the catalog marks are missing, repeated or out of order")
    head, _, rest = index.partition(start)
    return f"{head}{start}\n{catalog}\n{end}{rest.partition(end)[2]}"


def tag_support(notes: DataFrame, concepts: DataFrame, least: int = 2) -> DataFrame:
    """tag, support: tags on at least max(2, least) notes that are no concept's label."""
    return notes.select("id", F.explode("tags").alias("tag")).distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= max(2, least)).join(concepts.select("tag"), "tag", "left_anti")


def pair_support(items: DataFrame, least: int, linked: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """a, b, support: unordered pairs of notes that share at least so many items (note, item), linked pairs left out.

    An item on n notes makes n(n-1)/2 pairs; with ``most``, items on more notes raise an error
    rather than being dropped, as the limit of one request.
    """
    items = items.select("note", "item").distinct()
    if most is not None and not items.groupBy("item").count().filter(F.col("count") > most).isEmpty():
        raise ValueError(f"an item is on more than {most} notes")
    left, right = items.select(F.col("note").alias("a"), "item"), items.select(F.col("note").alias("b"), "item")
    out = left.join(right, "item").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    if linked is not None:
        pairs = linked.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
        out = out.join(pairs, ["a", "b"], "left_anti")
    return out


def percolate_rank(candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates (kind, identity, support) by support, kind and identity; ``truncated`` tells that some were left out."""
    rank = F.when(F.col("kind") == "hygiene", 0).when(F.col("kind") == "mention", 1).when(F.col("kind") == "relation", 2).otherwise(3)
    return candidates.orderBy(F.col("support").desc(), rank, "identity").limit(limit)


def suggest_concept_id(wanted: DataFrame, occupied: DataFrame) -> DataFrame:
    """tag, id: ``concepts/<key>``, or the first of ``-concept``, ``-concept-2``, ... that no note has.

    As many endings are tried as ids of that key are taken, and one more, so one is always free.
    """
    base = F.concat(F.lit("concepts/"), "key")
    bases = F.array_distinct(F.array(F.col("id"), F.regexp_replace("id", r"-concept(?:-\d+)?$", "")))
    taken = occupied.select("id").distinct().select(F.explode(bases).alias("base")).groupBy("base").agg(F.count(F.lit(1)).cast("int").alias("taken"))
    asked = wanted.select("tag", base.alias("base")).join(taken, "base", "left")
    tail = F.transform(F.sequence(F.lit(0), F.coalesce("taken", F.lit(0)) + 1), lambda i: F.when(i == 0, "").when(i == 1, "-concept").otherwise(F.concat(F.lit("-concept-"), i.cast("string"))))
    options = asked.select("tag", "base", F.posexplode(tail).alias("rank", "tail")).withColumn("id", F.concat("base", "tail"))
    return options.join(occupied.select("id"), "id", "left_anti").groupBy("tag").agg(F.min_by("id", "rank").alias("id"))


def neighbours(edges: DataFrame, start: Column | str, depth: int, limit: int, direction: str = "both") -> tuple[DataFrame, bool]:
    """Breadth-first search from one note: (node, distance) and whether the limit cut it.

    Each level is one equi-join of the frontier with the edges. A level's new nodes are ordered by
    the node that reached them and then by name, and only as many as the limit leaves are kept, so
    at most ``limit`` rows (1,000) ever come to the driver.
    """
    if not 1 <= depth <= 10 or not 1 <= limit <= 1000 or direction not in ("in", "out", "both"):
        raise ValueError("depth is 1 to 10, limit 1 to 1000, direction in, out or both")
    spark = edges.sparkSession
    ways = []
    if direction != "in":
        ways.append(edges.select(F.col("source").alias("from"), F.col("target").alias("to")))
    if direction != "out":
        ways.append(edges.select(F.col("target").alias("from"), F.col("source").alias("to")))
    steps = ways[0] if len(ways) == 1 else ways[0].union(ways[1])
    distance, frontier, truncated = {start: 0}, [start], False
    for level in range(1, depth + 1):
        if not frontier:
            break
        here = spark.createDataFrame([(n,) for n in frontier], "from string")
        seen = spark.createDataFrame([(n,) for n in distance], "to string")
        reached = steps.join(F.broadcast(here), "from").join(F.broadcast(seen), "to", "left_anti").groupBy("to").agg(F.min("from").alias("by"))
        room = limit - len(distance)
        rows = reached.orderBy("by", "to").limit(room + 1).collect()
        truncated |= len(rows) > room
        frontier = [r.to for r in rows[:room]]
        distance |= dict.fromkeys(frontier, level)
    return spark.createDataFrame(list(distance.items()), "node string, distance int"), truncated


def graph_context(edges: DataFrame, seeds: list[str], per_seed: int = 3) -> DataFrame:
    """id, seeds, seed_rank: notes next to the seeds that are no seeds, at most ``per_seed`` for each, by how many seeds reach them."""
    spark = edges.sparkSession
    primary = spark.createDataFrame(list(enumerate(seeds)), "seed_rank int, seed string")
    both = edges.select(F.col("source").alias("seed"), F.col("target").alias("id")).union(edges.select("target", "source")).distinct()
    near = both.join(F.broadcast(primary), "seed").join(F.broadcast(primary.select(F.col("seed").alias("id"))), "id", "left_anti")
    kept = near.withColumn("n", F.row_number().over(W.partitionBy("seed").orderBy("id"))).filter(F.col("n") <= per_seed)
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("seeds"), F.min("seed_rank").alias("seed_rank")).orderBy(F.col("seeds").desc(), "seed_rank", "id")


def thread_depths(turns: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, turn, depth, root of each turn: parents are followed by doubling the distance a join.

    Turns whose parent is missing are roots; turns on a cycle, or below one, get no root. It goes on until no parent is left
    to follow, or, for cycles, until the distance is that of the largest conversation, which is counted unless a caller knows it (``most``).
    """
    up = turns.select("conv_id", "turn", F.col("parent_turn").alias("up"))
    known = turns.select("conv_id", F.col("turn").alias("up"), F.lit(True).alias("known"))
    state = up.join(known, ["conv_id", "up"], "left").select("conv_id", "turn", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), 1).otherwise(0).alias("depth"), F.when(F.col("known"), None).otherwise(F.col("turn")).alias("root"))
    if most is None:
        most = turns.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < most:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        state = state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.coalesce("root", "root2").alias("root"))
        state = checkpointed(state)
        step *= 2
        if state.filter("up IS NOT NULL").isEmpty():
            break
    return state.select("conv_id", "turn", F.when(F.col("root").isNotNull(), F.col("depth")).cast("bigint").alias("depth"), "root")
