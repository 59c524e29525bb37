"""Discussions of four sites as flat items, and the reading order of any reply forest.

A site's answer is one JSON document. Two shapes are flat (posts that name their parent; a root and items that list their children), two are nested
(listings with placeholders; posts with replies inside). A small reader walks each without recursion and gives one row an item with its parent. Depth and place in reading order
are then computed for all documents by joins, so trees may be as deep and as large as they come.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .query import checkpointed, ranked
from .threads import REMOVED

ITEM = "key string, parent string, place bigint, id string, kind string, reason string, role string, author string, body string"
_NAMES = [f.split(" ")[0] for f in ITEM.split(", ")]


def _name(value) -> str | None:
    """An id: a text that isn't blank, or a whole number."""
    if isinstance(value, str):
        return value.strip() or None
    return str(value) if isinstance(value, int) and not isinstance(value, bool) else None


def _record(value) -> dict:
    return value if isinstance(value, dict) else {}


def _list(value) -> list:
    return value if isinstance(value, list) else []


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def x_items(data) -> Iterator[tuple]:
    """Posts in a list, a wrapper or alone, each with the id of the post it replies to."""
    values = data if isinstance(data, list) else _record(data).get("tweets") if isinstance(_record(data).get("tweets"), list) else [_record(data).get("tweet", data)]
    for place, v in enumerate(values):
        v = _record(v)
        key, body, author = _name(v.get("id")), _text(v.get("text")), _name(_record(v.get("author")).get("username"))
        if key is not None and body is not None and author is not None:
            yield key, _name(v.get("inReplyToStatusId")), place, key, "content", None, "post", author, body


def hacker_news_items(data) -> Iterator[tuple]:
    """A root and its items; each lists its children. A child that isn't there is an unavailable item."""
    root, rest = (data[0] if data else None, data[1:]) if isinstance(data, list) else (_record(data).get("root", _record(data).get("rootItem")), _list(_record(data).get("descendants", _record(data).get("items"))))
    by_id: dict[str, dict] = {}
    for v in [root, *rest]:
        if isinstance(v, dict) and (key := _name(v.get("id"))) is not None:
            by_id.setdefault(key, v)
    top = _name(_record(root).get("id"))
    todo, seen = ([(top, None, 0)] if top is not None else []), {top}
    while todo:
        key, parent, place = todo.pop()
        v, role = by_id.get(key), "comment" if parent is not None else "post"
        if v is None:
            yield key, parent, place, key, "unavailable", "not-found", role, None, None
            continue
        gone = "deleted" if v.get("deleted") is True else "dead" if v.get("dead") is True else None
        yield key, parent, place, key, "unavailable" if gone else "content", gone, role, None if gone else _name(v.get("by")), None if gone else _text(v.get("text")) or ""
        for i, kid in enumerate(_list(v.get("kids"))):
            kid = _name(kid)
            if kid is not None and kid not in seen:
                seen.add(kid)
                todo.append((kid, key, i))


def _children(listing) -> list:
    if isinstance(listing, list):
        return listing
    return _list(_record(_record(listing).get("data")).get("children"))


def reddit_items(data) -> Iterator[tuple]:
    """A post and listings of comments inside comments, with placeholders for comments that were not sent."""
    post, comments = (data[0] if data else None, data[1] if len(data) > 1 else None) if isinstance(data, list) else (_record(data).get("post"), _record(data).get("comments"))
    things = [post] if _record(post).get("kind") == "t3" else _children(post)
    head = next((_record(t.get("data")) for t in things if isinstance(t, dict) and t.get("kind") == "t3"), None)
    if head is None or (_name(head.get("id")) or _name(head.get("name"))) is None:
        return
    key = "0"
    yield key, None, 0, _name(head.get("id")) or _name(head.get("name")), "content", None, "post", _author(head.get("author")), _text(head.get("selftext")) or ""
    todo, n = [(v, key, i) for i, v in enumerate(_children(comments))], 0
    while todo:
        v, parent, place = todo.pop()
        kind, d = _record(v).get("kind"), _record(_record(v).get("data"))
        if kind not in ("t1", "more"):
            continue
        n += 1
        key = str(n)
        if kind == "more":
            yield key, parent, place, _name(d.get("id")) or "more", "more", None, "comment", None, None
            continue
        body, name = _text(d.get("body")) or "", _name(d.get("id")) or _name(d.get("name")) or "unknown-comment"
        gone = {REMOVED[0]: "deleted", REMOVED[1]: "removed"}.get(body.strip())
        yield key, parent, place, name, "unavailable" if gone else "content", gone, "comment", None if gone else _author(d.get("author")), None if gone else body
        todo += [(r, key, i) for i, r in enumerate(_children(d.get("replies")))]


def _author(value) -> str | None:
    name = _name(value)
    return None if name == REMOVED[0] else name


def bluesky_items(data) -> Iterator[tuple]:
    """A post with replies inside, and the posts above it; posts not found or blocked stay as unavailable items."""
    top = _record(data).get("thread", data)
    above, v = [], _record(top).get("parent")
    while isinstance(v, dict):
        above.append(v)
        v = v.get("parent")
    todo = [(top, None, len(above), True)] + [(v, None, len(above) - 1 - i, False) for i, v in enumerate(above)]
    n = -1
    while todo:
        v, parent, place, inside = todo.pop()
        if not isinstance(v, dict):
            continue
        post, kind = _record(v.get("post")), _text(v.get("$type")) or ""
        n += 1
        key, role = str(n), "post" if parent is None else "comment"
        blocked, missing = v.get("blocked") is True or "blockedPost" in kind, v.get("notFound") is True or "notFoundPost" in kind
        if blocked or missing:
            yield key, parent, place, _name(v.get("uri")) or "unknown-post", "unavailable", "blocked" if blocked else "not-found", role, None, None
            continue
        record = post.get("record")
        if not isinstance(record, dict):
            continue
        yield key, parent, place, _name(post.get("uri")) or _name(v.get("uri")) or "unknown-post", "content", None, role, _name(_record(post.get("author")).get("handle")), _text(record.get("text")) or ""
        if inside:
            todo += [(r, key, i, True) for i, r in enumerate(_list(v.get("replies")))]


READERS = {"x": x_items, "hacker-news": hacker_news_items, "reddit": reddit_items, "bluesky": bluesky_items}


def items_of(captures: DataFrame) -> DataFrame:
    """document, platform and the columns of ``ITEM`` for captures (document string, platform, json): one row an item.

    JSON that can't be read, or isn't of the platform's shape, gives no rows; nor does an unknown platform. A document is read whole in one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for document, platform, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    data = json.loads(text or "")
                except (ValueError, RecursionError):
                    continue
                out += [(document, platform, *row) for row in READERS[platform](data)] if platform in READERS else []
            columns = list(zip(*out, strict=True)) if out else [[]] * (2 + len(_NAMES))
            types = [pa.int64() if n == "place" else pa.string() for n in ("document", "platform", *_NAMES)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["document", "platform", *_NAMES])

    return captures.select("document", "platform", "json").mapInArrow(run, f"document string, platform string, {ITEM}")


def reading_order(items: DataFrame) -> DataFrame:
    """``items`` (document, key, parent, place, ...) with ``depth``, ``position`` (from 0, in the document) and ``cut``.

    Siblings, and roots, go by ``place``. Items whose parent is missing are roots. A key that repeats in its document counts once, at its least place. Of each cycle of
    parents the item with the least key becomes a root and has ``cut`` true, so that every item is placed once. Other columns, of types that can be ordered, are carried along.

    The walk through the forest is a linked list: into an item, through its children, out again, on to its next sibling. List ranking adds up what lies ahead of
    each step by doubling the distance a join, so a tree takes the logarithm of its size in joins, whatever its depth, and no tree, level or
    group of siblings ever meets in one task.
    """
    extra = [c for c in items.columns if c not in ("document", "key", "parent", "place")]
    first = items.groupBy("document", "key").agg(F.min(F.struct("place", "parent", F.struct(F.lit(0).alias("n"), *(F.col(f"`{c}`") for c in extra)).alias("rest"))).alias("v"))
    rows = first.select("document", "key", "v.*")
    keys = rows.select("document", F.col("key").alias("parent"), F.lit(True).alias("held"))
    rows = checkpointed(rows.join(keys, ["document", "parent"], "left").withColumn("parent", F.when(F.col("held"), F.col("parent"))).drop("held").withColumn("cut", F.lit(False)))
    largest = rows.groupBy("document").count().agg(F.max("count")).first()[0] or 0
    ends, loops = _walked(rows, largest)
    if loops is not None:
        rows = checkpointed(_without_cycles(rows, loops, largest))
        ends, loops = _walked(rows, largest)
    total = ends.groupBy("document").agg(F.max("ahead").alias("total"))
    named = [F.col(c) if c not in extra else F.col(f"rest.`{c}`") for c in items.columns]
    return ends.join(total, "document").select(*named, F.col("depth").cast("int").alias("depth"), (F.col("total") - F.col("ahead")).alias("position"), "cut")


def _walked(rows: DataFrame, largest: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``ahead`` (items from here to the document's end) and ``depth``; and the documents whose walk has no end, or None."""
    placed = checkpointed(ranked(rows, ["document", "parent", "place", "key"]))
    up = placed.select("document", F.col("key").alias("parent"), F.col("rank").alias("parent_rank"))
    child = placed.filter("parent IS NOT NULL").groupBy("document", F.col("parent").alias("key")).agg(F.min("rank").alias("child"))
    after = placed.select((F.col("rank") - 1).alias("rank"), F.col("document").alias("d2"), F.col("parent").alias("p2"))
    all_ = placed.select("document", "key", "parent", "rank").join(up, ["document", "parent"], "left").join(child, ["document", "key"], "left").join(after, "rank", "left")
    sibling = (F.col("document").eqNullSafe(F.col("d2"))) & (F.col("parent").eqNullSafe(F.col("p2")))
    into = F.struct((2 * F.col("rank")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("rank") + 1).alias("next"), F.lit(1).cast("bigint").alias("ahead"), F.lit(1).cast("bigint").alias("open"))
    out = F.struct((2 * F.col("rank") + 1).alias("e"), F.when(sibling, 2 * (F.col("rank") + 1)).when(F.col("parent_rank").isNotNull(), 2 * F.col("parent_rank") + 1).alias("next"), F.lit(0).cast("bigint").alias("ahead"), F.lit(-1).cast("bigint").alias("open"))
    steps = checkpointed(all_.select(F.explode(F.array(into, out)).alias("s")).select("s.*"))
    reach = 1
    while reach < 2 * largest:
        there = steps.select(F.col("e").alias("next"), F.col("next").alias("next2"), F.col("ahead").alias("ahead2"), F.col("open").alias("open2"))
        joined = steps.join(there, "next", "left").select("e", F.col("next2").alias("next"), (F.col("ahead") + F.coalesce("ahead2", F.lit(0))).alias("ahead"), (F.col("open") + F.coalesce("open2", F.lit(0))).alias("open"))
        steps, reach = checkpointed(joined), 2 * reach
        if steps.filter("next IS NOT NULL").isEmpty():
            break
    ends = placed.join(steps.filter("e % 2 = 0").select((F.col("e") / 2).cast("bigint").alias("rank"), "next", "ahead", (-F.col("open")).alias("depth")), "rank")
    loops = ends.filter("next IS NOT NULL").select("document").distinct()
    return ends.drop("rank", "next"), None if loops.isEmpty() else loops


def _without_cycles(rows: DataFrame, documents: DataFrame, largest: int) -> DataFrame:
    """``rows`` where the item with the least key of each cycle has no parent, and is ``cut``."""
    some = rows.join(documents, "document", "left_semi")
    up = checkpointed(some.select("document", "key", F.col("parent").alias("at"), F.least("key", "parent").alias("least")))
    reach = 1
    while reach < largest:
        there = up.select("document", F.col("key").alias("at"), F.col("at").alias("at2"), F.col("least").alias("least2"))
        up = checkpointed(up.join(there, ["document", "at"], "left").select("document", "key", F.col("at2").alias("at"), F.least("least", "least2").alias("least")))
        reach *= 2
    # After more steps than there are items, whoever is still somewhere is on a cycle, and has passed all of it.
    on = up.filter("at IS NOT NULL").select("document", F.col("at").alias("key")).distinct()
    heads = up.join(on, ["document", "key"], "left_semi").filter(F.col("least") == F.col("key")).select("document", "key", F.lit(True).alias("head"))
    out = rows.join(heads, ["document", "key"], "left")
    return out.withColumn("parent", F.when(F.col("head"), None).otherwise(F.col("parent"))).withColumn("cut", F.coalesce("head", F.lit(False))).drop("head")


def parse_platform_threads(captures: DataFrame) -> DataFrame:
    """document, platform, key, parent, id, kind, reason, role, author, body, depth and position of every item of captures (document, platform, json)."""
    items = checkpointed(items_of(captures)).withColumn("document", F.concat_ws("\u0000", "document", "platform"))
    out = reading_order(items).withColumn("document", F.substring_index("document", "\u0000", 1))
    return out.select("document", "platform", "key", "parent", "id", "kind", "reason", "role", "author", "body", "depth", "position")
