import json
import random

import pytest

from vellum.operators import platform_threads as P


def walk(items):
    """(key, depth, position) of (key, parent, place) by a plain walk."""
    keys = {k for k, _, _ in items}
    below = {}
    for k, p, place in items:
        below.setdefault(p if p in keys else None, []).append((place, k))
    out, todo = [], [(k, 0) for _, k in sorted(below.get(None, []), reverse=True)]
    while todo:
        k, depth = todo.pop()
        out.append((k, depth, len(out)))
        todo += [(c, depth + 1) for _, c in sorted(below.get(k, []), reverse=True)]
    return out


def forest(n, r):
    return [(f"k{i}", r.choice([None, "missing", *(f"k{r.randrange(max(1, i))}" for _ in range(6))]) if i else None, r.randrange(50) * 1000 + i) for i in range(n)]


def test_reading_order_of_forests_of_any_depth(spark):
    r = random.Random(3)
    docs = {"wide": [("r", None, 0), *((f"c{i:03}", "r", 300 - i) for i in range(300))], "deep": [(f"n{i:04}", f"n{i - 1:04}" if i else None, 0) for i in range(1500)], "one": [("a", None, 5)], **{f"f{j}": forest(80, r) for j in range(4)}}
    rows = [(d, *x, "clash") for d, items in docs.items() for x in items]
    got = {}
    for x in P.reading_order(spark.createDataFrame(rows, "document string, key string, parent string, place bigint, rank string")).collect():
        got.setdefault(x.document, []).append((x.key, x.depth, x.position))
        assert not x.cut
    for d, items in docs.items():
        assert sorted(got[d], key=lambda x: x[2]) == walk(items), d


def test_cycles_and_repeated_keys(spark):
    rows = [("d", "a", "b", 1), ("d", "b", "c", 2), ("d", "c", "a", 3), ("d", "t", "b", 0), ("d", "s", "s", 9), ("d", "r", None, 4), ("d", "r", "a", 7), ("e", "x", None, 0)]
    out = P.reading_order(spark.createDataFrame(rows, "document string, key string, parent string, place bigint")).orderBy("document", "position").collect()
    assert [(r.key, r.depth, r.cut) for r in out if r.document == "d"] == [("a", 0, True), ("c", 1, False), ("b", 2, False), ("t", 3, False), ("r", 0, False), ("s", 0, True)]
    assert [(r.key, r.position) for r in out if r.document == "e"] == [("x", 0)]
    none = spark.createDataFrame([], "document string, key string, parent string, place bigint")
    assert P.reading_order(none).count() == 0


X = {"tweets": [{"id": 2, "text": "reply", "author": {"username": "u"}, "inReplyToStatusId": "1"}, {"id": "1", "text": "root", "author": {"username": "v"}}, {"id": "3", "text": "second", "author": {"username": "w"}, "inReplyToStatusId": 1}, {"id": 4, "author": {}}, "odd"]}
HN = {"root": {"id": 1, "by": "a", "text": "top", "kids": [3, 2, 9, True]}, "descendants": [{"id": 2, "deleted": True, "kids": [4]}, {"id": 3, "by": "b", "text": "first"}, {"id": 4, "dead": True, "text": "x"}, {"id": 7, "text": "nobody's"}, None]}
REDDIT = [{"data": {"children": [{"kind": "t3", "data": {"id": "p", "title": "T", "selftext": "post", "author": "op"}}]}}, {"data": {"children": [{"kind": "t1", "data": {"id": "c1", "author": "[deleted]", "body": " [deleted] ", "replies": {"data": {"children": [{"kind": "t1", "data": {"id": "c2", "author": "z", "body": "deep", "replies": ""}}]}}}}, {"kind": "t9", "data": {}}, {"kind": "more", "data": {"count": 3}}]}}]
BSKY = {"thread": {"post": {"uri": "u1", "record": {"text": "hello"}, "author": {"handle": "h"}}, "replies": [{"$type": "app#notFoundPost", "uri": "u2"}, {"post": {"uri": "u3", "record": {"text": "hey"}, "author": {"handle": "i"}}, "replies": [{"blocked": True}]}, {"post": {"uri": "u4"}}], "parent": {"post": {"uri": "u0", "record": {"text": "above"}, "author": {"handle": "j"}}, "replies": [{"post": {"uri": "no", "record": {}}}]}}}
WANT = {
    "x": [("1", "content", None, "v", 0), ("2", "content", None, "u", 1), ("3", "content", None, "w", 1)],
    "hacker-news": [("1", "content", None, "a", 0), ("3", "content", None, "b", 1), ("2", "unavailable", "deleted", None, 1), ("4", "unavailable", "dead", None, 2), ("9", "unavailable", "not-found", None, 1)],
    "reddit": [("p", "content", None, "op", 0), ("c1", "unavailable", "deleted", None, 1), ("c2", "content", None, "z", 2), ("more", "more", None, None, 1)],
    "bluesky": [("u0", "content", None, "j", 0), ("u1", "content", None, "h", 0), ("u2", "unavailable", "not-found", None, 1), ("u3", "content", None, "i", 1), ("unknown-post", "unavailable", "blocked", None, 2)],
}


def test_four_shapes(spark):
    shapes = {"x": X, "hacker-news": HN, "reddit": REDDIT, "bluesky": BSKY}
    rows = [("d", p, json.dumps(v)) for p, v in shapes.items()] + [("bad", "x", "{"), ("bad", "reddit", "[]"), ("bad", "bluesky", "3"), ("bad", "hacker-news", "null"), ("bad", "other", "{}"), ("bad", "x", None)]
    got = {}
    for r in P.parse_platform_threads(spark.createDataFrame(rows, "document string, platform string, json string")).orderBy("platform", "position").collect():
        assert r.document == "d"
        got.setdefault(r.platform, []).append((r.id, r.kind, r.reason, r.author, r.depth))
    assert got == WANT


@pytest.mark.parametrize("depth", [300])
def test_deeper_than_levels(spark, depth):
    v = {"kind": "t1", "data": {"id": f"c{depth}", "body": "x"}}
    for i in reversed(range(depth)):
        v = {"kind": "t1", "data": {"id": f"c{i}", "body": "x", "replies": {"data": {"children": [v]}}}}
    text = json.dumps({"post": {"kind": "t3", "data": {"id": "p", "title": "t"}}, "comments": {"data": {"children": [v]}}})
    out = P.parse_platform_threads(spark.createDataFrame([("d", "reddit", text)], "document string, platform string, json string")).orderBy("position").collect()
    assert [r.depth for r in out] == list(range(depth + 2)) and out[-1].id == f"c{depth}"
