"""Scopes and targets in many cells: the same rows as pair by pair, without a shuffle of the pairs."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import memory

TARGETS = [*(f"a/b/t{i}" for i in range(60)), *(f"a/c{i}/x" for i in range(5)), "a/b/t1", "a/b/t1", "a", "b/q", "none/x", None]
SCOPES = [*((f"n{i}", "a/b") for i in range(70)), *((f"n{i}", "a") for i in range(40, 90)), ("n1", "."), ("n2", "a/b/t2"), ("n3", "b"), ("n3", "b"), (None, "b"), ("n4", None), ("n5", "a/b/t")]


def pairs() -> list[tuple]:
    above = lambda t: {".", *("/".join(t.split("/")[: n + 1]) for n in range(t.count("/") + 1))}
    return [(t, i, s, 0 if s == "." else s.count("/") + 1, "exact" if s == t else "ancestor") for t in TARGETS if t is not None for i, s in SCOPES if s in above(t)]


@pytest.fixture
def tables(spark, monkeypatch):
    monkeypatch.setattr(memory, "CELL", 8, raising=False)
    return spark.createDataFrame([(t,) for t in TARGETS], "target string"), spark.createDataFrame(SCOPES, "id string, scope string")


def shuffled(df) -> int:
    """Rows that the frame's shuffles write."""

    def walk(node) -> int:
        for inner in ("executedPlan", "plan"):
            if node.nodeName().startswith(("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")) and hasattr(node, inner):
                try:
                    return walk(getattr(node, inner)())
                except Exception:  # noqa: BLE001, S112
                    continue
        written = node.metrics().get("shuffleRecordsWritten") if node.nodeName() == "Exchange" else None
        below = node.children()
        return (written.get().value() if written is not None and written.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_deepest_scopes_in_cells(spark, tables):
    best = {}
    for p in pairs():
        best[p[:2]] = max(p, best.get(p[:2], p), key=lambda p: p[3])
    got = memory.deepest_scopes(*tables)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(best.values(), key=repr)


def test_deepest_scopes_do_not_shuffle_their_rows(spark):
    t = spark.range(500).selectExpr("concat('a/b/t', id) AS target")
    s = spark.range(400).selectExpr("concat('n', id) AS id", "if(id % 2 = 0, 'a', 'a/b') AS scope")
    df = memory.deepest_scopes(t, s)
    assert df.count() == 200_000
    assert 0 < shuffled(df) < 20_000


def test_context_ranks_once_a_scope(spark, tables):
    notes = [(f"n{i}", "ab"[i % 2], f"title {i % 7}", f"p{i:02}") for i in range(95)]
    depth, of, want = {}, {n[0]: n for n in notes}, []
    for t, i, _, d, _ in pairs():
        depth[t, i] = max(d, depth.get((t, i), d))
    for t in {t for t, _ in depth}:
        for g in "ab":
            held = sorted((-d, *of[i][2:], i) for (x, i), d in depth.items() if x == t and i in of and of[i][1] == g)
            want += [(t, g, h[-1], n, len(held), len(held) > 3) for n, h in enumerate(held[:3], 1)]
    got = memory.memory_context(*tables, spark.createDataFrame(notes, "id string, group string, title string, path string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_context_does_not_shuffle_matches(spark):
    t = spark.range(500).selectExpr("concat('a/b/t', id) AS target")
    s = spark.range(400).selectExpr("concat('n', id) AS id", "if(id % 2 = 0, 'a', 'a/b') AS scope")
    n = s.selectExpr("id", "'g' AS group", "id AS title", "id AS path")
    df = memory.memory_context(t, s, n)
    assert df.count() == 1500
    assert 0 < shuffled(df) < 20_000


def test_matches_in_cells(spark, tables):
    got = memory.scope_matches(*tables)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((t, i, s, d, k) for t, i, s, d, k in pairs()), key=repr)


def test_one_scope_is_paired_in_many_tasks(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = memory.scope_matches(*tables).filter("scope = 'a/b'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) > 1
    assert max(r["count"] for r in got) < sum(r["count"] for r in got) * 0.75
