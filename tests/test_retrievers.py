import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import retrievers as R
from vellum.operators import search


def notes(spark):
    rows = [("a/small-ring", "Small Ring", ["band"], ["Metal"], "a ring, small and RED", '{"kind":"ring"}'), ("b", "band", None, [], "nothing", ""), ("c", "Other", ["small ring", "x"], ["ring"], None, ""), ("d/ring", "", [], [], "line\nsmall ring here", "ring"), ("e", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, title string, aliases array<string>, tags array<string>, content string, metadata_text string")
    return df.withColumns({"path": F.concat("id", F.lit(".md")), "tags": F.coalesce("tags", F.array().cast("array<string>")), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})


def test_exact_scores_are_those_of_one_query_at_a_time(spark):
    n = notes(spark)
    asked = ["Small Ring", "band", "ring red metal nothing", "b", "d/ring.md", "the of", "none of these"]
    got = R.exact_scores(n, spark.createDataFrame([(q, q) for q in asked] + [("null", None), ("blank", "  ")], "query_id string, text string"))
    hits = {(r.query_id, r.doc_id): (r.rank, r.score) for r in R.exact_hits(got, 10).collect()}
    want = {}
    for q in asked:
        rows = search.exact_search(n, *search.terms_of(spark, q), limit=10).collect()
        want |= {(q, r.id): (i, float(r.score)) for i, r in enumerate(rows, 1)}
    assert hits == want and len(want) == 10


def walk(edges, start, depth, limit, direction):
    """One search after another, note by note."""
    distance, frontier, cut = {start: 0}, [start], False
    for d in range(1, depth + 1):
        found = []
        for node in sorted(frontier):
            mine = [e for e in edges if direction != "in" and e[0] == node] + [e for e in edges if direction != "out" and e[1] == node]
            for s, t in sorted(mine):
                other = t if s == node else s
                if other in distance:
                    continue
                if len(distance) >= limit:
                    cut = True
                    continue
                distance[other] = d
                found.append(other)
        frontier = found
    return distance, cut


@pytest.mark.parametrize("direction", ["both", "in", "out"])
def test_many_searches_at_once(spark, direction):
    r = random.Random(4)
    edges = sorted({(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(90)})
    edges = [e for e in edges if e[0] != e[1]]
    starts = [(q, s, f"n{r.randrange(44):02}") for q in range(6) for s in range(3)] + [(9, 0, "n00"), (9, 1, "n00")]
    df = spark.createDataFrame(edges, "source string, target string")
    nodes, cut = R.neighbourhoods(df, spark.createDataFrame(starts, "query_id int, seed_rank int, seed string"), 3, 8, direction)
    got = {}
    for x in nodes.collect():
        got.setdefault((x.query_id, x.seed_rank), {})[x.node] = x.distance
    want = {(q, s): walk(edges, n, 3, 8, direction) for q, s, n in starts}
    assert got == {k: v[0] for k, v in want.items()}
    assert {tuple(x) for x in cut.collect()} == {k for k, v in want.items() if v[1]}


def test_graph_hits_keep_the_first_seeds_distance(spark):
    nodes = spark.createDataFrame([(1, 1, "a", 0), (1, 1, "b", 1), (1, 1, "c", 2), (1, 2, "c", 0), (1, 2, "d", 1), (2, 1, "z", 0)], "query_id int, seed_rank int, node string, distance int")
    got = [tuple(r) for r in R.graph_hits(nodes, 10).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a", 1, 1.0), (1, "b", 2, 0.5), (1, "d", 3, 0.5), (1, "c", 4, 1 / 3), (2, "z", 1, 1.0)]
    assert R.graph_hits(nodes, 2).count() == 3


def test_metadata_hybrid_path_and_history(spark):
    leaves = spark.createDataFrame([("a", "k", "v"), ("a", "k", "w"), ("a", "l", "x"), ("b", "k", "v"), ("a", "k", "v")], "id string, field string, value string")
    paths = spark.createDataFrame([("a", "z.md"), ("b", "A.md")], "id string, path string")
    asked = spark.createDataFrame([(1, "k", "V"), (2, "k", "v"), (2, "l", "x"), (3, "k", "v"), (3, "k", "none")], "query_id int, field string, value string")
    assert [tuple(r)[:3] for r in R.metadata_hits(leaves, asked, paths, 5).orderBy("query_id", "rank").collect()] == [(1, "b", 1), (1, "a", 2), (2, "a", 1)]
    exact = spark.createDataFrame([(1, "p", 1, False), (1, "q", 2, True)], "query_id int, doc_id string, rank int, identity boolean")
    index = spark.createDataFrame([(1, "p", 1), (1, "r", 2), (2, "r", 1)], "query_id int, doc_id string, rank int")
    got = R.hybrid_hits(exact, index, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.exact, r.semantic) for r in got] == [(1, "q", True, False), (1, "p", True, True), (1, "r", False, True), (2, "r", False, True)]
    assert got[1].score == 1.0 and got[3].score == 1.0
    hubs = spark.createDataFrame([(1, "hub", 1), (1, "plan", 2)], "query_id int, doc_id string, rank int")
    memory = spark.createDataFrame([(1, "activePlans", "plan", 1), (1, "maintainedKnowledge", "kept", 1), (1, "historicalPlans", "old", 1)], "query_id int, group string, doc_id string, rank int")
    assert [r.doc_id for r in R.path_hits(hubs, memory, 9).orderBy("rank").collect()] == ["hub", "plan", "kept", "old"]
    named = spark.createDataFrame([(1, "n2", 1), (1, "n1", 2)], "query_id int, doc_id string, rank int")
    searched = spark.createDataFrame([(1, "n1", 1, 7.0), (1, "n3", 2, 3.0)], "query_id int, doc_id string, rank int, score double")
    assert [(r.doc_id, r.score) for r in R.history_hits(named, searched, 9).orderBy("rank").collect()] == [("n2", None), ("n1", 7.0), ("n3", 3.0)]


def test_what_a_query_has_no_input_for(spark):
    q = spark.createDataFrame([(1, "text"), (2, None)], "query_id int, text string")
    hits = spark.createDataFrame([(1, "d", 1, 1.0)], "query_id int, doc_id string, rank int, score double")
    out = R.adapted(q, {"exact": (F.col("text").isNotNull(), hits), "graph": (F.lit(None).cast("boolean"), hits)})
    assert sorted(map(tuple, out.collect())) == [(1, "exact", "ready", 1), (1, "graph", "unavailable", 0), (2, "exact", "unavailable", 0), (2, "graph", "unavailable", 0)]
