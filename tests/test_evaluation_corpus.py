import copy
import json
import math
import random

import pytest

from vellum.operators import evaluate as E
from vellum.operators import evaluation_corpus as C


def query(i, **more):
    return {"id": f"q{i}", "text": "What is it?", "class": "no-answer" if i % 2 else "active-plan", "split": "test" if i % 2 else "development", "answer": "no-answer" if i % 2 else "answerable", "inputs": {"text": "it"}, "qrels": [{"documentId": "a", "relevance": 0 if i % 2 else 3}, {"documentId": "b", "relevance": 0}], "assessorIds": ["ann"], "adjudication": {"status": "not-required"}} | more


BASE = {"schemaVersion": 1, "id": "corpus", "description": "d", "frozen": {"repositoryCommit": "a" * 40, "vaultTree": "b" * 64, "vaultRoot": "./notes"}, "assessment": {"rubricVersion": "1", "assessors": [{"id": "ann"}, {"id": "bob", "displayName": "B"}]}, "queries": [query(0), query(1, adjudication={"status": "resolved", "adjudicatorId": "bob", "note": "n"}, inputs={"metadata": {"filters": [{"kind": "exists", "path": "a.b"}, {"kind": "equals", "path": "c", "value": None}], "tags": ["t"]}, "graph": {"seeds": ["x/y", "./z"], "depth": 2}, "context": {"repositoryPath": "."}, "history": {"query": "h", "noteIds": ["n"]}, "noteId": "x"})]}


def changed(*steps):
    """The corpus with values set (or, for ..., taken away) at paths."""
    out = copy.deepcopy(BASE)
    for path, value in steps:
        at = out
        for k in path[:-1]:
            at = at[k]
        if value is ...:
            del at[path[-1]]
        else:
            at[path[-1]] = value
    return out


Q = "queries"
CASES = {
    "right": (BASE, set()),
    "one point oh": (changed((("schemaVersion",), 1.0)), set()),
    "version": (changed((("schemaVersion",), 2)), {("schemaVersion", "value")}),
    "version text": (changed((("schemaVersion",), "1")), {("schemaVersion", "kind")}),
    "unknown": (changed((("frozen", "x.y"), {"deep": [1]}), ((Q, 0, "inputs", "zzz"), 1)), {("frozen.x.y", "unknown-field"), ("queries[0].inputs.zzz", "unknown-field")}),
    "dotted": (changed((("frozen.vaultRoot",), "n")), {("frozen.vaultRoot", "unknown-field")}),
    "missing": (changed((("id",), ...), ((Q, 1, "inputs", "graph", "depth"), ...)), {("id", "missing"), ("queries[1].inputs.graph.depth", "missing")}),
    "null": (changed((("description",), None)), {("description", "kind")}),
    "lines": (changed((("description",), "a\nb"), (("id",), "x" * 257), ((Q, 0, "text"), " \u3000")), {("description", "value"), ("id", "value"), ("queries[0].text", "value")}),
    "paths": (changed((("frozen", "vaultRoot"), "../up"), ((Q, 1, "inputs", "noteId"), "/root"), ((Q, 1, "inputs", "graph", "seeds", 0), "a/./b"), ((Q, 1, "inputs", "context", "repositoryPath"), "C:\\x")), {("frozen.vaultRoot", "value"), ("queries[1].inputs.noteId", "value"), ("queries[1].inputs.graph.seeds[0]", "value"), ("queries[1].inputs.context.repositoryPath", "value")}),
    "sizes": (changed((("assessment", "assessors"), []), ((Q, 0, "inputs"), {}), ((Q, 1, "inputs", "graph", "seeds"), [f"s{i}" for i in range(11)])), {("assessment.assessors", "size"), ("queries[0].inputs", "size"), ("queries[1].inputs.graph.seeds", "size"), ("queries[0].assessorIds[0]", "undeclared"), ("queries[1].assessorIds[0]", "undeclared"), ("queries[1].adjudication.adjudicatorId", "undeclared")}),
    "repeated": (changed((("assessment", "assessors", 1, "id"), "ann"), ((Q, 1, "id"), "q0"), ((Q, 0, "qrels", 1, "documentId"), "a"), ((Q, 1, "inputs", "metadata", "tags"), ["e\u0301", "\u00e9"])), {("assessment.assessors", "repeated"), ("queries", "repeated"), ("queries[0].qrels", "repeated"), ("queries[1].inputs.metadata.tags", "repeated"), ("queries[1].adjudication.adjudicatorId", "undeclared")}),
    "contradictions": (changed(((Q, 0, "qrels", 0, "relevance"), 0), ((Q, 1, "qrels", 0, "relevance"), 1), ((Q, 1, "adjudication"), {"status": "resolved"}), ((Q, 1, "inputs", "metadata", "filters"), [{"kind": "exists", "path": "p", "value": 1}, {"kind": "equals", "path": "p"}])), {("queries[0].answer", "inconsistent"), ("queries[1].answer", "inconsistent"), ("queries[1].adjudication", "inconsistent"), ("queries[1].inputs.metadata.filters[0]", "inconsistent"), ("queries[1].inputs.metadata.filters[1]", "inconsistent")}),
    "empty metadata": (changed(((Q, 1, "inputs", "metadata"), {"tags": []})), {("queries[1].inputs.metadata", "inconsistent")}),
    "one split": (changed(((Q, 1, "split"), "development"), ((Q, 0, "class"), "other")), {("queries", "inconsistent"), ("queries[0].class", "value")}),
    "relevance": (changed(((Q, 0, "qrels", 1, "relevance"), 2.5), ((Q, 1, "qrels", 1, "relevance"), True)), {("queries[0].qrels[1].relevance", "value"), ("queries[1].qrels[1].relevance", "kind")}),
}


def test_strict_reading(spark):
    rows = [(name, json.dumps(v)) for name, (v, _) in CASES.items()] + [("broken", "{"), ("twice", '{"id": 1, "id": 2}'), ("none", None), ("list", "[]")]
    queries, judgments, issues = C.parse_eval_corpus(spark.createDataFrame(rows, "manifest string, json string"))
    got = {}
    for r in issues.collect():
        got.setdefault(r.manifest, set()).add((r.label, r.code))
    assert {k: got.get(k, set()) for k in CASES} == {k: v for k, (_, v) in CASES.items()}
    assert got["broken"] == got["twice"] == got["none"] == {("", "malformed")} and ("", "kind") in got["list"]
    assert sorted((r.manifest, r.place, r.query_id, r.answer) for r in queries.collect()) == [(m, i, f"q{i}", "no-answer" if i else "answerable") for m in ("one point oh", "right") for i in (0, 1)]
    assert sorted(tuple(r)[1:] for r in judgments.filter("manifest = 'right'").collect()) == [("q0", "a", 3), ("q0", "b", 0), ("q1", "a", 0), ("q1", "b", 0)]


def test_report_and_its_issues(spark):
    queries = spark.createDataFrame([(1, "c", "answerable"), (2, "c", "no-answer"), (3, "d", "answerable")], "query_id int, class string, answer string")
    qrels = spark.createDataFrame([(1, "x", 3), (3, "y", 1)], "query_id int, doc_id string, relevance int")
    runs = spark.createDataFrame([("s", 1, "ready", 5.0), ("s", 2, "failed", 1.0), ("s", 3, "unavailable", 9.0), ("t", 1, "ready", 2.0), ("t", 2, "degraded", 3.0), ("t", 3, "ready", 4.0)], "system string, query_id int, status string, elapsed_ms double")
    hits = spark.createDataFrame([("s", 1, "x", 1), ("s", 3, "y", 1), ("t", 1, "z", 1), ("t", 1, "x", 2)], "system string, query_id int, doc_id string, rank int")
    measured = C.run_metrics(runs, hits, qrels, queries)
    assert {(r.system, r.query_id): (r.mrr, r.no_answer) for r in measured.collect()} == {("s", 1): (1.0, None), ("s", 2): (None, 0.0), ("s", 3): (0.0, None), ("t", 1): (0.5, None), ("t", 2): (None, 1.0), ("t", 3): (0.0, None)}
    report = {(r.system, r["class"]): r for r in C.eval_report(measured).collect()}
    assert len(report) == 6
    s = report["s", None]
    assert (s.n, s.ready, s.degraded, s.unavailable, s.failed, s.mrr, s.p50, s.p99) == (3, 1, 0, 1, 1, 0.5, 5.0, 9.0)
    assert {(r.candidate, r.metric) for r in C.comparisons(measured, "s", resamples=50).collect()} == {("t", m) for m in ("recall", "mrr", "ndcg", "no_answer")}
    assert C.report_issues(runs, queries).count() == 0
    odd = spark.createDataFrame([("s", 1, "ready", -1.0), ("s", 1, "ready", 1.0), ("s", 9, "ready", None)], runs.schema)
    assert {(r.query_id, r.code) for r in C.report_issues(odd, queries).collect()} == {(1, "time"), (1, "repeated"), (9, "unknown"), (9, "time"), (2, "missing"), (3, "missing")}


@pytest.mark.parametrize("part", [7, 1000])
def test_bootstrap_is_that_of_one_running_generator(spark, part):
    r = random.Random(1)
    rows = [(c, m, q, r.random() - 0.3) for c in ("b", "c") for m in ("mrr", "ndcg") for q in range(13)]
    got = {(x.candidate, x.metric): x for x in E.paired_bootstrap(spark.createDataFrame(rows, "candidate string, metric string, query_id int, difference double"), 5, 300, part=part).collect()}
    assert len(got) == 4
    for (c, m), x in got.items():
        values = [d for c2, m2, _, d in rows if (c2, m2) == (c, m)]
        draw = E.mulberry32(5 ^ E.fnv1a(f"{c}\0{m}"))
        means = sorted(sum(values[int(next(draw) * 13)] for _ in range(13)) / 13 for _ in range(300))
        assert math.isclose(x.low, means[math.floor(0.025 * 300)], abs_tol=1e-12) and math.isclose(x.high, means[math.ceil(0.975 * 300) - 1], abs_tol=1e-12)
