"""Evaluation corpora as strict, versioned JSON, and the report over what retrievers did with one.

A manifest is taken apart into nodes, one row for each value at its place, by exploding VARIANT level by level. What may stand where is a table; unknown, missing, wrong and
repeated values are joins and groupings of nodes with it, and come back as rows. Only manifests without an issue give queries and judgments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc
from .evaluate import eval_metrics, metric_means, paired, paired_bootstrap
from .query import checkpointed

_SEP = "\u001f"
_TEXT = 16 * 1024
_OBJECT_ID = "^[0-9a-f]{40}([0-9a-f]{24})?$"
_CONFINED = r"^(?![A-Za-z]:[\\/])(?:\.[\\/])?(?!\.{1,2}(?:[\\/]|$))[^\\/]+(?:[\\/](?!\.{1,2}(?:[\\/]|$))[^\\/]+)*$"
_CONFINED_OR_ROOT = r"^\.$|" + _CONFINED
_VAULT_ROOT = r"^(?![A-Za-z]:[\\/])(?!\.\.(?:[\\/]|$))[^\\/]+(?:[\\/](?!\.\.(?:[\\/]|$))[^\\/]+)*$"
#: The fields of a corpus: (path, kind, required, pattern or choices, least and most entries or bytes).
CLASSES = ("active-plan", "code-path-context", "conceptual-recall", "current-decision", "exact-identifier", "historical-rationale", "no-answer", "source-evidence", "stale-current-conflict")
FIELDS = [
    ("", "object", True, None, 0, 0),
    ("schemaVersion", "number", True, "^1$", 0, 0),
    ("id", "string", True, None, 0, 256),
    ("description", "string", True, None, 0, _TEXT),
    ("frozen", "object", True, None, 0, 0),
    ("frozen.repositoryCommit", "string", True, _OBJECT_ID, 0, _TEXT),
    ("frozen.vaultTree", "string", True, _OBJECT_ID, 0, _TEXT),
    ("frozen.vaultRoot", "string", True, _VAULT_ROOT, 0, _TEXT),
    ("assessment", "object", True, None, 0, 0),
    ("assessment.rubricVersion", "string", True, None, 0, 256),
    ("assessment.assessors", "array", True, None, 1, 100),
    ("assessment.assessors[]", "object", False, None, 0, 0),
    ("assessment.assessors[].id", "string", True, None, 0, 256),
    ("assessment.assessors[].displayName", "string", False, None, 0, _TEXT),
    ("assessment.assessors[].affiliation", "string", False, None, 0, _TEXT),
    ("queries", "array", True, None, 1, 2000),
    ("queries[]", "object", False, None, 0, 0),
    ("queries[].id", "string", True, None, 0, 256),
    ("queries[].text", "string", True, None, 0, _TEXT),
    ("queries[].class", "string", True, f"^({'|'.join(CLASSES)})$", 0, _TEXT),
    ("queries[].split", "string", True, "^(development|test)$", 0, _TEXT),
    ("queries[].answer", "string", True, "^(answerable|no-answer)$", 0, _TEXT),
    ("queries[].qrels", "array", True, None, 0, 2000),
    ("queries[].qrels[]", "object", False, None, 0, 0),
    ("queries[].qrels[].documentId", "string", True, None, 0, _TEXT),
    ("queries[].qrels[].relevance", "number", True, "^[0-3]$", 0, 0),
    ("queries[].assessorIds", "array", True, None, 1, 100),
    ("queries[].assessorIds[]", "string", False, None, 0, _TEXT),
    ("queries[].adjudication", "object", True, None, 0, 0),
    ("queries[].adjudication.status", "string", True, "^(not-required|resolved)$", 0, _TEXT),
    ("queries[].adjudication.adjudicatorId", "string", False, None, 0, _TEXT),
    ("queries[].adjudication.note", "string", False, None, 0, _TEXT),
    ("queries[].inputs", "object", True, None, 1, 6),
    ("queries[].inputs.text", "string", False, None, 0, _TEXT),
    ("queries[].inputs.noteId", "string", False, _CONFINED, 0, _TEXT),
    ("queries[].inputs.metadata", "object", False, None, 0, 0),
    ("queries[].inputs.metadata.filters", "array", False, None, 0, 32),
    ("queries[].inputs.metadata.filters[]", "object", False, None, 0, 0),
    ("queries[].inputs.metadata.filters[].kind", "string", True, "^(exists|equals)$", 0, _TEXT),
    ("queries[].inputs.metadata.filters[].path", "string", True, None, 0, 2048),
    ("queries[].inputs.metadata.filters[].value", "scalar", False, None, 0, _TEXT),
    ("queries[].inputs.metadata.tags", "array", False, None, 0, 32),
    ("queries[].inputs.metadata.tags[]", "string", False, None, 0, _TEXT),
    ("queries[].inputs.graph", "object", False, None, 0, 0),
    ("queries[].inputs.graph.seeds", "array", True, None, 1, 10),
    ("queries[].inputs.graph.seeds[]", "string", False, _CONFINED, 0, _TEXT),
    ("queries[].inputs.graph.depth", "number", True, "^[12]$", 0, 0),
    ("queries[].inputs.context", "object", False, None, 0, 0),
    ("queries[].inputs.context.repositoryPath", "string", True, _CONFINED_OR_ROOT, 0, _TEXT),
    ("queries[].inputs.history", "object", False, None, 0, 0),
    ("queries[].inputs.history.query", "string", True, None, 0, 2048),
    ("queries[].inputs.history.noteIds", "array", False, None, 0, 100),
    ("queries[].inputs.history.noteIds[]", "string", False, _CONFINED, 0, _TEXT),
]
#: Lists whose entries, or the named field of whose entries, must not repeat.
DISTINCT = ["assessment.assessors[].id", "queries[].id", "queries[].qrels[].documentId", "queries[].assessorIds[]", "queries[].inputs.metadata.tags[]", "queries[].inputs.graph.seeds[]", "queries[].inputs.history.noteIds[]"]


def _path(dotted: str) -> str:
    return dotted.replace(".", _SEP)


def _levels(path: str) -> int:
    return path.count(".") + path.count("[]") + bool(path)


def nodes(manifests: DataFrame) -> DataFrame:
    """manifest, label, path, parent, kind, text of each value of (manifest, json): where it stands, its place in the schema, what it stands in.

    ``kind`` is object, array, string, number, boolean, null, or malformed for JSON that can't be read or repeats a key; ``text`` is a scalar's text. Below an unknown field nothing is looked at.
    """
    spark = manifests.sparkSession
    known = spark.createDataFrame([(_path(f[0]),) for f in FIELDS], "path string")
    v = F.try_parse_json("json")
    level = manifests.select("manifest", F.lit("").alias("label"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("size"), v.alias("v"))
    out = None
    for depth in range(max(_levels(f[0]) for f in FIELDS) + 1):
        level = checkpointed(level.withColumn("kind", _kind(F.col("v"))))
        part = level.select("manifest", "label", "path", "parent", "key", "kind", F.coalesce(F.try_variant_get("v", "$", "string"), F.when(F.col("kind").isin("number", "boolean"), F.to_json("v"))).alias("text"))
        out = part if out is None else out.unionByName(part)
        held = level.filter("kind IN ('object', 'array')").join(F.broadcast(known), "path", "left_semi")
        below = spark.sql("SELECT t.manifest, t.label, t.path, t.kind, e.pos, e.key, e.value FROM {t} t, LATERAL variant_explode(t.v) e", t=held)
        in_list = F.col("kind") == "array"
        deeper = lambda c: F.when(in_list, F.concat(c, F.when(F.lit(c == "path"), F.lit("[]")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))).when(F.col(c) == "", F.col("key")).otherwise(F.concat(F.col(c), F.lit(_SEP if c == "path" else "."), F.col("key")))
        level = below.select("manifest", deeper("label").alias("label"), deeper("path").alias("path"), F.col("label").alias("parent"), "key", F.lit(0).alias("size"), F.col("value").alias("v"))
    return out


def _kind(v: Column) -> Column:
    schema = F.schema_of_variant(v)
    return F.when(v.isNull(), "malformed").when(F.is_variant_null(v), "null").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("number")


def parse_eval_corpus(manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, judgments, issues) of manifests (manifest, json).

    Queries: manifest, place, query_id, text, class, split, answer. Judgments: manifest, query_id, doc_id, relevance. Issues: manifest, label (where), code: malformed, unknown-field,
    missing, kind, value, size, repeated, undeclared or inconsistent. A manifest with any issue gives no queries; all its issues are listed.
    Two manifests of one name are one. Ids are compared in NFC.
    """
    spark = manifests.sparkSession
    n = checkpointed(nodes(manifests).withColumn("text", nfc(F.col("text"))))
    rules = F.broadcast(spark.createDataFrame([(_path(p), k, r, c, lo, hi) for p, k, r, c, lo, hi in FIELDS], "path string, wanted string, required boolean, pattern string, least int, most int"))
    judged = n.join(rules, "path", "left")
    right = (F.col("kind") == F.col("wanted")) | ((F.col("wanted") == "scalar") & F.col("kind").isin("string", "number", "boolean", "null"))
    text = F.col("kind") == "string"
    blank = ~F.col("text").rlike(r"(?U)[^\s\x{FEFF}]") | F.col("text").rlike("[\\x00\\r\\n]") | (F.octet_length("text") > F.col("most"))
    off = F.when(text, blank | ~F.coalesce(F.expr("text rlike pattern"), F.lit(True))).when(F.col("kind") == "number", ~F.coalesce(F.expr("regexp_replace(text, '[.]0+$', '') rlike pattern"), F.lit(True))).otherwise(False)
    code = F.when(F.col("kind") == "malformed", "malformed").when(F.col("wanted").isNull(), "unknown-field").when(~right, "kind").when(off, "value")
    issues = judged.select("manifest", "label", code.alias("code")).filter("code IS NOT NULL")
    plain = n.select("manifest", "label", "path", "parent", "key", "kind", "text")
    children = plain.filter("parent IS NOT NULL").groupBy("manifest", F.col("parent").alias("label")).agg(F.count(F.lit(1)).alias("entries"))
    sized = judged.filter("kind = 'array' AND wanted = 'array' OR least > 0 AND kind = 'object'").select("manifest", "label", "least", "most").join(children, ["manifest", "label"], "left")
    issues = issues.union(sized.filter("coalesce(entries, 0) NOT BETWEEN least AND most").select("manifest", "label", F.lit("size")))
    needed = spark.createDataFrame([(_path(p.rpartition(".")[0]), p.rpartition(".")[2]) for p, _, r, *_ in FIELDS if r and p], "path string, key string")
    owed = plain.filter("kind = 'object'").select("manifest", "label", "path").join(F.broadcast(needed), "path").select("manifest", F.col("label").alias("parent"), "key")
    lacking = owed.join(plain.select("manifest", "parent", "key"), ["manifest", "parent", "key"], "left_anti")
    issues = issues.union(lacking.select("manifest", F.concat_ws(".", F.when(F.col("parent") != "", F.col("parent")), F.col("key")), F.lit("missing")))
    group = F.when(F.col("path").endswith("[]"), F.col("parent")).otherwise(F.regexp_replace("parent", r"\[\d+\]$", ""))
    again = plain.filter(F.col("path").isin([_path(p) for p in DISTINCT]) & (F.col("kind") == "string")).groupBy("manifest", group.alias("label"), "path", "text").count().filter("count > 1")
    issues = issues.union(again.select("manifest", "label", F.lit("repeated")))
    issues = issues.union(_references(plain)).union(_consistency(plain)).distinct()
    good = plain.select("manifest").distinct().join(issues.select("manifest").distinct(), "manifest", "left_anti")
    queries, judgments = _tables(plain.join(good, "manifest", "left_semi"))
    return queries, judgments, issues


def _at(plain: DataFrame, *dotted: str) -> DataFrame:
    return plain.filter(F.col("path").isin([_path(p) for p in dotted]))


def _references(plain: DataFrame) -> DataFrame:
    """Assessors that a query names and no one declares."""
    declared = _at(plain, "assessment.assessors[].id").select("manifest", "text")
    named = _at(plain, "queries[].assessorIds[]", "queries[].adjudication.adjudicatorId").filter("kind = 'string'")
    return named.join(declared, ["manifest", "text"], "left_anti").select("manifest", "label", F.lit("undeclared").alias("code"))


def _consistency(plain: DataFrame) -> DataFrame:
    """Fields that contradict one another."""
    query = lambda c: F.regexp_extract(c, r"^queries\[\d+\]", 0)
    positive = _at(plain, "queries[].qrels[].relevance").filter("text IN ('1', '2', '3', '1.0', '2.0', '3.0')").select("manifest", query("label").alias("q"), F.lit(True).alias("positive")).distinct()
    answers = _at(plain, "queries[].answer").select("manifest", F.col("parent").alias("q"), "label", "text").join(positive, ["manifest", "q"], "left")
    wrong = answers.filter("text = 'answerable' AND positive IS NULL OR text = 'no-answer' AND positive")
    out = wrong.select("manifest", "label", F.lit("inconsistent").alias("code"))
    status = _at(plain, "queries[].adjudication.status").filter("text = 'resolved'").select("manifest", "parent")
    by = _at(plain, "queries[].adjudication.adjudicatorId").select("manifest", "parent")
    out = out.union(status.join(by, ["manifest", "parent"], "left_anti").select("manifest", "parent", F.lit("inconsistent")))
    kinds = _at(plain, "queries[].inputs.metadata.filters[].kind").select("manifest", "parent", "text")
    values = _at(plain, "queries[].inputs.metadata.filters[].value").select("manifest", "parent", F.lit(True).alias("given"))
    filters = kinds.join(values, ["manifest", "parent"], "left").filter("text = 'exists' AND given OR text = 'equals' AND given IS NULL")
    out = out.union(filters.select("manifest", "parent", F.lit("inconsistent")))
    metadata = _at(plain, "queries[].inputs.metadata").filter("kind = 'object'").select("manifest", "label")
    some = _at(plain, "queries[].inputs.metadata.filters[]", "queries[].inputs.metadata.tags[]").select("manifest", F.regexp_replace("parent", r"\.[^.]*$", "").alias("label"))
    out = out.union(metadata.join(some, ["manifest", "label"], "left_anti").select("manifest", "label", F.lit("inconsistent")))
    splits = _at(plain, "queries[].split").groupBy("manifest").agg(F.count_distinct("text").alias("n")).filter("n < 2")
    return out.union(splits.select("manifest", F.lit("queries"), F.lit("inconsistent")))


def _tables(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    field = lambda k: F.max(F.when(F.col("key") == k, F.col("text"))).alias(k)
    own = _at(plain, *(f"queries[].{k}" for k in ("id", "text", "class", "split", "answer"))).groupBy("manifest", F.col("parent").alias("q")).agg(*(field(k) for k in ("id", "text", "class", "split", "answer")))
    queries = own.select("manifest", F.regexp_extract("q", r"\d+", 0).cast("int").alias("place"), F.col("id").alias("query_id"), "text", "class", "split", "answer")
    qrels = _at(plain, "queries[].qrels[].documentId", "queries[].qrels[].relevance").groupBy("manifest", F.col("parent").alias("r")).agg(field("documentId"), field("relevance"))
    qrels = qrels.withColumn("q", F.regexp_extract("r", r"^queries\[\d+\]", 0)).join(own.select("manifest", "q", "id"), ["manifest", "q"])
    return queries, qrels.select("manifest", F.col("id").alias("query_id"), F.col("documentId").alias("doc_id"), F.col("relevance").cast("double").cast("int").alias("relevance"))


#: What a run can end as.
STATUSES = ("ready", "degraded", "unavailable", "failed")


def run_metrics(runs: DataFrame, hits: DataFrame, qrels: DataFrame, queries: DataFrame, cutoff: int = 10) -> DataFrame:
    """system, query_id, class, status, elapsed_ms, recall, mrr, ndcg, no_answer of every run (system, query_id, status, elapsed_ms).

    ``queries`` has query_id, class and answer, ``hits`` system, query_id, doc_id and rank, ``qrels`` query_id, doc_id and relevance. Runs that failed or were unavailable score zero.
    """
    key = lambda t: t.withColumn("query_id", F.struct("system", "query_id"))
    asked = runs.select("system", "query_id")
    of = eval_metrics(key(hits), key(asked.join(qrels, "query_id")), key(asked), cutoff)
    flat = of.select(F.col("query_id.system").alias("system"), F.col("query_id.query_id").alias("query_id"), "recall", "mrr", "ndcg", "no_answer")
    out = runs.join(queries.select("query_id", "class", "answer"), "query_id").join(flat, ["system", "query_id"])
    lost, none = F.col("status").isin("failed", "unavailable"), F.col("answer") == "no-answer"
    value = lambda m, answers: F.when(lost, F.when(none == answers, 0)).otherwise(F.col(m))
    return out.select("system", "query_id", "class", "status", "elapsed_ms", *(value(m, False).cast("double").alias(m) for m in ("recall", "mrr", "ndcg")), value("no_answer", True).cast("double").alias("no_answer"))


def eval_report(measured: DataFrame) -> DataFrame:
    """system, class (null: all), n, statuses, metric means and latency percentiles (nearest rank) of :func:`run_metrics`."""
    groups = [["system"], ["system", "class"]]
    counted = measured.groupingSets(groups, "system", "class").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), *(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY elapsed_ms)").alias(f"p{p}") for p in (50, 90, 95, 99)))
    means = metric_means(measured)
    named = means.withColumnsRenamed({"system": "s", "class": "c"})
    return counted.join(named, (F.col("system") == F.col("s")) & F.col("class").eqNullSafe(F.col("c"))).drop("s", "c")


def report_issues(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """system, query_id, code of runs that make a report impossible: unknown or repeated queries, queries that a system lacks, bad times."""
    unknown = runs.join(queries.select("query_id"), "query_id", "left_anti").select("system", "query_id", F.lit("unknown").alias("code"))
    again = runs.groupBy("system", "query_id").count().filter("count > 1").select("system", "query_id", F.lit("repeated"))
    owed = runs.select("system").distinct().crossJoin(F.broadcast(queries.select("query_id").distinct()))
    lacking = owed.join(runs.select("system", "query_id"), ["system", "query_id"], "left_anti").select("system", "query_id", F.lit("missing"))
    late = runs.filter("elapsed_ms IS NULL OR elapsed_ms < 0 OR isnan(elapsed_ms) OR elapsed_ms = double('infinity')").select("system", "query_id", F.lit("time"))
    return unknown.union(again).union(lacking).union(late)


def comparisons(measured: DataFrame, baseline: str, seed: int = 1, resamples: int = 10_000) -> DataFrame:
    """candidate, metric, mean, low, high: each system against the baseline, by paired bootstrap over the queries that both have."""
    out = None
    for metric in ("recall", "mrr", "ndcg", "no_answer"):
        part = paired(measured, baseline, metric)
        out = part if out is None else out.unionByName(part)
    return paired_bootstrap(out, seed, resamples)
