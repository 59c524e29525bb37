"""Ranked retrieval: exact, keyword (BM25), vector, and fused search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_text, search_terms

#: What a match in each field adds.
IDENTITY = {"title": 1000, "alias": 950, "path": 900}
PHRASE = {"title": 400, "alias": 350, "path": 300, "tag": 250, "content": 150, "metadata": 100}
TERM = {"title": 40, "alias": 35, "path": 30, "tag": 30, "metadata": 10, "content": 5}


def folded_fields(notes: DataFrame) -> DataFrame:
    """``notes`` (id, path, title, aliases, tags, metadata_text, content) with each searched field folded once."""
    joined = lambda c: F.array_join(F.col(c), "\n")
    fields = {"title": F.col("title"), "alias": joined("aliases"), "path": F.concat_ws("\n", "path", "id"), "tag": joined("tags"), "content": F.col("content"), "metadata": F.col("metadata_text")}
    return notes.withColumns({f"f_{k}": norm_text(F.coalesce(v, F.lit(""))) for k, v in fields.items()}).withColumn("f_aliases", F.transform("aliases", F.lower))


def exact_search(notes: DataFrame, query: str, terms: list[str], limit: int = 40) -> DataFrame:
    """id, path, identity, score of the notes that match a folded phrase and its terms, best first."""
    phrase = query
    rows = folded_fields(notes)
    identity = {"title": F.col("f_title") == phrase, "alias": F.array_contains("f_aliases", phrase), "path": F.array_contains(F.split("f_path", "\n"), phrase)}
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    has = lambda field, what: F.contains(f"f_{field}", F.lit(what))
    score: Column = sum((add(c, IDENTITY[k]) for k, c in identity.items()), F.lit(0))
    score = sum((add(has(k, phrase), n) for k, n in PHRASE.items()), score)
    matched: Column = F.lit(0)
    for t in terms:
        score = sum((add(has(k, t), n) for k, n in TERM.items()), score)
        matched = matched + add(_any(has(k, t) for k in TERM), 1)
    needed = len(terms) if len(terms) <= 1 else min(3, -(-len(terms) // 2))
    rows = rows.select("id", "path", _any(identity.values()).alias("identity"), _any(has(k, phrase) for k in PHRASE).alias("phrase"), matched.alias("matched"), score.alias("score"))
    rows = rows.filter(F.col("identity") | F.col("phrase") | (F.col("matched") >= needed))
    if terms:
        rows = rows.withColumn("score", F.col("score") + F.floor(F.col("matched") * 100 / len(terms) + 0.5))
    out = rows.filter("score > 0").select("id", "path", "identity", F.col("score").cast("bigint").alias("score"))
    return out.orderBy(F.col("identity").desc(), F.col("score").desc(), F.collate("path", "UNICODE")).limit(limit)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def exact_snippet(text: Column, phrase: str, terms: list[str], before: int = 180, width: int = 600) -> Column:
    """The text around the phrase, or else its first term, with ellipses where it is cut."""
    low = F.lower(text)
    at = F.coalesce(*(F.when(F.instr(low, p) > 0, F.instr(low, p)) for p in [phrase, *terms]), F.lit(1))
    start = F.greatest(at - before, F.lit(1))
    cut = F.substr(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + width <= F.length(text), "…").otherwise(""))


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, most_bytes: int = 64 << 20) -> DataFrame:
    """query_id, doc_id, rank, score: BM25 over (doc_id, text) for (query_id, text).

    Only words of some query leave the scan. They are dealt by document once, and counts, impacts and sums all
    keep that partitioning, so a common word is no hot key. The queries' words are broadcast while they take
    ``most_bytes`` at most; beyond that they are joined by shuffles. Statistics are exact. Top k by window.
    """
    word = r"[\p{L}\p{N}]+"
    asked = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), 0))).alias("term"))
    size = asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    small = F.broadcast if size <= most_bytes else lambda t: t
    words = docs.select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(word), 0).alias("words"))
    sizes = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"))
    found = words.select("doc_id", F.size("words").alias("length"), F.explode("words").alias("term")).join(small(asked.select("term").distinct()), "term")
    tf = found.repartition("doc_id").groupBy("doc_id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(sizes)).select("term", "mean", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    impacts = tf.join(small(idf), "term").select("doc_id", "term", part.alias("impact"))
    scored = impacts.join(small(asked), "term").groupBy("query_id", "doc_id").agg(F.sum("impact").alias("score"))
    return _top(scored.withColumn("score", F.round("score", 6)), k)


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 10, most_bytes: int = 64 << 20, least: float | None = None) -> DataFrame:
    """query_id, doc_id, rank, score: exact cosine, to five digits, of a stated query set against all vectors (doc_id, vector).

    Rows without an id, and vectors that are null, hold a null or have no length, are left out; vectors of other lengths than a query's
    are no candidates for it. A query set of ``most_bytes`` at most is multiplied with blocks of vectors, and a task passes on k rows a
    query; a larger one is joined in blocks of about that size. Equal scores go by id.
    """
    size = queries.agg(F.sum(F.greatest(F.size("vector"), F.lit(0)) * 8)).first()[0] or 0
    if size <= most_bytes:
        return _top(vectors.select("doc_id", "vector").mapInArrow(_nearest(queries.select("query_id", "vector").collect(), k, least), _score_schema(vectors, queries)), k)
    scores = None
    blocks = -(-size // most_bytes)
    for i in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        part = vectors.join(F.broadcast(block.withColumnRenamed("vector", "wanted"))).select("query_id", "doc_id", F.round(cosine(F.col("vector"), F.col("wanted")), 5).alias("score"))
        scores = part if scores is None else scores.unionByName(part)
    scores = scores.dropna()
    return _top(scores if least is None else scores.filter(F.col("score") >= least), k)


def _score_schema(vectors: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", vectors.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])


def _nearest(rows: list, k: int, least: float | None):
    """From batches of (doc_id, vector) to the k best rows (query_id, doc_id, score) of each query in the task."""
    ids, groups = [], {}
    for r in rows:
        v = np.array(r.vector if r.vector is not None else [], dtype=np.float64)
        norm = np.sqrt((v * v).sum())
        if r.query_id is not None and norm > 0:
            groups.setdefault(len(v), []).append((len(ids), v / norm))
            ids.append(r.query_id)
    wanted = {n: (np.array([i for i, _ in g]), np.stack([v for _, v in g]).T) for n, g in groups.items()}

    def reduce(parts):
        q, s, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((d, -s, q))
        first = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(q)) - first < k]
        return q[order], s[order], d[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for n, (places, matrix) in wanted.items():
                fit = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(batch.column(1)), n), pc.is_valid(batch.column(0))), False)
                some = batch.filter(fit)
                docs = some.column(0).to_numpy(zero_copy_only=False)
                docs = docs.astype(str) if docs.dtype == object else docs
                v = pc.list_flatten(some.column(1)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                norm = np.sqrt((v * v).sum(axis=1))
                by_id = np.argsort(docs, kind="stable")
                by_id = by_id[norm[by_id] > 0]
                step = max(k, 4_000_000 // len(places))
                for low in range(0, len(by_id), step):
                    rows = by_id[low : low + step]
                    score = np.rint(v[rows] / norm[rows, None] @ matrix * 100_000).astype(np.int64)
                    # One key orders by score, then by id, so that equal scores need no sort of their own.
                    key = score * len(rows) - np.arange(len(rows))[:, None]
                    top = np.argpartition(key, len(rows) - k, axis=0)[len(rows) - k :] if len(rows) > k else np.tile(np.arange(len(rows))[:, None], len(places))
                    parts.append((np.tile(places, len(top)), np.take_along_axis(score, top, axis=0).ravel(), docs[rows][top].ravel()))
                    held += top.size
                    if held > 1_000_000 + 2 * k * len(ids):
                        parts = [reduce(parts)]
                        held = len(parts[0][0])
        if parts:
            q, s, d = reduce(parts)
            score = s / 100_000
            keep = np.full(len(q), True) if least is None else score >= least
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q[keep])), pa.array(d[keep]), pa.array(score[keep])], names=["query_id", "doc_id", "score"])

    return run


def _dealt(lanes: DataFrame) -> DataFrame:
    """``lanes`` dealt by a hash of the query. Spark 4.1 takes a union of lanes that are each dealt by query for one partitioning, though
    each may be coalesced in its own way; groups by query would then be split. A repartition by the query itself would be removed."""
    return lanes.repartition(F.xxhash64("query_id"))


def rrf_fuse(lanes: DataFrame, k: int = 60) -> DataFrame:
    """query_id, doc_id, score, rank from (lane, weight, query_id, doc_id, rank).

    Each lane gives weight / (k + rank); the sum is divided by what first places in all the query's
    non-empty lanes would give. A repeated document counts once in a lane, at its first rank.
    """
    once = _dealt(lanes).groupBy("query_id", "lane", "weight", "doc_id").agg(F.min("rank").alias("rank"))
    whole = once.select("query_id", "lane", "weight").distinct().groupBy("query_id").agg(F.sum(F.col("weight") / (k + 1)).alias("best"))
    fused = once.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (F.col("rank") + k)).alias("sum"))
    scored = fused.join(whole, "query_id").select("query_id", "doc_id", F.round(F.col("sum") / F.col("best"), 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint"))


def hybrid(keyword: DataFrame, vector: DataFrame, limit: int = 10, exact: DataFrame | None = None) -> DataFrame:
    """Fused lanes with flags of where a document came from; documents of ``exact`` (identities) come first."""
    lanes = _dealt(keyword.select(F.lit("keyword").alias("lane"), F.lit(1.0).alias("weight"), "query_id", "doc_id", "rank").unionByName(vector.select(F.lit("vector").alias("lane"), F.lit(1.0).alias("weight"), "query_id", "doc_id", "rank")))
    signals = lanes.groupBy("query_id", "doc_id").agg(F.bool_or(F.col("lane") == "keyword").alias("keyword"), F.bool_or(F.col("lane") == "vector").alias("vector"))
    fused = rrf_fuse(lanes).drop("rank").join(signals, ["query_id", "doc_id"])
    first = F.lit(False)
    if exact is not None:
        fused = fused.join(exact.select("query_id", "doc_id", F.lit(True).alias("pin")), ["query_id", "doc_id"], "left")
        first = F.coalesce("pin", F.lit(False))
    w = W.partitionBy("query_id").orderBy(first.desc(), F.col("score").desc(), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit).select("query_id", "doc_id", "rank", "score", "keyword", "vector")


def terms_of(spark, query: str) -> tuple[str, list[str]]:
    """A query's folded phrase and terms, by the same expressions that fold the notes."""
    r = spark.range(1).select(norm_text(F.trim(F.lit(query))).alias("p"), search_terms(F.lit(query)).alias("t")).first()
    return r.p, r.t


def semantic_reconcile(index_rows: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows (path, hash, ...) that exactly one live note has, and the count of the others."""
    live = notes.groupBy("path", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    kept = index_rows.join(live.filter("n = 1").drop("n"), ["path", "hash"])
    gone = index_rows.join(live.filter("n = 1"), ["path", "hash"], "left_anti").agg(F.count(F.lit(1)).alias("discarded"))
    return kept, gone


def exact_evidence(notes: DataFrame, phrase: str, terms: list[str], most: int = 12) -> DataFrame:
    """id, matches: up to twelve distinct (kind, field, value) in the order of scoring."""
    rows = folded_fields(notes)
    entry = lambda kind, field, value: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lit(value).alias("value"))
    has = lambda field, what: F.contains(f"f_{field}", F.lit(what))
    found = [F.when(F.col("f_title") == phrase, entry("identity", "title", phrase)), F.when(F.array_contains("f_aliases", phrase), entry("identity", "alias", phrase)), F.when(F.array_contains(F.split("f_path", "\n"), phrase), entry("identity", "path", phrase))]
    found += [F.when(has(k, phrase), entry("phrase", k, phrase)) for k in PHRASE]
    found += [F.when(has(k, t), entry("term", k, t)) for t in terms for k in TERM]
    return rows.select("id", F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, most).alias("matches")).filter("size(matches) > 0")


def candidate_window(limit: int, filtered: bool) -> int:
    """How many candidates an index is asked for."""
    return 500 if filtered else max(40, 4 * limit)


def accepted(candidates: DataFrame, allowed: DataFrame, least: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` candidates (query_id, doc_id, rank, score) that are allowed and score enough, ranked anew; and counts of what went."""
    judged = candidates.join(allowed.select("doc_id", F.lit(True).alias("ok")), "doc_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    w = W.partitionBy("query_id").orderBy("rank")
    kept = judged.filter(F.col("ok") & (F.col("score") >= least)).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit)
    counted = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), F.count_if(~F.col("ok")).alias("discarded"), F.count_if(F.col("ok") & (F.col("score") < least)).alias("rejected"))
    return kept.select("query_id", "doc_id", "rank", "score"), counted
