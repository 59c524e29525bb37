"""Hard negatives: bit-sliced integer inner products of a stated set of anchors with all vectors.

Components are scaled and floored to integers. Anchors and vectors meet in the cells of a grid, a block of anchors
with a block of vectors; in a cell the bits of the vectors' components are processed plane by plane, the most significant
first. After each plane a score is known to lie in an interval, whose width halves with the next plane; a pair is dropped
as soon as its interval shows that it can't be among the first ``k``, or in a positive's window of scores. While most
pairs live, a plane is one matrix product; after that only the pairs that are left are multiplied. Sums are exact
(floats only below the size up to which they hold all integers).

Two passes: the first finds each anchor's positives, the second the negatives in each positive's window. A cell sends
on its own first ``k`` for each anchor or window; a window function picks from those of all cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pick, table

#: Integer components beyond this count as this, so that 90 times the product of vectors of up to 4,096 components fits 64 bits.
LARGEST = 1 << 22
#: Anchors a block and vectors a cell, and how many of each are multiplied at once.
BLOCK, CELL, ANCHORS, ROWS = 4096, 16384, 256, 4096


def _lowest(kind: np.dtype):
    return -np.inf if kind.kind == "f" else np.iinfo(kind).min


def _highest_but(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest value of each row, where there are so many."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), _lowest(values.dtype), values.dtype)


def _leading(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: higher scores first, ties by smaller identity."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    return order[np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)])) < k]


class Windows:
    """Which pairs can still be among the first ``k`` of a window of scores; an anchor has one or several, ``low`` to ``high``.

    ``floor`` is at least ``low``, and rises to a score that ``k`` pairs of the window reach for certain.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.floor, self.k = low, high, low.copy(), k

    def dense(self, least: np.ndarray, most: np.ndarray, alive: np.ndarray) -> np.ndarray:
        out = np.zeros_like(alive)
        for w in range(self.low.shape[1]):
            low, high = self.low[:, w, None], self.high[:, w, None]
            certain = alive & (least >= low) & (most <= high)
            if certain.any():
                self.floor[:, w] = np.maximum(self.floor[:, w], _highest_but(np.where(certain, least, _lowest(least.dtype)), self.k))
            out |= (most >= self.floor[:, w, None]) & (least <= high)
        return out & alive

    def sparse(self, least: np.ndarray, most: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for w in range(self.low.shape[1]):
            high = self.high[i, w]
            certain = np.flatnonzero((least >= self.low[i, w]) & (most <= high))
            self.raise_to(w, i[certain], least[certain])
            out |= (most >= self.floor[i, w]) & (least <= high)
        return out

    def raise_to(self, w: int, i: np.ndarray, score: np.ndarray) -> None:
        """The k-th of the given scores of each anchor is reached for certain."""
        at = _leading(i, score, i, self.k)
        anchor, places = np.unique(i[at], return_counts=True)
        full = anchor[places == self.k]
        last = np.cumsum(places)[places == self.k] - 1
        self.floor[full, w] = np.maximum(self.floor[full, w], score[at][last])


def exact_kind(anchors: np.ndarray, rows: np.ndarray) -> np.dtype:
    """A type that holds every sum exactly: floats where those are small enough, else 64-bit integers."""
    largest = 4.0 * max(1, np.abs(anchors).sum(axis=1, dtype=np.float64).max(initial=0)) * max(1, np.abs(rows).max(initial=0))
    return np.dtype(np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else np.int64)


def sliced(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray, judge: Windows, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs that ``judge`` leaves of the ``alive`` ones, with their exact inner products.

    Components are taken as an offset plus bits: x = u - half with u >= 0. With the planes above bit b added up,
    what is missing of a product is between -(2**b - 1) times the anchor's negative and (2**b - 1) times its positive components.
    """
    bits = int(max(int(rows.max(initial=0)), -int(rows.min(initial=0)) - 1)).bit_length() + 1
    half = 1 << (bits - 1)
    u = rows + half
    a = anchors.astype(kind)
    above, below = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1)
    score = np.repeat((-half * a.sum(axis=1))[:, None], len(rows), axis=1)
    i = j = None
    for b in reversed(range(bits)):
        plane, rest = ((u >> b) & 1).astype(kind), (1 << b) - 1
        if i is None:
            score += (a @ plane.T) * kind.type(1 << b)
            alive = judge.dense(score + (rest * below)[:, None], score + (rest * above)[:, None], alive)
            if b == 0 or np.count_nonzero(alive) * 16 < alive.size:
                i, j = np.nonzero(alive)
                score = score[i, j]
        else:
            score = score + np.einsum("ij,ij->i", a[i], plane[j]) * kind.type(1 << b)
            keep = judge.sparse(score + rest * below[i], score + rest * above[i], i)
            i, j, score = i[keep], j[keep], score[keep]
    return i, j, score


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end with zeros."""
    column = column.combine_chunks()
    ends = np.asarray(column.offsets, dtype=np.int64)
    sizes, flat = np.diff(ends), np.asarray(column.values, dtype=np.int64)[ends[0] : ends[-1]]
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _lists(column: pa.ChunkedArray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(column), width), fill, np.int64)
    for at, row in enumerate(column.to_pylist()):
        out[at, : len(row)] = row
    return out


def search(anchors: pa.Table, vectors: pa.Table, same: bool, k: int) -> dict[str, list[np.ndarray]]:
    """The first ``k`` of a cell for each anchor's windows: columns ``at`` (anchor), ``window``, ``row`` and ``score``.

    ``anchors`` has uid, label, v, low and high (lists, one entry a window); ``vectors`` uid, vec_id, label and v, in any order.
    Pairs have the same label, or different ones, and are never an anchor with itself.
    """
    width = max((len(x) for t in (anchors, vectors) for x in t["v"].to_pylist()), default=0)
    found: dict[str, list[np.ndarray]] = {n: [] for n in ("at", "window", "row", "score")}
    all_a, all_v = _matrix(anchors["v"], width), _matrix(vectors["v"], width)
    columns = [np.asarray(t[c].combine_chunks()) for t in (anchors, vectors) for c in ("uid", "label")]
    ident = np.asarray(vectors["vec_id"].combine_chunks())
    wide = max((len(x) for x in anchors["low"].to_pylist()), default=0)
    all_low, all_high = _lists(anchors["low"], wide, 1), _lists(anchors["high"], wide, 0)
    kind = exact_kind(all_a, all_v)
    for low in range(0, len(all_a), ANCHORS):
        part = slice(low, low + ANCHORS)
        a, uid, label = all_a[part], columns[0][part], columns[1][part]
        judge = Windows(all_low[part], all_high[part], k)
        empty = judge.low > judge.high
        edge = np.finfo(kind) if kind.kind == "f" else np.iinfo(kind)
        judge.low, judge.high = (np.where(empty, end, np.clip(x, edge.min, edge.max).astype(kind)) for x, end in ((judge.low, edge.max), (judge.high, edge.min)))
        judge.floor = judge.low.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))] * wide
        for start in range(0, len(all_v), ROWS):
            cut = slice(start, start + ROWS)
            alive = (label[:, None] == columns[3][cut]) == same
            alive &= uid[:, None] != columns[2][cut]
            i, j, score = sliced(a, all_v[cut], alive, judge, kind)
            for w in range(wide):
                fits = (score >= judge.floor[i, w]) & (score <= judge.high[i, w])
                ci, cj, cs = (np.r_[x, y[fits]] for x, y in zip(best[w], (i, j + start, score), strict=True))
                keep = _leading(ci, cs, ident[cj], k)
                best[w] = ci[keep], cj[keep], cs[keep]
                judge.raise_to(w, best[w][0], best[w][2])
        for w, (i, j, score) in enumerate(best):
            for name, values in (("at", i + low), ("window", np.full(len(i), w)), ("row", j), ("score", score.astype(np.int64))):
                found[name].append(values)
    return found


def _met(anchors: DataFrame, vectors: DataFrame, blocks: int, cells: int, same: bool, k: int, carry: list[str], fields: str) -> DataFrame:
    """Rows of :func:`search` over all cells of the grid: uid (the anchor's), anchor_id, window, what ``carry`` lists of it, row_uid, vec_id and score."""
    spread = anchors.select(*(F.col(c).alias(c) for c in anchors.columns)).withColumn("block", F.expr(f"pmod(xxhash64(uid), {blocks})")).withColumn("cell", F.explode(F.expr(f"sequence(0L, {cells - 1}L)")))
    dealt = vectors.withColumn("cell", F.expr(f"pmod(xxhash64(uid), {cells})")).withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search(left, right, same, k)
        at, window, row, score = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found.values())
        out = {"uid": left["uid"].take(at), "anchor_id": left["vec_id"].take(at), "window": pa.array(window, pa.int32()), "row_uid": right["uid"].take(row), "vec_id": right["vec_id"].take(row), "score": pa.array(score, pa.int64())}
        for c in carry:
            lists = left[c].to_pylist()
            out[c] = pa.array([lists[a][w] for a, w in zip(at, window, strict=True)], pa.int64())
        return pa.table([out[n] for n in names], names=names)

    return spread.groupBy("block", "cell").cogroup(dealt.groupBy("block", "cell")).applyInArrow(run, fields)


def hard_negatives(vectors: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; other columns are not looked at. A row's score is its inner product with the
    anchor, of components floor(``scale`` * x); higher scores come first, ties by smaller vec_id. ``anchor`` says in SQL, by vec_id and label,
    which rows are anchors. An anchor's positives are the first other rows of its label, and for each of these its negatives the first rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score; there may be fewer, or none, and then no row.

    Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part. Repeated rows, and rows that
    share a vec_id, are rows of their own: each may be an anchor, and a partner of the others. Missing components of shorter vectors are zeros.
    Integer components beyond 2**22 count as that; vectors have at most 4,096. An empty table gives no rows.

    Work and shuffle grow with anchors times vectors: every vector meets every block of anchors. No table is broadcast, and nothing but two counts comes to the driver.
    """
    spark = vectors.sparkSession
    whole = "embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding").filter(whole)
    v = F.expr(f"transform(embedding, x -> cast(greatest(-{float(LARGEST)}D, least({float(LARGEST)}D, floor({scale}D * cast(x AS double)))) AS int))")
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", v.alias("v")), "vectors")
    queries = rows.filter(f"coalesce({anchor}, false)").select(*(F.expr(c).alias(c) for c in rows.columns))
    blocks = max(1, -(-queries.count() // block))
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // cell))
    first = queries.withColumns({"low": F.expr(f"array({-(1 << 62)}L)"), "high": F.expr(f"array({1 << 62}L)")})
    near = _met(first, rows, blocks, cells, True, positives, [], "uid bigint, row_uid bigint, vec_id bigint, score bigint")
    near = near.withColumn("place", F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "row_uid"))).filter(F.col("place") <= positives)
    near = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("p"))
    near = near.select("uid", F.expr("p.positive_id").alias("positive_id"), F.expr("p.positive_score").alias("positive_score"))
    near = near.withColumn("low", F.expr(f"transform(positive_score, s -> ({low} * s + pmod(-{low} * s, 100L)) DIV 100)")).withColumn("high", F.expr(f"transform(positive_score, s -> ({high} * s - pmod({high} * s, 100L)) DIV 100)"))
    far = _met(queries.join(near, "uid"), rows, blocks, cells, False, negatives, ["positive_id", "positive_score"], "uid bigint, anchor_id bigint, window int, positive_id bigint, positive_score bigint, row_uid bigint, vec_id bigint, score bigint")
    far = far.withColumn("rank", F.row_number().over(W.partitionBy("uid", "window").orderBy(F.desc("score"), "vec_id", "row_uid"))).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, the label is the next of ten."""
    return vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))


def query(spark, sf_dir) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return hard_negatives(relabelled(pick(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid AS a, a.vec_id AS anchor_id, b.uid AS b, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint AS score
  FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b)::int AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b) <= 10
"""
