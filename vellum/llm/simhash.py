"""SimHash near-dedup: a binary-trie self-join over distinct fingerprints, then components.

Fingerprints that differ in at most ``budget`` bits agree on at least one of ``budget + 1``
blocks, so each distinct fingerprint goes to one group for each block, with that block rotated
to the top. Inside a group the trie below the shared block is walked in pairs of nodes: a pair
adds up the bits in which its two paths differ and is pruned once they exceed the budget.
Groups of more than ``hot`` fingerprints are split by blocks of the remaining bits, by the same
argument. A group sends back a spanning star of each cluster, never all its pairs.
Copies share a fingerprint and are joined by it alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, flat_map, materialize, pick, table
from .near_copies import keyed, majority, near_copies

SHINGLE, SEED, BUDGET, HOT = 3, 42, 2, 200_000
#: Bits in which the fingerprints of near copies (five-word shingles) may differ in the trie join of the pipeline's stage.
NEAR = 3


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The majority bits of the shingles' XXH64; zero where there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[: len(words) - size])]
        shingles = [line[a:b] for a, b in zip(starts, ends[size - 1 :], strict=True)]
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(s, SEED) for s in shingles], np.uint64))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with ``vellum_fp``, the fingerprint as a signed long."""

    def make():
        def of(texts):
            return [pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))]

        return of

    return append(docs, make, {"vellum_fp": "bigint"})


def _rotate(value, width: int, by: int):
    """Rotate the low ``width`` bits of a long column left, clearing those above."""
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("bigint")
    low = value.bitwiseAND(mask)
    if by == 0:
        return low
    return F.shiftleft(low, by).bitwiseAND(mask).bitwiseOR(F.shiftrightunsigned(low, width - by))


def _offsets(width: int, parts: int) -> list[tuple[int, int]]:
    """(offset from the top, width) of each block."""
    sizes = [width // parts + (i < width % parts) for i in range(parts)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def trie_pairs(values: np.ndarray, roots: list[tuple[int, int]], depth: int, budget: int, chunk: int = 1 << 20):
    """Index pairs of sorted distinct ``values`` that differ in at most ``budget`` bits, for values below the same root.

    A node is a range of the sorted values; each root is one at the given depth.
    Frontiers over ``chunk`` node pairs are cut in two, which bounds memory.
    """
    lo = np.array([r[0] for r in roots], np.int64)
    hi = np.array([r[1] for r in roots], np.int64)
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        one = (ah - al == 1) & (bh - bl == 1)
        if one.any():
            x, y = al[one], bl[one]
            near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
            yield x[near], y[near]
            al, ah, bl, bh, err = al[~one], ah[~one], bl[~one], bh[~one], err[~one]
        if not len(al):
            continue
        if len(al) > chunk:
            m = len(al) // 2
            stack += [(d, al[s], ah[s], bl[s], bh[s], err[s]) for s in (slice(0, m), slice(m, None))]
            continue
        bit = np.uint64(63 - d)

        def middle(l):
            return np.searchsorted(values, ((values[l] >> bit) | np.uint64(1)) << bit)

        am = np.clip(middle(al), al, ah)
        bm = np.clip(middle(bl), bl, bh)
        same = al == bl
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        other = ~same
        parts.append((am[other], ah[other], bl[other], bm[other], err[other] + 1))
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        go = (ah > al) & (bh > bl) & (err <= budget) & ~((al == bl) & (ah - al == 1))
        stack.append((d + 1, al[go], ah[go], bl[go], bh[go], err[go]))


def _stars(values: np.ndarray, fps: np.ndarray, top: int, budget: int, near: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, smallest member) of the clusters among fingerprints in one order of bits; with ``near`` spanning trees of pairs within the budget."""
    order = np.argsort(values, kind="stable")
    values, fps = values[order], fps[order]
    block = values >> np.uint64(64 - top)
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
    roots = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]
    label, trees = np.arange(len(values)), []

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for x, y in trie_pairs(values, roots, top, budget):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                label[max(a, b)] = min(a, b)
                trees.append((i, j))
    if near:
        x, y = np.array(trees, np.int64).reshape(-1, 2).T
        return fps[x], fps[y]
    final = np.array([root(i) for i in range(len(label))], np.int64)
    moved = final != np.arange(len(label))
    return fps[moved], fps[final[moved]]


def links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT, near: bool = False) -> DataFrame:
    """(a, b): links that span the same components as all pairs of distinct ``fp`` within ``budget`` bits; with ``near`` each link is such a pair."""
    blocks = _offsets(64, budget + 1)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("way"), F.lit(w).alias("top"), _rotate(F.col("fp"), 64, o).alias("value")) for i, (o, w) in enumerate(blocks)))).alias("k")).select("fp", "k.*")
    keyed = keyed.withColumn("block", F.expr("shiftrightunsigned(value, 64 - top)"))
    large = keyed.groupBy("way", "block").count().filter(F.col("count") > hot).select("way", "block", F.lit(True).alias("large"))
    keyed = keyed.join(large, ["way", "block"], "left")
    # The blocks of each way's remaining bits come from one literal, not from a branch of the plan for each of them.
    entry = lambda way, top, rest, by: F.struct(way.alias("way"), top.alias("top"), rest.alias("rest"), by.alias("by"))
    cuts = F.array(*(F.array(*(entry(*map(F.lit, ((i + 1) * 100 + j, w + sw, 64 - w, o))) for j, (o, sw) in enumerate(_offsets(64 - w, budget + 1)))) for i, (_, w) in enumerate(blocks)))
    whole = F.array(entry(F.col("way"), F.col("top"), 64 - F.col("top"), F.lit(0)))
    plain = keyed.withColumn("c", F.explode(F.when(F.col("large"), cuts[F.col("way")]).otherwise(whole))).select("fp", "value", "block", "c.*")
    plain = plain.withColumn("low", F.expr("value & (shiftleft(1L, rest) - 1)"))
    plain = plain.withColumn("value", F.expr("shiftleft(block, rest) | shiftleft(low, by) & (shiftleft(1L, rest) - 1) | shiftrightunsigned(low, rest - by)"))
    plain = plain.select("fp", "way", "top", "value", F.expr("shiftrightunsigned(value, 64 - top)").alias("block"))

    def make():
        held: list[pa.RecordBatch] = []

        def of(batch):
            if batch is not None:
                held.append(batch)
                return [[], []]
            if not held:
                return [[], []]
            t = pa.Table.from_batches(held)
            fp, way, top, value = (t.column(i).to_numpy() for i in range(4))
            out = [_stars(value[way == k].view(np.uint64), fp[way == k], int(top[way == k][0]), budget, near) for k in np.unique(way)]
            return [pa.array(np.concatenate([o[i] for o in out])) for i in range(2)]

        return of

    return flat_map(plain.repartition("way", "block").drop("block"), make, {"a": "bigint", "b": "bigint"}, last=True).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of each connected component, for all vertices of (a, b).

    Alternates large-star and small-star steps, which halve distances, until nothing moves.
    Every step is a grouped minimum and a join; its result is written, so lineage stays short.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, budget: int = BUDGET, size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, vellum_fp, vellum_class of each document: the class is the smallest ``doc_id`` that links reach.

    Texts are lower-cased in A-Z and cut at white space; a text of fewer words than a shingle is
    one shingle, and one without words (null too) has fingerprint zero, which links like any
    other. A null ``doc_id`` gets a class and is never its smallest unless all are null. Repeated rows
    are documents of their own, of one class. A text is fingerprinted whole, whatever its length; a task holds
    its words' hashes. Other columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    fp = materialize(fingerprints(pick(docs, "doc_id", "text"), size).drop("text"), "fingerprints")
    distinct = fp.groupBy(F.col("vellum_fp").alias("fp")).agg(F.min("doc_id").alias("low"))
    distinct = materialize(distinct, "distinct")
    roots = components(links(distinct.select("fp"), budget, hot))
    classed = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = classed.groupBy("root").agg(F.min("low").alias("vellum_class"))
    by_fp = classed.join(low, "root").select("fp", "vellum_class")
    return fp.join(by_fp, fp["vellum_fp"] == by_fp["fp"]).select("doc_id", "vellum_fp", "vellum_class")


def query(spark, sf_dir) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("vellum_fp"), 16, "0")).alias("fingerprint"), F.col("vellum_class").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest ``doc_id``.

    A class is what pairs of a five-word Jaccard similarity of 0.8 or more connect. Pairs whose five-word fingerprints
    differ in at most ``NEAR`` bits come from the trie join and are verified on the shingles. Pairs at 0.8 differ in
    about ten bits, where the trie would compare almost all pairs, so ``near_copies`` finds the rest by their shingles.
    Rows without ``doc_id`` stay; of rows that repeat a ``doc_id`` all stay or none does.
    """
    ids = keyed(docs).select("doc_id", "key")
    roots = near_copies(docs, components, links=lambda fps: links(fps, NEAR, near=True))
    classed = materialize(ids.join(roots, "key", "left").select("doc_id", F.coalesce("root", "key").alias("root")), "classes")
    low = classed.groupBy("root").agg(F.min("doc_id").alias("low"))
    dup = classed.join(low, "root").filter("doc_id <> low").select("doc_id").distinct()
    return docs.join(dup, "doc_id", "left_anti").select(*docs.columns)
