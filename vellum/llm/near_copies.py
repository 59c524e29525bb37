"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and their classes.

SimHash comes first: each text's fingerprint, the majority bits of its shingles' hashes, goes through the trie
self-join, and the pairs within its budget of bits are verified on the shingles and make classes. Such texts may differ in more
bits than any trie can search, so the pairs that are not in one class yet are then found by their shingles.

No pair is missed: in any one order of all shingles, two sets of similarity t share one of their first
n - ceil(t n) + 1 shingles (n is the size of each set). The order is by hash, with shingles of many texts
last; only those first shingles are shuffled. Pairs that meet there are left out if their sizes or their parity
bitmaps rule the similarity out (two sets differ in at least as many shingles as their bitmaps in bits); the rest are
compared on the shingles themselves. Where more than ``SMALL`` texts share a shingle, each is first compared
with a few leaders only, and then just the pairs that are not in one class yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, arrow_batches, flat_map, give_back, materialize, pick, utf8

SIZE, SEED, SMALL, LEADERS, PAIRS, BITS = 5, 42, 32, 2, 1 << 18, 2048
#: Shingles in at least ``OFTEN`` texts of one in ``SAMPLE`` come last in the order, the ``LAST`` most frequent at most. That changes the work, not the pairs.
SAMPLE, OFTEN, LAST = 16, 3, 200_000


def shingles(text: bytes, size: int = SIZE) -> set[bytes]:
    """Texts are lower-cased in A-Z and cut at white space; fewer words than a shingle (none too) are one shingle."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= size:
        return {line}
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return {line[a:b] for a, b in zip(starts, ends[size - 1 :], strict=True)}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is 0.8 or more."""
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def _hashes(text: bytes) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(s, SEED) for s in shingles(text)], np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, sorted, of shingles that stand in many texts of a sample, and the magnitude of their number."""

    def make():
        return lambda batch: [_lists([_hashes(t) for t in batch])]

    some = append(texts.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0), make, {"h": "array<bigint>"}).select(F.explode("h").alias("h"))
    rows = some.groupBy("h").count().filter(F.col("count") >= OFTEN).orderBy(F.col("count").desc(), "h").limit(LAST).collect()
    rows.sort(key=lambda r: r.h)
    return np.array([r["h"] for r in rows], np.int64), np.array([r["count"].bit_length() for r in rows], np.int8)


def _prefixes(texts: DataFrame) -> DataFrame:
    """key, n, prefix, bits, fp of each distinct text; ``fp`` is its fingerprint as a signed long."""
    last, much = _frequent(texts)

    def make():
        def of(batch):
            sizes, out, bits, fps = [], [], [], []
            for t in batch:
                u = _hashes(t)
                fps.append(majority(u.view(np.uint64)))
                bits.append(np.packbits((np.bincount(u & (BITS - 1), minlength=BITS) & 1).astype(np.uint8)).tobytes())
                if len(last):
                    at = np.minimum(np.searchsorted(last, u), len(last) - 1)
                    often = last[at] == u
                    u = np.concatenate((u[~often], u[often][np.argsort(much[at[often]], kind="stable")]))
                sizes.append(len(u))
                out.append(u[: len(u) - (4 * len(u) + 4) // 5 + 1])
            return [sizes, _lists(out), bits, pa.array(np.array(fps, np.uint64).view(np.int64))]

        return of

    return append(texts, make, {"n": "int", "prefix": "array<bigint>", "bits": "binary", "fp": "bigint"}).drop("text").dropDuplicates(["key"])


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _meet(prefixes: DataFrame, small: int) -> DataFrame:
    """Texts that share a shingle: a, b of pairs, or h, a, n (``b`` is n) where more than ``small`` do."""
    rows = prefixes.select("k", "n", F.explode("prefix").alias("h")).repartition("h").sortWithinPartitions("h")

    def make():
        held = [np.empty(0, np.int64)] * 3

        def of(batch):
            nonlocal held
            if batch is not None:
                new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            k, n, h = held
            cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
            done = len(h) if batch is None else int(cuts[-1]) if len(cuts) else 0
            held = [x[done:] for x in held]
            starts = cuts[cuts < done]
            sizes = np.diff(np.append(starts, done))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
                i, j = np.triu_indices(s, 1)
                at = starts[sizes == s][:, None]
                x, y = (at + i).ravel(), (at + j).ravel()
                fit = _fits(n[x], n[y])
                a.append(k[x[fit]])
                b.append(k[y[fit]])
            pairs = sum(map(len, a))
            many = np.repeat(sizes > small, sizes)
            a.append(k[:done][many])
            b.append(n[:done][many])
            hs = np.concatenate((np.zeros(pairs, np.int64), h[:done][many]))
            return [pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(hs), pa.array(np.arange(len(hs)) >= pairs)]

        return of

    return flat_map(rows, make, {"a": "bigint", "b": "bigint", "h": "bigint", "many": "boolean"}, last=True)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _words(bits: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _close(pairs: DataFrame) -> DataFrame:
    """a, b: the pairs (a, b, n, m, x, y) whose sizes n, m and bitmaps x, y allow the similarity."""

    def make():
        def of(batch):
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            near = _fits(n, m) & (9 * _differ(_words(batch.column(4)), _words(batch.column(5))) <= n + m)
            return [batch.column(i).filter(pa.array(near)) for i in range(2)]

        return of

    return flat_map(pairs.select("a", "b", "n", "m", "x", "y"), make, {"a": "bigint", "b": "bigint"})


def _across(groups: DataFrame) -> DataFrame:
    """a, b: the pairs of (h, a, n, x, root) rows of one h whose roots differ and whose sizes and bitmaps allow the similarity."""
    rows = groups.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "a", "root", "x"))).alias("of"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select(F.col("of.n").alias("n"), F.col("of.a").alias("a"), F.col("of.root").alias("root"), F.col("of.x").alias("x"))
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                n, k, root = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(3))
                n, x = n.astype(np.int64), _words(batch.column(3)[r].values)
                a, b, size = [], [], 0
                for i in range(len(k) - 1):
                    other = np.arange(i + 1, np.searchsorted(n, n[i] * 5 // 4, "right"))
                    other = other[root[other] != root[i]]
                    other = other[9 * _differ(x[other], x[i]) <= n[other] + n[i]]
                    if len(other):
                        a.append(np.full(len(other), k[i]))
                        b.append(k[other])
                        size += len(other)
                    if size >= PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=names)
                        a, b, size = [], [], 0
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=names)
        give_back()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b (keys): the pairs of short keys whose texts are similar."""
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    held = texts.withColumn("k", F.xxhash64("key")).join(ends, "k", "left_semi").dropDuplicates(["key"])
    left = held.select(F.col("k").alias("a"), F.col("key").alias("ka"), F.col("text").alias("ta"))
    right = held.select(F.col("k").alias("b"), F.col("key").alias("kb"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("ka", "kb", "ta", "tb")

    def make():
        def of(batch):
            near, last, left = [], None, None
            for t, u in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if t != last:
                    last, left = t, shingles(t)
                near.append(similar(left, shingles(u)))
            keep = pa.array(near, pa.bool_())
            return [batch.column(i).filter(keep) for i in range(2)]

        return of

    with arrow_batches(texts.sparkSession, 500):
        return materialize(flat_map(both, make, {"a": "binary", "b": "binary"}), "similar")


def _by_fingerprint(texts: DataFrame, prefixes: DataFrame, links) -> DataFrame:
    """a, b (keys): similar texts among those of one fingerprint and those whose fingerprints ``links`` joins."""
    low = materialize(prefixes.groupBy("fp").agg(F.min("k").alias("low")), "fingerprints")
    same = prefixes.join(low, "fp").select(F.col("k").alias("a"), F.col("low").alias("b"))
    ends = links(low.select("fp")).withColumnsRenamed({"a": "fa", "b": "fb"})
    near = ends.join(low.select(F.col("fp").alias("fa"), F.col("low").alias("a")), "fa").join(low.select(F.col("fp").alias("fb"), F.col("low").alias("b")), "fb").select("a", "b")
    return _verified(texts, materialize(_ordered(same.unionByName(near)), "near"))


def near_copies(docs: DataFrame, components, small: int = SMALL, links=None) -> DataFrame:
    """key, root: the class of each text that is similar to another one; ``key`` is that of ``keyed``.

    ``components`` turns links (a, b) into (v, root). ``links`` is the trie self-join of distinct fingerprints (fp), which
    gives pairs (a, b) of them; without it all pairs are found by their shingles. The classes are the same.
    """
    texts = keyed(docs).select("key", "text")
    prefixes = materialize(_prefixes(texts).withColumn("k", F.xxhash64("key")), "prefixes")
    met = materialize(_meet(prefixes, small), "meet")
    sketches = prefixes.select(F.col("k").alias("a"), "n", F.col("bits").alias("x"), F.col("k").alias("root")).dropDuplicates(["a"])
    near = None
    if links is not None:
        near = _by_fingerprint(texts, prefixes, links)
        sketches = sketches.drop("root").join(_roots(components(near)), "a", "left").withColumn("root", F.coalesce("root", "a"))
    sketches = materialize(sketches, "sketches")
    others = sketches.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("x").alias("y"), F.col("root").alias("other"))
    tested = _close(_ordered(met.filter("NOT many").select("a", "b")).join(sketches, "a").join(others, "b").filter("root <> other"))
    many = met.filter("many").select("h", "a").distinct().join(sketches, "a")
    if many.isEmpty():
        return components(_with(near, _verified(texts, materialize(tested, "pairs")))).select(F.col("v").alias("key"), "root")
    many = materialize(many, "many")
    for i in range(LEADERS):
        leader = many.groupBy("h").agg(F.min_by(F.struct(F.col("a").alias("b"), F.col("n").alias("m"), F.col("x").alias("y"), F.col("root").alias("other")), F.xxhash64("a", F.lit(i))).alias("l")).select("h", "l.*")
        tested = tested.unionByName(_close(many.join(leader, "h").filter("root <> other")))
    tested = materialize(_ordered(tested), "pairs")
    near = _with(near, _verified(texts, tested))
    with arrow_batches(texts.sparkSession, 8):
        rest = materialize(_across(many.drop("root").join(_roots(components(near)), "a", "left").select("h", "a", "n", "x", F.coalesce("root", "a").alias("root"))), "across")
    rest = materialize(_ordered(rest).join(tested, ["a", "b"], "left_anti"), "pairs")
    return components(near.unionByName(_verified(texts, rest))).select(F.col("v").alias("key"), "root")


def _with(near: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if near is None else near.unionByName(more)


def _roots(classes: DataFrame) -> DataFrame:
    """a, root: short keys of texts and of their classes."""
    return classes.select(F.xxhash64("v").alias("a"), F.xxhash64("root").alias("root"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key: 16 bytes of digest, the same for copies; null texts are empty."""
    return pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.unhex(F.md5("text")))
