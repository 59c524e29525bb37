"""Line dedup with two Bloom filters, for lines seen once and lines seen twice.

1. Each task hashes the line keys of its documents and sends a hash at most twice per batch
   (a hot line costs two small rows a batch, not one row a document).
2. The filters are cut into segments by the hash's top bits. A task owns whole segments and
   marks each hash as once-seen or twice-seen, in bits. The twice-seen filter has a fixed size
   (``bits_log2``, 16 MB at 27), whatever the input: a fuller filter lets more lines through
   to the next step, which is exact.
3. Only lines in the twice-seen filter, the suspected repeats, shuffle: as 16-byte digests,
   to be counted exactly and to choose the one document that keeps the line.
4. The lines to drop come back to their documents in one join on ``doc_id``, by a hash table of the
   digests of a partition, so the texts are not sorted. Texts are cut some ``PART`` bytes at a time.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PART, SPACE, flat_map, give_back, materialize, pick, split, table, utf8


#: Code points of the shortest line that can go.
MIN_CHARS = 40


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: both ends stripped of white space, A-Z lower-cased."""
    return [line.strip(SPACE).lower() for line in text.split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has at least so many code points."""
    n = len(key)
    return n >= least and (n >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _digests(text: bytes, least: int) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for k in set(line_keys(text)) if long_enough(k, least)}


def _hashes(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8")[::2] if digests else np.empty(0, np.uint64)


def _bits(h: np.ndarray, seg_log2: int, bits_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of a hash within its segment, from disjoint bits of the hash."""
    inside = np.uint64((1 << (bits_log2 - seg_log2)) - 1)
    return (h & inside).astype(np.int64), ((h >> np.uint64(26)) & inside).astype(np.int64)


def _mask(p: np.ndarray) -> np.ndarray:
    """The bit of a position within its byte, the highest first."""
    return np.uint8(128) >> (p & 7).astype(np.uint8)


def _held(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bits[p >> 3] & _mask(p)) != 0


def twice_seen_filter(docs: DataFrame, min_chars: int, bits_log2: int, seg_log2: int) -> np.ndarray:
    """The twice-seen Bloom filter of all line keys: one row of packed bits for each segment."""
    width = 1 << (bits_log2 - seg_log2)

    def hashes():
        def of(batch):
            found = [d for t in utf8(batch.column(0)) for d in _digests(t, min_chars)]
            h, n = np.unique(_hashes(found), return_counts=True)
            return [pa.array((h >> np.uint64(64 - seg_log2)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))]

        return of

    def segments():
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}

        def of(batch):
            if batch is None:
                return [list(twice), [x.tobytes() for x in twice.values()]]
            seg, h, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for s in np.unique(seg):
                o, t = once.setdefault(int(s), np.zeros(width // 8, np.uint8)), twice.setdefault(int(s), np.zeros(width // 8, np.uint8))
                u, back = np.unique(h[seg == s].view(np.uint64), return_inverse=True)
                p, q = _bits(u, seg_log2, bits_log2)
                again = (np.bincount(back, weights=n[seg == s]) >= 2) | (_held(o, p) & _held(o, q))
                for at in (p, q):
                    np.bitwise_or.at(t, at[again] >> 3, _mask(at[again]))
                    np.bitwise_or.at(o, at >> 3, _mask(at))
            return [[], []]

        return of

    seen = flat_map(pick(docs, "text"), hashes, {"seg": "int", "h": "bigint", "n": "int"}, most=("text", PART))
    rows = flat_map(seen.repartition("seg"), segments, {"seg": "int", "bits": "binary"}, last=True).collect()
    out = np.zeros((1 << seg_log2, width // 8), np.uint8)
    for r in rows:
        out[r.seg] = np.frombuffer(r.bits, np.uint8)
    return out


def suspected(docs: DataFrame, min_chars: int, bits_log2: int, seg_log2: int) -> DataFrame:
    """(doc_id, key): each document's distinct keys that the twice-seen filter holds."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen_filter(docs, min_chars, bits_log2, seg_log2))

    def probe():
        bits = shared.value

        def of(batch):
            ids, rows, keys = batch.column(0), [], []
            for i, t in enumerate(utf8(batch.column(1))):
                for d in _digests(t, min_chars):
                    rows.append(i)
                    keys.append(d)
            h = _hashes(keys)
            seg = (h >> np.uint64(64 - seg_log2)).astype(np.int64)
            hit = np.ones(len(h), bool)
            for p in _bits(h, seg_log2, bits_log2):
                hit &= (bits[seg, p >> 3] & _mask(p)) != 0
            take = np.flatnonzero(hit)
            return [ids.take(pa.array(np.array(rows, np.int64)[take])), pa.array([keys[i] for i in take], pa.binary())]

        return of

    return flat_map(pick(docs, "doc_id", "text"), probe, {"doc_id": dict(docs.dtypes)["doc_id"], "key": "binary"}, most=("text", PART))


def lines_to_drop(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 5, bits_log2: int = 27, seg_log2: int = 8) -> DataFrame:
    """(vellum_drop_id, vellum_drop_keys): the keys that each document loses."""
    some = materialize(suspected(docs, min_chars, bits_log2, seg_log2), "suspects")
    kept = some.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).filter(F.col("n") >= min_docs).drop("n")
    kept = materialize(kept, "kept")  # written, so that Spark may split a hot line's rows in the join
    return some.join(kept, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy(F.col("doc_id").alias("vellum_drop_id")).agg(F.collect_set("key").alias("vellum_drop_keys"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 5, bits_log2: int = 27, seg_log2: int = 8) -> DataFrame:
    """``docs`` with ``vellum_text`` (what is left), ``vellum_lines`` and ``vellum_dropped`` (lines before, lines dropped).

    A line goes if its key has ``min_chars`` code points or more and ``min_docs`` documents or
    more hold it, except in the largest ``doc_id`` among those. Each row is a document, repeated
    rows included; rows that share a ``doc_id`` share its fate. A null text is one empty line. A
    null ``doc_id`` ranks below all others. An empty table gives an empty table. A long text is split in
    one task, in a few times its size.
    """
    schema = docs.select("*", F.lit("").alias("vellum_text"), F.lit(0).cast("bigint").alias("vellum_lines"), F.lit(0).cast("bigint").alias("vellum_dropped")).schema

    def columns(batch, text, n, dropped):
        return [*batch.columns, text, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]

    return _cut(docs, lines_to_drop(docs, min_chars, min_docs, bits_log2, seg_log2), min_chars, schema, columns)


def _cut(docs: DataFrame, drops: DataFrame, min_chars: int, schema: T.StructType, columns) -> DataFrame:
    """What ``columns`` makes of some rows of ``docs``, what is left of their texts, and their lines before and dropped."""
    wide = docs.join(drops.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(drops["vellum_drop_id"]), "left").drop("vellum_drop_id")
    at, gone, names = docs.columns.index("text"), len(docs.columns), schema.names

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, n, dropped = [], [], []
        for t, gone_keys in zip(utf8(batch.column(at)), batch.column(gone).to_pylist(), strict=True):
            lines = t.split(b"\n")
            n.append(len(lines))
            if gone_keys:
                drop = set(gone_keys)
                lines = [x for x, k in zip(lines, line_keys(t), strict=True) if len(k) < min_chars or xxhash.xxh3_128_digest(k) not in drop]
            dropped.append(n[-1] - len(lines))
            text.append(b"\n".join(lines) if dropped[-1] else t)
        rows = pa.RecordBatch.from_arrays(batch.columns[:gone], names=batch.schema.names[:gone])
        return pa.RecordBatch.from_arrays(columns(rows, pa.array(text, pa.binary()).cast(pa.string()), n, dropped), names=names)

    def run(batches):
        for batch in batches:
            for part in split(batch, at, PART):
                yield cut(part)
        give_back()

    return wide.mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", F.col("vellum_lines").alias("n_lines"), F.col("vellum_dropped").alias("n_dropped"), F.sha2(F.col("vellum_text"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the repeated lines taken out of its text."""
    at = docs.columns.index("text")

    def columns(batch, text, n, dropped):
        return [*batch.columns[:at], text, *batch.columns[at + 1 :]]

    out = _cut(docs, lines_to_drop(docs), MIN_CHARS, docs.schema, columns)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


_WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT row) >= 5
), m AS (
  SELECT k.*, g.key IS NOT NULL AND g.keep IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN g ON g.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY row, doc_id
"""
