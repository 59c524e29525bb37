"""Removal of repeated 200-byte strings, by a hash-compared suffix sort around sampled anchors.

Sorting a suffix for every byte would shuffle hundreds of times the input. Equal strings choose
equal anchors, so only suffixes at anchors are sorted:

1. In every 200-byte window the 32-byte gram with the least hash is the window's anchor. Windows
   with one anchor are a run; the bytes they span are the anchor's context, known by a 128-bit digest. Prefix
   polynomial hashes give every gram's hash in constant time. A window can only recur where its
   anchor's gram does, and each task sends a gram at most twice with each of its contexts.
2. Grams seen twice or more come back to their anchors. Where all contexts of a gram are
   the same, all its windows are repeated and nothing more is needed.
3. Else one representative of each distinct context goes to its gram's group. There the right and the
   left extensions of the anchors are sorted by mergesort; two suffixes are compared by binary
   search for their common extension over prefix hashes. Neighbours' extensions, verified
   on the bytes themselves, put windows into classes; a class of two or more is a repeat.
   Grams with over ``hot`` distinct contexts are not gathered: their windows are counted by 128-bit digest.
4. Repeated windows come back to their texts as ranges, and the bytes they cover go.

Texts are known by 128-bit digests, so repeated rows and ids need no care. Bloom filters of fixed
size keep what can't match out of the joins; when they fill up, joins are larger and still exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PART, append, arrow_batches, flat_map, give_back, materialize, pick, split, table, utf8

WINDOW, GRAM = 200, 32
HOT, FILTER_LOG2 = 4_000, 26
#: Bytes of text hashed at once in a task: the arrays take some 40 MB.
CHUNK = 256_000
#: Rows that go to Python at once while texts are cut at anchors.
BATCH = 1_000
#: Odd base of the polynomial, modulo 2**64. Its hashes only choose anchors and order suffixes, and neighbours are verified on bytes.
BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 32) - 1)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class PrefixHashes:
    """Hashes of any range of some bytes, from prefix sums of one polynomial."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data) + 1
        held = self._powers.get(base)
        if held is None or len(held[0]) < n:
            held = self._powers[base] = _powers(base, max(n, CHUNK + 1))
        power, self.inverse = held
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from running minima of blocks."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Runs of windows by anchor: text number, first and last window, anchor (offsets in the text), gram's hash, and the context's digest in two parts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(lengths) or lengths.max() < window:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 3
    at = np.arange(len(data) - gram + 1)
    grams = PrefixHashes(data).of(at, at + gram)
    least = _sliding_least((grams & ~_POSITION) | at.astype(np.uint64), window - gram + 1)
    chosen = (least & _POSITION).astype(np.int64)
    some = np.flatnonzero(lengths >= window)
    inside = np.zeros(len(chosen) + 1, np.int8)
    inside[starts[some]] = 1
    ends = starts[some] + lengths[some] - window + 1
    np.subtract.at(inside, ends, 1)
    w = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int64) > 0)
    a = chosen[w]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1] + 1)))
    new[1:] |= np.isin(w[1:], starts[some])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(w)])) - 1
    lo, hi, a = w[first], w[last], a[first]
    text = np.searchsorted(starts, lo, side="right") - 1
    whole, digest = memoryview(data), xxhash.xxh3_128_digest
    context = np.frombuffer(b"".join([digest(whole[x:y], z) for x, y, z in zip(lo.tolist(), (hi + window).tolist(), (a - lo).tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return [text, lo - starts[text], hi - starts[text], a - starts[text], grams[a], context[:, 0], context[:, 1]]


def _chunks(texts: list[bytes]):
    """Lists of (number, part of a text, its start) of about ``CHUNK`` bytes; parts of a longer text overlap, so that each window is in one."""
    out, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), CHUNK):
            part = t[at : at + CHUNK + WINDOW - 1] if len(t) > CHUNK else t
            if out and size + len(part) > CHUNK:
                yield out
                out, size = [], 0
            out.append((i, part, at))
            size += len(part)
    if out:
        yield out


def key_of(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def make_filter(keys: DataFrame, hashed: str, bits_log2: int = FILTER_LOG2) -> np.ndarray:
    """A Bloom filter of a long column's values: ``2**bits_log2`` bits, whatever their number."""
    mask = (1 << bits_log2) - 1
    places = keys.select(F.explode(F.array(F.expr(f"{hashed} & {mask}L"), F.expr(f"shiftrightunsigned({hashed}, 30) & {mask}L"))).alias("p"))
    rows = places.groupBy(F.expr("shiftright(p, 15)").alias("b")).agg(F.expr("bitmap_construct_agg(p & 32767L)").alias("bits")).collect()
    out = np.zeros((1 << (bits_log2 - 15), 4096), np.uint8)
    for r in rows:
        out[r.b] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 8 - 1)
    out = np.ones(len(h), bool)
    for shift in (0, 30):
        p = (h >> np.uint64(shift)) & mask
        out &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _key_hash(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def repeated_grams(texts: DataFrame) -> DataFrame:
    """gram, mixed: the anchors' grams that occur twice or more, and whether their contexts differ."""

    def make():
        def of(batch):
            triples, counts = [np.empty((0, 3), np.uint64)], [np.empty(0, np.int64)]
            for chunk in _chunks(utf8(batch.column(0))):
                *_, gram, one, two = anchors([t for _, t, _ in chunk])
                if len(gram):
                    distinct, n = np.unique(np.stack([gram, one, two], 1), axis=0, return_counts=True)
                    triples.append(distinct)
                    counts.append(np.minimum(n, 2))
            found = np.concatenate(triples)
            return [*(pa.array(_signed(found[:, i])) for i in range(3)), pa.array(np.concatenate(counts))]

        return of

    seen = flat_map(texts, make, {"gram": "bigint", "context": "bigint", "more": "bigint", "n": "bigint"})
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("context", "more")]
    return seen.groupBy("gram").agg(F.sum("n").alias("n"), *ends).filter("n >= 2").select("gram", F.expr("min_context <> max_context OR min_more <> max_more").alias("mixed"))


def repeated_runs(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """key, gram, context, more, lo, hi, anchor, copies, mixed: the runs of each distinct text whose gram repeats."""
    shared = texts.sparkSession.sparkContext.broadcast(make_filter(grams, "gram"))

    def make():
        bits = shared.value

        def of(batch):
            texts, keys, parts = utf8(batch.column(0)), [], []
            for chunk in _chunks(texts):
                found = anchors([t for _, t, _ in chunk])
                take = may_hold(bits, found[4])
                text, lo, hi, a, gram, one, two = (x[take] for x in found)
                digest = {i: key_of(texts[chunk[i][0]]) for i in np.unique(text)}
                keys += [digest[i] for i in text]
                start = np.array([at for _, _, at in chunk], np.int64)[text]
                parts.append((_signed(gram), _signed(one), _signed(two), lo + start, hi + start, a + start))
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(6)]
            return [pa.array(keys, pa.binary()), *(pa.array(c) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])]

        return of

    fields = {"key": "binary", "gram": "bigint", "context": "bigint", "more": "bigint", "lo": "int", "hi": "int", "anchor": "int"}
    runs = flat_map(texts, make, fields).groupBy(*fields).agg(F.count(F.lit(1)).alias("copies"))
    return runs.join(grams, "gram")


def common_extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes from ``a`` and ``b`` on are alike, at most ``limit``: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), limit.astype(np.int64).copy()
    for _ in range(int(limit.max(initial=0)).bit_length()):
        mid = (low + high + 1) // 2
        same = hashes.of(a, a + mid) == hashes.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sort_suffixes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and each one's common extension with the one before.

    A bottom-up mergesort over all at once: each suffix finds its place in the run beside its own
    by binary search, comparing by common extension. The extensions of neighbours are then
    checked on the bytes; a collision of hashes shows there, and the order is made from the bytes.
    """
    n = len(start)
    hashes = PrefixHashes(data)
    padded = np.concatenate((data, np.zeros(1, np.uint8)))

    def before(x, y, equal):
        """Whether suffix x comes before y; ``equal`` where they are alike."""
        limit = np.minimum(length[x], length[y])
        k = common_extension(hashes, start[x], start[y], limit)
        ended = k == limit
        return np.where(ended, np.where(length[x] == length[y], equal, length[x] < length[y]), padded[start[x] + k] < padded[start[y] + k])

    order, width = np.arange(n), 1
    while width < n:
        at = np.arange(n)
        base = at // (2 * width) * (2 * width)
        left = at - base < width
        low = np.where(left, np.minimum(base + width, n), base)
        high = np.where(left, np.minimum(base + 2 * width, n), base + width)
        other = low.copy()
        for _ in range(width.bit_length()):
            open_ = low < high
            mid = (low + high) // 2
            probe = np.where(open_, mid, 0)
            less = before(order[probe], order[at], ~left) & open_
            low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
        place = base + (at - base - np.where(left, 0, width)) + (low - other)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, 2 * width
    x, y = order[:-1], order[1:]
    limit = np.minimum(length[x], length[y])
    ext = common_extension(hashes, start[x], start[y], limit)
    true = np.zeros(n - 1, np.int64)
    going = np.ones(n - 1, bool)
    for k in range(int(limit.max(initial=0))):
        going &= (k < limit) & (padded[np.minimum(start[x] + k, len(data))] == padded[np.minimum(start[y] + k, len(data))])
        if not going.any():
            break
        true += going
    if (true != ext).any():
        raw = data.tobytes()
        order = np.array(sorted(range(n), key=lambda i: raw[start[i] : start[i] + length[i]]), np.int64)
        x, y = order[:-1], order[1:]
        true = np.array([_alike(raw[start[i] : start[i] + length[i]], raw[start[j] : start[j] + length[j]]) for i, j in zip(x, y, strict=True)], np.int64)
    return order, np.concatenate(([0], true)) if n else np.empty(0, np.int64)


def _alike(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def repeated_windows(contexts: list[bytes], anchor: np.ndarray, many: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each distinct context (anchor at an offset, ``many`` where it occurs more than once) the window offsets that repeat."""
    n = len(contexts)
    size = np.array([len(c) for c in contexts], np.int64)
    offset = np.concatenate(([0], np.cumsum(size)))[:-1]
    data = np.frombuffer(b"".join(contexts), np.uint8)
    right, right_ext = sort_suffixes(data, offset + anchor, size - anchor)
    back = np.ascontiguousarray(data[::-1])
    left, left_ext = sort_suffixes(back, len(data) - offset - anchor, anchor)
    found: list[list[int]] = [[] for _ in range(n)]
    label = np.empty((2, n), np.int64)
    for l in range(int(anchor.max(initial=-1)) + 1):
        held = np.flatnonzero((anchor >= l) & (anchor - l + window <= size))
        if len(held) == 0:
            continue
        label[0, right] = np.cumsum(right_ext < window - l)
        label[1, left] = np.cumsum(left_ext < l)
        pair = label[0, held] * (n + 1) + label[1, held]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        for i in held[(count[inverse] >= 2) | many[held]]:
            found[i].append(anchor[i] - l)
    return [np.array(f[::-1], np.int64) for f in found]


def _ranges(offsets: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(offsets) != 1)
    return offsets[np.concatenate(([0], cut + 1))].tolist() if len(offsets) else [], offsets[np.concatenate((cut, [len(offsets) - 1]))].tolist() if len(offsets) else []


def _contexts(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """gram, context, more, many, body, at: the bytes of one representative of each distinct context, and the anchor's place in them."""
    one = runs.groupBy("gram", "context", "more").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "lo", "hi", "anchor")).alias("r"))
    wanted = one.groupBy(F.col("r.key").alias("key")).agg(F.collect_list(F.struct("gram", "context", "more", (F.col("n") > 1).alias("many"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), F.col("r.anchor").alias("anchor"))).alias("wanted"))
    held = with_keys(texts, runs).filter("vellum_some").select(F.col("vellum_key").alias("key"), "text").dropDuplicates(["key"])

    def make():
        def of(batch):
            out = [[] for _ in range(6)]
            for text, wanted in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for r in wanted:
                    for o, x in zip(out, (r["gram"], r["context"], r["more"], r["many"], text[r["lo"] : r["hi"] + WINDOW], r["anchor"] - r["lo"]), strict=True):
                        o.append(x)
            return out

        return of

    return flat_map(held.join(wanted, "key").select("key", "text", "wanted"), make, {"gram": "bigint", "context": "bigint", "more": "bigint", "many": "boolean", "body": "binary", "at": "int"})


def with_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` with ``vellum_key`` and ``vellum_some``: whether ``keys`` may hold that key (a Bloom filter says so)."""
    hashed = keys.select(F.expr("cast(conv(hex(substring(key, 1, 8)), 16, -10) as bigint)").alias("k"))
    shared = texts.sparkSession.sparkContext.broadcast(make_filter(hashed, "k"))

    def make():
        bits = shared.value

        def of(batch_texts):
            keys = [key_of(t) for t in batch_texts]
            return [pa.array(keys, pa.binary()), pa.array(may_hold(bits, np.array([_key_hash(k) for k in keys], np.int64).view(np.uint64)))]

        return of

    return append(texts, make, {"vellum_key": "binary", "vellum_some": "boolean"})


def _classed(contexts: DataFrame, hot: int) -> DataFrame:
    """gram, context, more, starts, ends: ranges of repeated window offsets in each distinct context."""
    large = materialize(contexts.groupBy("gram").count().filter(F.col("count") > hot).select("gram", F.lit(True).alias("large")), "large")
    contexts = contexts.join(large, "gram", "left")

    def gather():
        held: list[pa.RecordBatch] = []

        def of(batch):
            if batch is not None:
                held.append(batch)
                return [[], [], [], [], []]
            if not held or not sum(b.num_rows for b in held):
                return [[], [], [], [], []]
            t = pa.Table.from_batches(held).sort_by("gram")
            gram = t["gram"].to_numpy()
            first = np.concatenate(([0], np.flatnonzero(np.diff(gram)) + 1, [len(gram)]))
            starts, ends, at = [], [], 0
            while at < len(gram):
                # Whole grams of about ``hot`` contexts together: what is sorted at once stays small.
                to = int(first[max(np.searchsorted(first, at + hot, side="right") - 1, np.searchsorted(first, at, side="right"))])
                part = t.slice(at, to - at)
                for f in repeated_windows(part["body"].to_pylist(), part["at"].to_numpy().astype(np.int64), part["many"].to_numpy()):
                    s, e = _ranges(f)
                    starts.append(s)
                    ends.append(e)
                at = to
            return [*(t[n].combine_chunks() for n in ("gram", "context", "more")), starts, ends]

        return of

    fields = {"gram": "bigint", "context": "bigint", "more": "bigint", "starts": "array<int>", "ends": "array<int>"}
    plain = flat_map(contexts.filter("large IS NULL").select("gram", "context", "more", "many", "body", "at").repartition("gram"), gather, fields, last=True)

    if large.isEmpty():
        return plain.filter("size(starts) > 0")

    def windows():
        def of(batch):
            row, start, digests = [], [], []
            for i, (body, at) in enumerate(zip(utf8(batch.column(4)), batch.column(5).to_pylist(), strict=True)):
                for first in range(min(at, len(body) - WINDOW) + 1):
                    row.append(i)
                    start.append(first)
                    digests.append(key_of(body[first : first + WINDOW]))
            take = pa.array(row, pa.int64())
            return [*(batch.column(i).take(take) for i in range(4)), start, pa.array(digests, pa.binary())]

        return of

    each = flat_map(contexts.filter("large").select("gram", "context", "more", "many", "body", "at"), windows, {"gram": "bigint", "context": "bigint", "more": "bigint", "many": "boolean", "start": "int", "window": "binary"})
    again = each.groupBy("window").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).filter("n >= 2").drop("n")
    again = materialize(again, "again")  # written, so that Spark may split a hot window's rows in the join
    spread = each.join(again, "window").groupBy("gram", "context", "more").agg(F.collect_list("start").alias("starts")).select("gram", "context", "more", "starts", F.col("starts").alias("ends"))
    return plain.filter("size(starts) > 0").unionByName(spread)


def repeated_ranges(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """key, starts, ends: for each text with repeats, ranges of window starts that recur elsewhere."""
    grams = materialize(repeated_grams(texts), "grams")
    runs = materialize(repeated_runs(texts, grams), "runs")
    mixed = runs.filter("mixed")
    many = runs.filter("NOT mixed").select("key", F.array("lo").alias("starts"), F.array("hi").alias("ends"))
    contexts = materialize(_contexts(texts, mixed), "contexts")
    classed = materialize(_classed(contexts, hot), "windows")
    some = mixed.join(classed, ["gram", "context", "more"]).select("key", F.expr("transform(starts, x -> x + lo)").alias("starts"), F.expr("transform(ends, x -> x + lo)").alias("ends"))
    return many.unionByName(some).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def spans_of(length: int, starts, ends, window: int = WINDOW) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows cover."""
    if starts is None or not len(starts):
        return []
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, np.asarray(starts), 1)
    np.subtract.at(edge, np.asarray(ends) + window, 1)
    covered = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
    change = np.flatnonzero(np.diff(covered))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def dedup_substrings(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with ``vellum_bytes`` (what is left), ``vellum_length``, ``vellum_removed`` and ``vellum_runs``.

    Every byte goes that lies in a 200-byte string which also starts anywhere else, in the same text
    or in another row; repeated rows are occurrences of their own, so repeated texts of 200
    bytes or more go whole. Null and empty texts have no bytes. Shorter texts stay. A long text is
    cut at anchors part by part, in bounded memory beside the text itself.
    """
    texts = docs.select("text")
    with arrow_batches(docs.sparkSession, BATCH):
        ranges = materialize(repeated_ranges(texts, hot), "ranges")
    keyed = with_keys(docs, ranges)
    renamed = ranges.withColumnsRenamed({"key": "vellum_of", "starts": "vellum_starts", "ends": "vellum_ends"})
    touched = keyed.filter("vellum_some")
    touched = touched.join(renamed, touched["vellum_key"] == renamed["vellum_of"], "left").drop("vellum_of", "vellum_key", "vellum_some")
    rest = keyed.filter("NOT vellum_some").drop("vellum_key", "vellum_some").withColumns({"vellum_starts": F.lit(None).cast("array<int>"), "vellum_ends": F.lit(None).cast("array<int>")})
    at, columns = docs.columns.index("text"), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("vellum_bytes", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("vellum_length", "vellum_removed", "vellum_runs"))])

    def of(batch):
        left, length, removed, runs = [], [], [], []
        starts, ends = (batch.column(len(columns) + i) for i in range(2))
        for i, t in enumerate(utf8(batch.column(at))):
            spans = spans_of(len(t), starts[i].values.to_numpy(), ends[i].values.to_numpy()) if starts[i].is_valid else []
            kept, here = [], 0
            for a, b in spans:
                kept.append(t[here:a])
                here = b
            left.append(b"".join([*kept, t[here:]]))
            length.append(len(t))
            removed.append(len(t) - len(left[-1]))
            runs.append(len(spans))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(left, pa.binary()), *(pa.array(x, pa.int64()) for x in (length, removed, runs))], names=schema.names)

    def run(batches):
        for batch in batches:
            for part in split(batch, at, PART):
                yield of(part)
        give_back()

    return touched.select(*columns, "vellum_starts", "vellum_ends").unionByName(rest.select(*columns, "vellum_starts", "vellum_ends")).mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = dedup_substrings(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", F.col("vellum_length").alias("n_bytes"), F.col("vellum_removed").alias("n_removed"), F.col("vellum_runs").alias("n_spans"), F.sha2("vellum_bytes", 256).alias("kept_sha256"))
