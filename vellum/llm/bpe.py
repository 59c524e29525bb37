"""Byte-level BPE: Spark's higher-order functions fold ranked merges over the distinct words of a block of texts.

1. Texts are gathered in blocks of ``block_chars`` characters. The pretokenizer's pattern cuts
   them into words; a block is one row that holds its distinct words as byte arrays, and each text
   as numbers of those words.
2. ``transform`` goes over the words and ``aggregate`` folds each: the adjacent pair with the lowest
   rank, the leftmost of equals, becomes one id, until no pair has a rank. Ranks are a literal in the
   plan. Spark looks a key up in a map by scanning it, so the literal map is laid out as arrays, in
   which the pair's place is computed and the entry's key is compared (see :class:`RankMap`).
3. Decoding concatenates the binary pieces of the ids, again a literal.
4. A text's ids are its words' ids in order.

A block never leaves its task: bringing each word together over all blocks, and its ids back, would
shuffle more than the input. Words that are frequent in one text of ``SAMPLE`` are folded first, once for
all, and at most ``CACHED`` of them are sent to the tasks; a block folds those of its other words that no earlier block of its
task had (:class:`Numbering`, :class:`Task`: blocks stay in order between the two Arrow steps). The sample changes the
work, not the ids. Words over ``LONG`` bytes, whose fold takes time by the square of their
length, are merged with a heap instead; the ids are the same.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_map, give_back, materialize, pick, table

#: Longest word, in bytes, that the fold takes.
LONG = 512
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
#: Frequent words are counted in one text of so many, and at most so many (some 60 bytes each) go to each task.
SAMPLE, CACHED = 4, 400_000
#: A task forgets the words that it has sent to be folded when they are more than so many (some 100 bytes each in its workers).
MEMO = 400_000
#: Vocabularies over so many entries are refused, as the plan holds one. Ids are below 2**20.
MOST_RANKS = 200_000
_NONE = 1 << 20
#: What an empty slot holds: the key 2**20, which no pair has, as ids are below and the factor of a key above it. Short in the plan's text.
_EMPTY = _NONE << 20
#: Stands at both ends of a word in place of a byte.
END = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MOST_RANKS or max(ranks.values(), default=0) >= _NONE - 1:
        raise ValueError(f"{len(ranks)} ranks; at most {MOST_RANKS} go into a plan, and ids stay below {_NONE - 1}")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no rank")
    return ranks


@lru_cache(maxsize=8)
def words_of(pattern: str):
    """The pretokenizer, with white space as Unicode's property (some engines add control characters).

    Texts without characters beyond U+FFFF are cut by Python's ``re``, in half the time, if the pattern can be written for it.
    """
    exact = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    written = _for_re(pattern)
    if written is None:
        return exact
    quick = re.compile(written).findall

    def find(text: str) -> list[str]:
        return quick(text) if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else exact(text)

    return find


def _for_re(pattern: str) -> str | None:
    """The pattern with its properties as ranges up to U+FFFF, as ``regex`` knows them; None if it has more than properties, sets, white space, plain groups and look-ahead."""
    low, out, inside = "".join(map(chr, range(0x10000))), [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|\[\^?|\]|\(\??[^\s]?|.", pattern, re.DOTALL):
        if part.startswith(r"\p") or part in (r"\s", r"\S"):
            if len(part) == 2 and part[1] == "p" or part == r"\S" and inside:
                return None
            runs = regex.finditer(part.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\p{White_Space}") + "+", low)
            ranges = "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in runs)
            part = ranges if inside else f"[^{ranges}]" if part == r"\S" else f"[{ranges}]"
        elif part[0] == "\\" and part not in (r"\r", r"\n", r"\t") or part[0] == "(" and part not in ("(?:", "(?!", "(?=") or part == "[" and inside:
            return None
        elif part in ("[", "[^", "]"):
            inside = part != "]"
        out.append(part)
    return "".join(out)


class RankMap:
    """The ranks of pairs of ids as literal arrays, and the expressions that fold and decode with them.

    ``slots`` holds ``key << 20 | rank`` for each pair (a, b) of ids whose bytes together have a
    rank; ``key`` is a * factor + b. A pair's slot is given by the key's low bits, shifted by a number that its
    group (key % groups) has in ``shifts``, chosen so that no two pairs share a slot. A lookup xors the
    slot with ``key << 20``: what is left is the rank, or 2**20 or more if the slot is another pair's or empty.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = [(ranks[x[:i]], ranks[x[i:]], r) for x, r in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks]
        a, b, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.size = 1 << max(4, int(1.3 * len(rank))).bit_length()
        self.groups = self.size // 4 - 1
        for self.factor in range(_NONE + 7, _NONE + 207, 2):
            key = a * self.factor + b
            if self._place(key, (key << 20) | rank):
                break
        else:
            raise ValueError("no collision-free layout of the ranks")
        self.bytes = [*(ranks[bytes([i])] for i in range(256)), _NONE - 1]
        self.none = max(ranks.values()) + 1
        self.first = [ranks.get(bytes([i, j]), self.none) if max(i, j) < 256 else self.none for i in range(257) for j in range(257)]
        self.pieces = [""] * (max(ranks.values()) + 1)
        for x, r in ranks.items():
            self.pieces[r] = x.hex()

    def _place(self, key: np.ndarray, entry: np.ndarray) -> bool:
        group, home = key % self.groups, key % self.size
        if len(np.unique(group * self.size + home)) < len(key):
            return False
        self.slots = np.full(self.size, _EMPTY, np.int64)
        self.shifts = np.zeros(self.groups, np.int64)
        free, order = np.ones(self.size, bool), np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0))) if len(key) else np.empty(0, np.int64)
        members = sorted(np.split(order, starts[1:]), key=len, reverse=True)
        several = sum(len(m) > 1 for m in members)
        for i, m in enumerate(members[:several]):
            for low in (np.arange(0, self.size, 64) + 64 * i) % self.size:
                places = (home[m][:, None] + np.arange(low, low + 64)) % self.size
                fits = np.flatnonzero(free[places].all(axis=0))
                if len(fits):
                    at = places[:, fits[0]]
                    self.shifts[group[m[0]]] = low + fits[0]
                    self.slots[at], free[at] = entry[m], False
                    break
            else:
                return False
        one = np.array([m[0] for m in members[several:]], np.int64)
        at = np.flatnonzero(free)[: len(one)]
        self.slots[at], self.shifts[group[one]] = entry[one], (at - home[one]) % self.size
        return True

    def rank(self, key: str) -> str:
        """SQL for the rank of the pair of a key; 2**20 or more where it has none. The literal is bound to ``t``."""
        return f"(get(t.slots, cast(({key} + get(t.shifts, cast({key} % {self.groups}L as int))) & {self.size - 1}L as int)) ^ shiftleft({key}, 20))"

    def ids(self, words: str) -> str:
        """SQL for the ids of each of ``words``: arrays of bytes with the mark ``END`` at both ends.

        The fold's state holds an entry for each of the word's ids, marks included, and the lowest entry and its place. An
        entry is the rank of the pair that begins there, where it begins in the word, and the id, so that the lowest
        one is the leftmost of the lowest rank. One step finds it, the next merges that pair, whose id is that rank.
        """
        zero = f"named_struct('e', transform(w, (b, i) -> shiftleft(coalesce(get(t.first, b * 257 + get(w, i + 1)), {_NONE}L), 30) | shiftleft(i, 20) | get(t.bytes, b)), 'm', 0L, 'p', 0)"
        found = "named_struct('e', s.e, 'm', array_min(s.e), 'p', cast(array_position(s.e, array_min(s.e)) as int))"
        keys = f"array((get(s.e, s.p - 2) & {_NONE - 1}L) * {self.factor}L + shiftright(s.m, 30), shiftright(s.m, 30) * {self.factor}L + (get(s.e, s.p + 1) & {_NONE - 1}L))"
        rests = f"array(get(s.e, s.p - 2) & {(1 << 30) - 1}L, s.m & {1023 << 20}L | shiftright(s.m, 30))"
        pairs = f"zip_with({keys}, {rests}, (k, l) -> shiftleft(least({self.rank('k')}, {_NONE}L), 30) | l)"
        merged = f"named_struct('e', concat(slice(s.e, 1, s.p - 2), {pairs}, slice(s.e, s.p + 2, size(s.e))), 'm', 0L, 'p', 0)"
        step = f"if(s.m >= {self.none << 30}L, s, if(s.p = 0, {found}, {merged}))"
        fold = f"aggregate(sequence(1, 2 * size(w)), {zero}, (s, i) -> {step}, s -> transform(slice(s.e, 2, size(s.e) - 2), v -> cast(v & {_NONE - 1}L as int)))"
        literal = ", ".join("'{}', cast(split('{}', ',') as array<bigint>)".format(n, ",".join(map(str, x))) for n, x in (("slots", self.slots), ("shifts", self.shifts), ("bytes", self.bytes), ("first", self.first)))
        return f"transform(array(named_struct({literal})), t -> transform({words}, w -> {fold}))[0]"

    def binary(self, ids: str) -> str:
        """SQL for the pieces of each array of ids of ``ids``, an array, concatenated. Unknown ids are left out."""
        pieces = "array(named_struct('p', split('{}', ',')))".format(",".join(self.pieces))
        return f"transform({pieces}, t -> transform({ids}, x -> unhex(array_join(transform(x, i -> get(t.p, i)), ''))))[0]"


@lru_cache(maxsize=2)
def rank_map(path: str) -> RankMap:
    return RankMap(read_ranks(path))


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word, with a heap of pairs and linked parts: n log n steps."""
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def rank(i):
        j = after[i]
        return ranks.get(word[i : ends[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end or rank(i) != r:
            continue
        j = after[i]
        alive[j] = False
        ends[i], after[i] = ends[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, ends[after[k]]))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def _offsets(sizes) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]).astype(np.int32))


def _sizes(lists) -> list[int]:
    return [len(x) for x in lists]


class Held:
    """Words in order, each found by its hash and told by its bytes; besides the bytes some 12 a word."""

    def __init__(self, words: pa.Array):
        self.words = words

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words in order, and each one's place; built where they are looked up, as hashes differ by process."""
        hashes = self.hashes(self.words.to_pylist())
        order = np.argsort(hashes).astype(np.int32)
        return hashes[order], order

    @staticmethod
    def hashes(listed: list[bytes]) -> np.ndarray:
        return np.fromiter(map(hash, listed), np.int64, len(listed))

    def find(self, words: pa.Array, hashed: np.ndarray) -> np.ndarray:
        """Each word's place; -1 where it is not held."""
        hashes, order = self.places
        if not len(order):
            return np.full(len(words), -1, np.int32)
        found = order[np.minimum(np.searchsorted(hashes, hashed), len(order) - 1)]
        same = pc.equal(self.words.take(pa.array(found)), words).to_numpy(zero_copy_only=False)
        return np.where(same, found, -1).astype(np.int32)

    def add(self, words: pa.Array, hashed: np.ndarray) -> None:
        hashes, order = self.places
        by = np.argsort(hashed)
        at = np.searchsorted(hashes, hashed[by])
        self.places = np.insert(hashes, at, hashed[by]), np.insert(order, at, (len(order) + by).astype(np.int32))
        self.words = pa.concat_arrays([self.words, words])


def known_words(ranks: dict[bytes, int], frequent: pa.Table) -> Held:
    """Words whose ids and decoded bytes need no fold in a block: those of the vocabulary, and the frequent ones. :class:`Folded` has what they give."""
    return Held(pa.concat_arrays([pa.array(list(ranks), pa.binary()), *frequent["word"].cast(pa.binary()).chunks]))


class Numbering:
    """Numbers the words of a task's blocks: known ones by their place, the others, from there on, as they come; each goes out once a task, or once again after ``MEMO`` others."""

    def __init__(self, known: Held, ranks: dict[bytes, int]):
        self.known, self.ranks = known, ranks
        self.sent = Held(pa.array([], pa.binary()))

    def of(self, texts: list[str], find) -> tuple[list[pa.Array], bool]:
        """Of some texts: each as numbers of its distinct words, those words' numbers in the task, the new words' bytes between marks, the ids of those too long to fold. And whether the task's words are numbered anew."""
        anew = len(self.sent.words) > MEMO
        if anew:
            self.sent = Held(pa.array([], pa.binary()))
        found = [pa.array(find(t), pa.string()) for t in texts]
        flat = pa.concat_arrays(found).dictionary_encode()
        numbers = pa.ListArray.from_arrays(_offsets(_sizes(found)), flat.indices)
        words = flat.dictionary.cast(pa.binary())
        hashed = Held.hashes(words.to_pylist())
        at = self.known.find(words, hashed)
        other = np.flatnonzero(at < 0)
        rest, hashed = words.take(pa.array(other)), hashed[other]
        place = self.sent.find(rest, hashed)
        new = np.flatnonzero(place < 0)
        place[new] = len(self.sent.words) + np.arange(len(new))
        at[other] = len(self.known.words) + place
        fresh = rest.take(pa.array(new))
        self.sent.add(fresh, hashed[new])
        left = fresh.to_pylist()
        long = [fold_long(w, self.ranks) if len(w) > LONG else [] for w in left]
        short = [b"" if i else w for w, i in zip(left, long, strict=True)]
        ends = np.cumsum([0, *(len(w) + 2 for w in short)])
        data = np.full(ends[-1], END, np.int16)
        inside = np.ones(len(data), bool)
        inside[ends[:-1][: len(left)]] = inside[ends[1:] - 1] = False
        data[inside] = np.frombuffer(b"".join(short), np.uint8)
        return [numbers, pa.array(at), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(data)), pa.array(long, pa.list_(pa.int32()))], anew


class Folded:
    """The ids and decoded bytes of the known words, in their order."""

    def __init__(self, ranks: dict[bytes, int], frequent: pa.Table):
        self.ids = pa.concat_arrays([pa.array([[r] for r in ranks.values()], pa.list_(pa.int32())), *frequent["ids"].cast(pa.list_(pa.int32())).chunks])
        self.pieces = pa.concat_arrays([pa.array(list(ranks), pa.binary()), *frequent["piece"].cast(pa.binary()).chunks])


class Task:
    """What the words of a task's blocks give: the known ones, and those folded in this block or before."""

    def __init__(self, known: pa.Array):
        self.known, self.own = known, pa.array([], known.type)

    def joined(self, at: pa.Array, folded: pa.Array, anew: bool) -> pa.Array:
        """What each word of the next block gives; ``folded`` has the block's new words."""
        self.own = pa.concat_arrays([*([] if anew else [self.own]), folded.cast(self.known.type)])
        place = at.to_numpy()
        is_known = place < len(self.known)
        order = np.empty(len(place), np.int64)
        order[is_known], order[~is_known] = np.arange(is_known.sum()), np.arange(is_known.sum(), len(place))
        both = [self.known.take(pa.array(place[is_known])), self.own.take(pa.array(place[~is_known] - len(self.known)))]
        return pa.concat_arrays(both).take(pa.array(order))


def frequent(docs: DataFrame, path: str, pattern: str, sample: int = SAMPLE, cached: int = CACHED) -> pa.Table:
    """word, ids, piece: at most ``cached`` words outside the vocabulary, the most frequent in one text of ``sample``, folded."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_map(path).ranks)

    def make():
        find, ranks = words_of(pattern), shared.value

        def of(batch):
            held: Counter = Counter()
            for t in batch.column(0).to_pylist():
                held.update(find(t))
            words = {b: n for w, n in held.items() if len(b := w.encode()) <= LONG and b not in ranks}
            return [list(words), list(words.values())]

        return of

    texts = pick(docs, "text").filter((F.length("text") > 0) & (F.pmod(F.xxhash64("text"), F.lit(sample)) == 0))
    counted = materialize(flat_map(texts, make, {"word": "binary", "n": "bigint"}).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "frequent")
    least, total = 1 << 62, 0
    for r in counted.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        total += r.words
        if total > cached:
            break
        least = r.n
    # Each task reads the ranks anew, so a task folds some thousand words and not a few. They are dealt out in a plan of their own, so
    # that the one with the literals has no exchange: adaptive execution would describe it anew, literals and all, at each stage.
    words = materialize(counted.filter(F.col("n") >= least).select("word").repartition(1 + min(total, cached) // 16_000, "word"), "words")
    codes = f"concat(array({END}S), transform(sequence(1, length(hex(word)), 2), i -> cast(conv(substring(hex(word), i, 2), 16, 10) as smallint)), array({END}S))"
    folded = words.select("word", F.expr(f"{rank_map(path).ids(f'array({codes})')}[0]").alias("ids"))
    return folded.withColumn("piece", F.expr(f"{rank_map(path).binary('array(ids)')}[0]")).toArrow()


def _blocks(docs: DataFrame, keep: list[str], path: str, pattern: str, block_chars: int):
    """One row for each block of texts: rows (what ``keep`` names), texts (numbers of words), at (their places among the known), ids of the others; and the broadcast of what the known give."""
    ranks, often, send = rank_map(path).ranks, frequent(docs, path, pattern), docs.sparkSession.sparkContext.broadcast
    shared, given = send((ranks, known_words(ranks, often))), send(Folded(ranks, often))
    del often
    give_back()
    # What the fold of the frequent words left: plans and tasks with the literals. The next plan has them again.
    docs.sparkSession.sparkContext._jvm.System.gc()
    at = [docs.columns.index(n) for n in keep]
    text = docs.columns.index("text")
    row = T.StructType([T.StructField(f"c{i}", docs.schema[k].dataType) for i, k in enumerate(at)])
    schema = T.StructType([T.StructField("rows", T.ArrayType(row)), T.StructField("texts", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("anew", T.BooleanType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.ArrayType(T.ShortType()))), T.StructField("long", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, (ranks, known) = words_of(pattern), shared.value
        numbering = Numbering(known, ranks)

        def block(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = pa.StructArray.from_arrays([batch.column(k) for k in at], names=[f"c{i}" for i in range(len(at))])
            (numbers, *parts), anew = numbering.of([t or "" for t in batch.column(text).to_pylist()], find)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p) for p in (rows, numbers, *parts)]
            return pa.RecordBatch.from_arrays([*lists[:2], pa.array([anew]), *lists[2:]], names=schema.names)

        for batch in batches:
            sizes = np.cumsum([0, *(n or 0 for n in pc.utf8_length(batch.column(text)).to_pylist())])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + block_chars, side="right")) - 1)
                yield block(batch.slice(low, high - low))
                low = high
        give_back()

    # Only a block with a long word has ids that are not folded here.
    ids = f"zip_with({rank_map(path).ids('words')}, long, (f, k) -> if(size(k) > 0, k, f))"
    return docs.mapInArrow(run, schema).withColumn("ids", F.expr(ids)).select("rows", "texts", "anew", "at", "ids"), given


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each block: the rows' columns, the texts' offsets among all words, those words' numbers, and whether the task's words are numbered anew with the block's other lists."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, texts, anew, *rest = (batch.column(k)[i] for k in range(batch.num_columns))
            rows, texts, rest = rows.values, texts.values, [anew.as_py(), *(x.values for x in rest)]
            start = texts.offsets[0].as_py()
            offsets = pc.cast(pc.subtract(texts.offsets, pa.scalar(start, pa.int32())), pa.int32())
            yield rows.flatten(), offsets, texts.values.slice(start, offsets[-1].as_py()), rest


def encode(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``vellum_ids`` (array of int).

    A null or empty text has no ids. Each row stands for itself; an empty table gives an empty one;
    other columns, whatever their names, are carried along. A long text is a block of its own, some
    twenty times its size in memory.
    """
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("vellum_ids", T.ArrayType(T.IntegerType()))])

    blocks, given = _blocks(docs, columns, path, pattern, block_chars)

    def run(batches):
        task = Task(given.value.ids)
        for columns_, offsets, numbers, (anew, at, folded) in _texts(batches):
            taken = task.joined(at, folded, anew).take(numbers)
            ends = pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False)))).astype(np.int32)).take(offsets)
            yield pa.RecordBatch.from_arrays([*columns_, pa.ListArray.from_arrays(ends, taken.flatten())], names=[*columns, "vellum_ids"])
        give_back()

    return blocks.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "vellum_ids") -> DataFrame:
    """``df`` with ``vellum_bytes``, the pieces of its ids joined. Null ids give no bytes; unknown ids are left out."""
    held = f"array(coalesce(`{ids}`, cast(array() as array<int>)))"
    return df.withColumn("vellum_bytes", F.expr(rank_map(path).binary(held))[0])


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (the columns that ``keep`` names, or all) with vellum_tokens, vellum_ids_sha256 and vellum_decoded_sha256.

    Nulls, empty and long texts, repeated rows and empty tables are as in :func:`encode`.
    """
    keep = docs.columns if keep is None else keep
    schema = T.StructType([*(docs.schema[n] for n in keep), T.StructField("vellum_tokens", T.LongType()), T.StructField("vellum_ids_sha256", T.StringType()), T.StructField("vellum_decoded_sha256", T.StringType())])

    def joined(values: pa.Array, offsets: pa.Array, numbers: pa.Array, by) -> list[str]:
        lists = pa.ListArray.from_arrays(offsets, values.take(numbers))
        return [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(lists, by)]

    blocks, given = _blocks(docs, keep, path, pattern, block_chars)

    def run(batches):
        by_id, by_piece = Task(given.value.ids), Task(given.value.pieces)
        for columns, offsets, numbers, (anew, at, folded, decoded) in _texts(batches):
            ids, pieces = by_id.joined(at, folded, anew), by_piece.joined(at, decoded, anew)
            starts, values = ids.offsets, ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py())
            own = pa.ListArray.from_arrays(pc.cast(pc.subtract(starts, starts[0]), pa.int32()), values.cast(pa.string()))
            length = np.concatenate(([0], np.cumsum(np.diff(starts.to_numpy())[numbers.to_numpy()])))
            tokens = np.diff(length[offsets.to_numpy()])
            new = [pa.array(tokens, pa.int64()), pa.array(joined(pc.binary_join(own, ","), offsets, numbers, ","), pa.string()), pa.array(joined(pieces, offsets, numbers, b""), pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=schema.names)
        give_back()

    return blocks.withColumn("pieces", F.expr(rank_map(path).binary("ids"))).mapInArrow(run, schema)


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same of the documents that earlier stages kept."""
    out = round_trip(pick(docs, "doc_id", "text"), *_public(), keep=["doc_id"])
    return out.select("doc_id", F.col("vellum_tokens").alias("n_tokens"), F.col("vellum_ids_sha256").alias("ids_sha256"), F.col("vellum_decoded_sha256").alias("decoded_sha256"))
