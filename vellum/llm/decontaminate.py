"""Benchmark decontamination: a BM25 index of test items, searched with every training passage.

The items are indexed as an inverted index whose postings carry BM25 impacts, in blocks with
their largest impact. Each document is cut into passages that overlap by half, so that any item
lies within one passage (of twice the words of the longest item of all); each passage's distinct
words are one query, answered by block-max WAND.
An item's impacts are divided by its own threshold, the least score that a passage holding
``share`` of the item's five-word shingles can have, so everything above one is retrieved and
nothing that passes the check below is lost. A hit is verified on its words: ``share`` of the item's
shingles, and of its question (first two thirds of its words) and its answer (the rest) half. An
item shorter than a shingle is one shingle of its own length, found wherever its words stand in a row.

Items go to the tasks in blocks of at most ``block_words`` words (or one longer item); more items mean
more blocks and so more scans, never a larger broadcast. Words are counted over all items by Spark, and
each item comes to the driver with the counts of its own words, one block at a time.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART as BYTES
from .common import SPACE_CLASS, flat_map, give_back, materialize, pick, split, table, utf8

SIZE, SHARE, PART = 5, 0.8, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K1, B = 1.2, 0.75
#: Items of neighbouring lengths that share a block of the index.
POSTING_BLOCK = 4
BLOCK_WORDS = 200_000


def shingles(words: list, size: int = SIZE) -> set[tuple]:
    """The shingles of a list of words; fewer words than a shingle are one, none have none."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def windows(words: list, size: int) -> set[tuple]:
    """The runs of ``size`` words; none where there are fewer."""
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


class Index:
    """Impact-ordered knowledge of the items: postings by word, and each item's shingles."""

    def __init__(self, items: list[tuple[object, bytes]], frequency: dict[bytes, int], n_items: int, mean: float, step: int, share: float = SHARE):
        items = sorted(items, key=lambda x: len(x[1].split()))
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.whole, self.question, self.answer, self.words = [], [], [], []
        #: Each item's longest words, one more than a passage with enough of its shingles can lack: such a passage holds one of them.
        self.essential: set[int] = set()
        postings: dict[int, list[tuple[int, float]]] = {}
        self.step = step
        for at, (_, text) in enumerate(items):
            raw = text.lower().split()
            words = [self.number.setdefault(w, len(self.number)) for w in raw]
            cut = max(1, 2 * len(words) // 3)
            self.words.append(len(words))
            whole = shingles(words)
            self.whole.append(whole)
            self.question.append(shingles(words[:cut]) & whole if len(words) - cut >= SIZE else whole)
            self.answer.append(shingles(words[cut:]) & whole if len(words) - cut >= SIZE else whole)
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {t: math.log1p((n_items - frequency[r] + 0.5) / (frequency[r] + 0.5)) * c * (K1 + 1) / (c + norm) for (t, c), r in zip(Counter(words).items(), dict.fromkeys(raw), strict=True)}
            # A lacking word takes a shingle with it, or its part of one that repeats within the item.
            repeats = max(Counter(tuple(words[i : i + SIZE]) for i in range(max(1, len(words) - SIZE + 1))).values(), default=1)
            lost = math.floor((1 - share) * len(whole) * repeats + 1e-9)
            least = sum(sorted(impact.values())[: max(1, len(impact) - lost)]) * (1 - 1e-9) if impact else math.inf
            lengths = dict(zip(words, map(len, raw), strict=True))
            self.essential |= set(sorted(impact, key=lambda t: -lengths[t])[: lost + 1])
            for t, x in impact.items():
                postings.setdefault(t, []).append((at, x / least))
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.postings: dict[tuple[int, int], tuple[list[int], list[float]]] = {}
        for t, found in postings.items():
            in_block: dict[int, list[tuple[int, float]]] = {}
            for item, x in found:
                in_block.setdefault(item // POSTING_BLOCK, []).append((item, x))
            self.blocks[t] = np.array(list(in_block), np.int64), np.array([max(x for _, x in p) for p in in_block.values()])
            self.postings |= {(t, b): ([i for i, _ in p], [x for _, x in p]) for b, p in in_block.items()}
        self.most = {t: float(most.max()) for t, (_, most) in self.blocks.items()}
        self.n_blocks = -(-len(items) // POSTING_BLOCK)

    def search(self, words: set[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """Items whose summed impacts reach the threshold, by block-max WAND.

        Blocks are ranges of items. The largest impacts of the query's words bound every block at once;
        inside the blocks whose bound reaches the threshold, items are reached by pivots.
        """
        if not words:
            return []
        blocks, most = zip(*[self.blocks[t] for t in words], strict=True)
        bounds = np.bincount(np.concatenate(blocks), np.concatenate(most), self.n_blocks)
        return [hit for b in np.flatnonzero(bounds >= threshold - 1e-9).tolist() for hit in self._wand([self.postings[t, b] for t in words if (t, b) in self.postings], threshold)]

    @staticmethod
    def _wand(lists: list[tuple[list[int], list[float]]], threshold: float) -> list[tuple[int, float]]:
        """(item, score) by pivoting over posting lists, each bounded by its largest impact."""
        out, cursors = [], [[items, impacts, max(impacts), 0] for items, impacts in lists]
        while True:
            cursors = sorted((c for c in cursors if c[3] < len(c[0])), key=lambda c: c[0][c[3]])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= threshold - 1e-9:
                    pivot = c[0][c[3]]
                    break
            if pivot is None:
                return out
            if cursors[0][0][cursors[0][3]] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0][c[3]] == pivot:
                        score += c[1][c[3]]
                        c[3] += 1
                if score >= threshold:
                    out.append((pivot, score))
            else:
                for c in cursors:
                    while c[3] < len(c[0]) and c[0][c[3]] < pivot:
                        c[3] += 1

    def hits(self, text: bytes, share: float = SHARE) -> dict[int, tuple[float, float, float, float]]:
        """score, overlap, question's and answer's overlap of each verified item of a text, of its best passage."""
        get, most, step = self.number.get, self.most, self.step
        words = [get(w, -1) for w in text.lower().split()]
        found: dict[int, tuple] = {}
        if self.essential.isdisjoint(words):
            return {}
        for start in range(0, max(1, len(words) - step), step):
            part = words[start : start + 2 * step]
            query = set(part)
            query.discard(-1)
            if self.essential.isdisjoint(query) or sum([most[t] for t in query]) < 1:
                continue
            own: dict[int, set] = {}
            for item, score in self.search(query):
                size = min(SIZE, self.words[item])
                held = own.get(size) or own.setdefault(size, windows(part, size))
                overlaps = tuple(len(held & x) / max(1, len(x)) for x in (self.whole[item], self.question[item], self.answer[item]))
                if overlaps[0] >= share - 1e-9 and min(overlaps[1:]) >= PART:
                    found[item] = max(found.get(item, ()), (*overlaps, score))
        return {i: (s, o, q, a) for i, (o, q, a, s) in found.items()}


def indexes(items: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS):
    """Indexes of the items, each of at most ``block_words`` words (or one item); frequencies are those of all items."""
    cut = f"filter(split(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), r'[{SPACE_CLASS}]+'), w -> w <> '')"
    rows = materialize(pick(items, "item_id", "text").withColumn("words", F.expr(cut)).filter("size(words) > 0").withColumn("row", F.expr("uuid()")), "items")
    n, total, step = items.count(), *rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.max(F.size("words"))).first()
    held = rows.select("row", F.explode(F.array_distinct("words")).alias("word"))
    counts = held.join(held.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    block, frequency, size = [], {}, 0
    for r in rows.join(counts, "row").select("item_id", "text", F.size("words").alias("size"), "counts").toLocalIterator():
        if block and size + r["size"] > block_words:
            yield Index(block, frequency, n, total / n, step, share)
            block, frequency, size = [], {}, 0
        block.append((r.item_id, r.text.encode()))
        frequency |= {w.encode(): c for w, c in r.counts.items()}
        size += r["size"]
    if block:
        yield Index(block, frequency, n, total / n, step, share)


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, vellum_bm25, vellum_overlap, vellum_question, vellum_answer: the items that each document holds.

    Words are cut at white space and lower-cased in A-Z. Items without words hit nothing; those
    of fewer words than a shingle hit a text that has their words in a row. Null texts hold nothing. Repeated
    documents or items give repeated rows; null ids are carried along; an empty table gives no rows. A long text
    is searched passage by passage. Of passages that hold an item equally well, the one with the larger score counts.
    """
    fields = {"doc_id": dict(docs.dtypes)["doc_id"], "item_id": dict(items.dtypes)["item_id"], "vellum_bm25": "double", "vellum_overlap": "double", "vellum_question": "double", "vellum_answer": "double"}
    spark, out = docs.sparkSession, None
    for index in indexes(items, share, block_words):
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            index = shared.value

            def of(batch):
                rows = [(i, index.ids[item], *x) for i, t in enumerate(utf8(batch.column(1))) for item, x in index.hits(t, share).items()]
                cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(6)]
                return [batch.column(0).take(pa.array(cols[0], pa.int64())), *cols[1:]]

            return of

        part = flat_map(pick(docs, "doc_id", "text"), make, fields)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.select("doc_id").limit(0).select("doc_id", *(F.lit(None).cast(t).alias(n) for n, t in list(fields.items())[1:]))
    return out


def query(spark, sf_dir) -> DataFrame:
    """doc_id, item_id, overlap, question_overlap, answer_overlap of every benchmark item in a document."""
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", *(F.round(a, 6).alias(b) for a, b in (("vellum_overlap", "overlap"), ("vellum_question", "question_overlap"), ("vellum_answer", "answer_overlap"))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, judged by their text alone, one block of items after the other."""
    at, out = docs.columns.index("text"), docs
    for n, index in enumerate(indexes(table(spark, sf_dir, "benchmark"))):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for part in split(batch, at, BYTES):
                    yield part.filter(pa.array([not shared.value.hits(t) for t in utf8(part.column(at))], pa.bool_()))
            give_back()

        out = (materialize(out, "clean") if n else out).mapInArrow(run, docs.schema)
    return out


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_GRAM = "array_to_string(w[p + 1:p + size], ' ')"
SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
l AS (SELECT max(len(w)) AS step FROM b),
i AS (SELECT item_id, w, p, least(5, len(w)) AS size, greatest(1, 2 * len(w) // 3) AS cut FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS p FROM b WHERE len(w) > 0)),
s AS (
  SELECT DISTINCT item_id, part, size AS width, {_GRAM} AS g FROM (
    SELECT *, unnest(CASE WHEN len(w) - cut < 5 THEN [0, 1, 2] WHEN p + 5 <= cut THEN [0, 1] WHEN p >= cut THEN [0, 2] ELSE [0] END) AS part FROM i)
), z AS (SELECT item_id, part, count(*) AS size FROM s GROUP BY item_id, part),
d AS (
  SELECT doc_id, w, size, len(w) AS n, unnest(range(0, len(w) - size + 1)) AS p
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT size FROM i) WHERE len(w) >= size
), m AS (SELECT d.doc_id, d.n, d.p, d.size AS width, s.item_id, s.part, s.g FROM (SELECT *, {_GRAM} AS g FROM d) d JOIN s ON s.g = d.g AND s.width = d.size),
x AS (SELECT m.*, unnest([p // step, p // step - 1]) AS j, step FROM m, l),
c AS (
  SELECT doc_id, item_id, j, part, count(DISTINCT g) AS k FROM x
  WHERE j >= 0 AND (j * step < greatest(1, n - step)) AND p + width <= j * step + 2 * step GROUP BY doc_id, item_id, j, part
), o AS (
  SELECT doc_id, item_id, j, max(CASE WHEN part = 0 THEN k / size ELSE 0 END) AS overlap,
         max(CASE WHEN part = 1 THEN k / size ELSE 0 END) AS question_overlap, max(CASE WHEN part = 2 THEN k / size ELSE 0 END) AS answer_overlap
  FROM c JOIN z USING (item_id, part) GROUP BY doc_id, item_id, j
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, question_overlap DESC, answer_overlap DESC) AS place
  FROM o WHERE overlap >= {SHARE} - 1e-9 AND question_overlap >= {PART} AND answer_overlap >= {PART}
)
SELECT doc_id, item_id, round(overlap, 6) AS overlap, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap FROM r WHERE place = 1
"""
