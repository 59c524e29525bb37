"""Quality classifier: labelled latent-semantic vectors vote for every document.

A text's features are hashed counts of its words and of its words' shapes (letters, capitals,
digits and marks, runs collapsed), and a few features of its lines. They are damped, weighted by
inverse document frequency and projected on the leading singular vectors of the labelled rows
(latent-semantic analysis). The labelled vectors go to every task, as their number has a bound
(``fit_rows``, default 4,096, chosen by hash of doc_id among all labelled rows). Each task takes
its documents in blocks, multiplies a block with all labelled vectors, which gives exact cosines,
and lets the ``neighbours`` nearest vote, weighted by a power of their similarity. Cosines are
rounded to six digits, so a document's neighbours do not depend on its block; labelled vectors
that tie for the last places share them, so their order doesn't matter either.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART, append, give_back, pick, split, table, utf8

WORDS, SHAPES, LINES = 768, 224, 32
DIM = WORDS + SHAPES + LINES
FIT_ROWS, RANK, NEIGHBOURS, POWER = 4096, 48, 25, 16
#: Documents multiplied at once: 128 x 4,096 cosines are 4 MB. Words whose features a worker keeps, some 250 bytes each.
BLOCK, KEPT = 128, 100_000

_CLASS = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_SLOTS: dict[bytes, tuple[int, int]] = {}


def _slots(word: bytes) -> tuple[int, int]:
    """The features of one word: the word itself and its shape."""
    found = _SLOTS.get(word)
    if found is None:
        shape = _RUN.sub(rb"\1", word.translate(_CLASS))
        found = xxhash.xxh32_intdigest(word.lower()) % WORDS, WORDS + xxhash.xxh32_intdigest(shape) % SHAPES
        if len(_SLOTS) >= KEPT:
            _SLOTS.clear()
        if len(word) <= 48:
            _SLOTS[word] = found
    return found


def features(text: bytes) -> np.ndarray:
    """Hashed counts of a whole text, damped; all zero for a text without words."""
    out = np.zeros(DIM, np.float32)
    counts = Counter(text.split())
    if not counts:
        return out
    slots = np.array([_slots(w) for w in counts], np.int64)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    total = n.sum()
    out += np.bincount(slots[:, 0], weights=n, minlength=DIM)
    out += np.bincount(slots[:, 1], weights=n, minlength=DIM)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    at = WORDS + SHAPES
    out[at + min(7, int(8 * repeated))] += total
    out[at + 8 + min(7, int(np.log2(1 + total / len(lines))))] += total / 2
    out[at + 16 + min(7, int(8 * len(counts) / total))] += total / 2
    out[at + 24 + min(7, int(np.log2(total)) // 2)] += total / 4
    return np.log1p(100 * out / total).astype(np.float32)


class Neighbours:
    """Labelled vectors in the latent space."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS, power: float = POWER):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.k, self.power = min(neighbours, len(labels)), power
        self.labels = labels.astype(np.float64)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1
        w = x * self.idf
        values, vectors = np.linalg.eigh(w.T @ w) if len(x) else (np.zeros(DIM), np.eye(DIM))
        self.basis = vectors[:, np.argsort(values)[::-1][:rank]]
        self.vectors = self._latent(x)

    def _latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Shares of label 1 among the nearest, by weight; the prior where nothing is similar."""
        out = np.full(len(x), self.prior)
        if not self.k:
            return out
        for a in range(0, len(x), BLOCK):
            cosines = np.rint(self._latent(x[a : a + BLOCK]) @ self.vectors.T * 1e6).astype(np.int32)
            near = np.argpartition(-cosines, self.k - 1, axis=1)[:, : self.k]
            found = np.take_along_axis(cosines, near, 1)
            last = found.min(axis=1, keepdims=True)
            ties = cosines == last
            shared = (ties @ self.labels) / ties.sum(axis=1)
            labels = np.where(found > last, self.labels[near], shared[:, None])
            weight = (np.maximum(found, 0) / 1e6) ** self.power
            total = weight.sum(1)
            some = total > 1e-9
            out[a : a + BLOCK][some] = (weight * labels).sum(1)[some] / total[some]
        return np.clip(np.round(out, 9), 0, 1)


def learns(doc_id: str = "doc_id"):
    """Whether labels of this document may be learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Neighbours:
    """Train on at most ``fit_rows`` labelled documents, the first by hash of their id."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learns()).groupBy("doc_id").agg(F.min("quality").alias("vellum_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        return lambda ts: [[features(t).tobytes() for t in ts]]

    rows = append(texts, make, {"vellum_x": "binary"}).groupBy("doc_id", "vellum_label").agg(F.min("vellum_x").alias("vellum_x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.vellum_x, np.float32) for r in rows]).reshape(-1, DIM)
    model = Neighbours(x, np.array([r.vellum_label for r in rows], float))
    del rows, x
    give_back()
    return model


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``vellum_score``, how likely label 1 is, from 0 to 1.

    Only the whole text counts. A null, empty or blank text is similar to nothing and gets the
    share of label 1 among the labelled rows; so does every text where there are none (one half).
    Of repeated labels the lower holds; repeated documents score alike, and labelled ones that share
    an id are learned from once. A long text costs its words' time and one vector of ``DIM`` numbers.
    ``docs`` must not have a column ``vellum_score`` of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))
    return append(docs, lambda: lambda texts: [pa.array(_scores(shared.value, texts))], {"vellum_score": "double"})


def _scores(model: Neighbours, texts: list[bytes]) -> np.ndarray:
    out = [model.score(np.array([features(t) for t in texts[a : a + 512]]).reshape(-1, DIM)) for a in range(0, len(texts), 512)]
    return np.concatenate(out) if out else np.empty(0)


def query(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = classify(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(~learns(), F.lit(False)).alias("held_out"), F.col("vellum_score").alias("score"), (F.col("vellum_score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good, whatever their columns are called."""
    shared, at = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels"))), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in split(batch, at, PART):
                yield part.filter(pa.array(_scores(shared.value, utf8(part.column(at))) >= 0.5))
        _SLOTS.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)
