"""Language-model scores from a subword lattice.

A text is its words and one end. Every segmentation of a word into pieces of a public vocabulary
counts, weighted by the product of its pieces' weights, and a forward recursion in log space adds
them up. A text's score is the sum of its words' log10 probabilities: its marginal likelihood.

The vocabulary is one of merges, which has no probabilities, only scores that fall by one with each
merge; 1 / (1 - score), normalised, is a piece's first weight. The weights are then learned: a round
spreads each training word's count over the pieces of all its segmentations by their share of the
word's probability, adds these expected counts over the corpus, and a piece's new weight is its
expected count and a share of ``PRIOR`` a piece that follows the first weights. Characters that no
piece holds take the vocabulary's byte pieces.

How it runs: one scan turns each Arrow batch of texts into numbers of a dictionary of its own, and
both are written. Only dictionary entries (a word once a batch, however often it occurs)
shuffle by word, are counted over all training documents, scored once for each distinct word, and
come back to their batch. A round of learning is one pass over the distinct words, whose sums by piece are
bounded by the vocabulary. A batch holds at most ``BATCH_BYTES`` of text, or one longer text, which takes some ten times its size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_map, materialize, pick, table, utf8

#: Rounds of learning, and what the first weights count for, a piece.
ROUNDS, PRIOR = 2, 0.1
#: Most bytes of text that share a dictionary.
BATCH_BYTES = 1 << 24
START = "▁"


class Lattice:
    """Marginal log probabilities of words over all segmentations."""

    def __init__(self, pieces: list[tuple[str, float]]):
        log = dict(pieces)
        self.bytes = [log.get(f"<0x{b:02X}>", -25.0) for b in range(256)]
        #: The log of each piece; None for what only begins a piece.
        self.steps = {p[:n]: None for p in log for n in range(1, len(p))} | log
        self.longest = max(map(len, log), default=0)
        self.last: tuple = ("", [0.0], [[]], [[]], [])
        self.mass, self.counts = [0.0], defaultdict(float)

    def _spread(self, same: int) -> None:
        """Give the counts that wait at the places after ``same`` to the last pieces there and the places where these start."""
        s, at, into, starts, _ = self.last
        mass, counts, find, exp = self.mass, self.counts, self.steps.get, math.exp
        for j in range(len(s), same, -1):
            m, a, terms = mass.pop(), at[j], into[j]
            if not m:
                continue
            for t, i in zip(terms, starts[j]):
                share = m if len(terms) == 1 else m * exp(t - a)
                mass[i] += share
                piece = s[i:j]
                if find(piece) is None:
                    for b in piece.encode("utf-8", "replace"):
                        counts[f"<0x{b:02X}>"] += share
                else:
                    counts[piece] += share

    def _forward(self, s: str) -> float:
        """The log of the summed probability of what leads to the end of ``s``.

        ``last`` keeps, for each place, that log, those of its last pieces and where these start, and how far
        pieces that start there go. What ``s`` begins with as the string before it did stays, so words in order cost the least.
        """
        before, at, into, starts, reach = self.last
        n, find, exp, ln = len(s), self.steps.get, math.exp, math.log
        same = 0
        for x, y in zip(before, s):
            if x != y:
                break
            same += 1
        self._spread(same)
        del at[same + 1 :], into[same + 1 :], starts[same + 1 :], reach[same:]
        into += [[] for _ in range(n - same)]
        starts += [[] for _ in range(n - same)]
        self.mass += [0.0] * (n - same)
        for i in range(max(0, same - self.longest), n):
            here = at[i]
            if i < same:
                if reach[i] < same:
                    continue
                reach[i] = low = same
            else:
                low = i
                reach.append(i)
                if find(s[i]) is None:
                    into[i + 1].append(here + sum([self.bytes[b] for b in s[i].encode("utf-8", "replace")]))
                    starts[i + 1].append(i)
            for j in range(low + 1, n + 1):
                p = find(s[i:j], 0.0)
                if p == 0.0:
                    break
                reach[i] = j
                if p is not None:
                    into[j].append(here + p)
                    starts[j].append(i)
            if i >= same:
                terms = into[i + 1]
                if len(terms) == 1:
                    at.append(terms[0])
                else:
                    top = max(terms)
                    at.append(top + ln(sum([exp(t - top) for t in terms])))
        self.last = (s, at, into, starts, reach)
        return at[n]

    def word(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of the word, its start mark included."""
        return self._forward(START + word)

    def expect(self, word: str, count: int) -> None:
        """Take in ``count`` copies of the word; beginnings that words in order share wait and are spread once."""
        self._forward(START + word)
        self.mass[-1] += count

    def expected(self) -> dict[str, float]:
        """How often each piece is expected in the words taken in."""
        self._forward("")
        return self.counts


def read_pieces(path: str) -> tuple[list[tuple[str, float]], float]:
    """The vocabulary's pieces with the natural logs of their weights, and that of its end mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight = [0.0 if sp.is_unknown(i) or i == sp.bos_id() else 1 / (1 + sp.vocab_size()) if sp.is_control(i) or sp.is_byte(i) else 1 / (1 - sp.get_score(i)) for i in range(sp.vocab_size())]
    total = sum(weight)
    pieces = [(sp.id_to_piece(i), math.log(w / total)) for i, w in enumerate(weight) if w and not sp.is_control(i)]
    return pieces, math.log(weight[sp.eos_id()] / total)


def held_out(doc_id, folds: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def _numbered(docs: DataFrame, folds: int) -> DataFrame:
    """One row for each document (``word`` null) and one for each word of each batch, with its count in training documents."""

    def make():
        state = {"batch": TaskContext.get().partitionId() << 24}

        def of(batch):
            state["batch"] += 1
            number: dict[bytes, int] = {}
            train: Counter = Counter()
            ids, held, tokens, words, counts = batch.column(0), [], [], [], []
            for d, t in zip(ids.to_pylist(), utf8(batch.column(1)), strict=True):
                found = Counter(t.lower().split())
                out = held_out(d, folds)
                held.append(out)
                tokens.append(sum(found.values()) + 1)
                words.append([number.setdefault(w, len(number)) for w in found])
                counts.append(list(found.values()))
                if not out:
                    train.update(found)
            n, m = len(words), len(number)
            return [
                [state["batch"]] * (n + m),
                pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                held + [None] * m,
                tokens + [None] * m,
                words + [None] * m,
                counts + [None] * m,
                pa.array([None] * n + list(number), pa.binary()),
                [None] * n + list(range(m)),
                [None] * n + [train[w] for w in number],
            ]

        return of

    fields = {"batch": "bigint", "doc_id": dict(docs.dtypes)["doc_id"], "held": "boolean", "tokens": "bigint", "words": "array<int>", "counts": "array<int>", "word": "binary", "number": "int", "train": "bigint"}
    return flat_map(pick(docs, "doc_id", "text"), make, fields, most=("text", BATCH_BYTES))


def learn(counted: DataFrame, pieces: list[tuple[str, float]], end: float, ends: int, rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[list[tuple[str, float]], float]:
    """The pieces and the end mark with the logs of learned weights, from ``counted``: word (binary) and c, its count in training documents, which have ``ends`` ends.

    Words of count zero are not looked at; without any word and end, and with no rounds, the weights stay the first ones.
    """
    first, last = pieces, end
    for _ in range(rounds):
        shared = counted.sparkSession.sparkContext.broadcast(pieces)

        def make(shared=shared):
            lattice = Lattice(shared.value)

            def of(batch):
                if batch is None:
                    found = lattice.expected()
                    return [list(found), list(found.values())]
                for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lattice.expect(w.decode(), c)
                return [[], []]

            return of

        sums = flat_map(counted.filter("c > 0").select("word", "c"), make, {"piece": "string", "n": "double"}, last=True)
        expected = {r.piece: r.n for r in sums.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        share = prior * len(first)
        total = math.fsum(expected.values()) + ends + share
        pieces = [(p, math.log((expected.get(p, 0.0) + share * math.exp(w)) / total)) for p, w in first]
        end = math.log((ends + share * math.exp(last)) / total)
        shared.unpersist()
    return pieces, end


def score(docs: DataFrame, path: str, folds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Documents whose ``doc_id`` as text has a crc32 that ``folds`` divides are held out; the counts
    are those of all others, rows without ``doc_id`` among them. Each row is a document. A null or
    empty text is one end. With no training documents the first weights decide.
    """
    pieces, end = read_pieces(path)
    rows = materialize(_numbered(docs, folds), "numbered")
    texts, entries = rows.filter("word IS NULL").select("batch", "doc_id", "held", "tokens", "words", "counts"), rows.filter("word IS NOT NULL").select("batch", "word", "number", "train")
    ends = texts.filter("NOT held").count()
    counted = materialize(entries.groupBy("word").agg(F.sum("train").alias("c")).sortWithinPartitions("word"), "words")
    pieces, end = learn(counted, pieces, end, ends, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    known, total = counted.agg(F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, known = total + ends, known + (ends > 0)
    floor = total + 0.1 * (known + 1)

    def base(c):
        return math.log10((c + 0.1) / floor)

    def weigh():
        lattice = Lattice(shared.value)

        def of(batch):
            words, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            return [batch.column(0), pa.array([n > 0 for n in c]), [base(n) for n in c], [lattice.word(w.decode()) / math.log(10) for w in words]]

        return of

    weighed = flat_map(counted, weigh, {"word": "binary", "known": "boolean", "base": "double", "model": "double"})
    back = entries.select("batch", "word", "number").join(weighed, "word").select(F.col("batch").alias("of_batch"), "number", "known", "base", "model")
    end_base, end_model = base(ends), end / math.log(10)

    def add_up(key, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["number"].to_numpy())
        known_, base_, model_ = (right[n].to_numpy()[order] for n in ("known", "base", "model"))
        words, counts = left["words"].combine_chunks(), left["counts"].combine_chunks()
        starts = words.offsets.to_numpy()
        w, n = words.values.to_numpy()[starts[0] : starts[-1]], counts.values.to_numpy()[counts.offsets.to_numpy()[0] :][: starts[-1] - starts[0]]
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        adds = [np.bincount(row, weights=x[w] * n, minlength=len(starts) - 1) if len(w) else np.zeros(len(starts) - 1) for x in (known_.astype(float), base_, model_)]
        n_known = adds[0].astype(np.int64) + (ends > 0)
        return pa.table([left["doc_id"], left["held"], left["tokens"], pa.array(n_known), pa.array(np.full(len(n_known), total, np.int64)), pa.array(adds[1] + end_base), pa.array(adds[2] + end_model)], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [docs.schema["doc_id"].dataType, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    return texts.groupBy("batch").cogroup(back.groupBy("of_batch")).applyInArrow(add_up, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def query(spark, sf_dir) -> DataFrame:
    """The scores of every document."""
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
