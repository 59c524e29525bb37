import math
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest

from vellum.llm import lattice_lm as L

PATH = P.path("piece_bpe_32k.model")


def plain_word(pieces, word):
    """Sum over all segmentations, one by one."""
    log, s = dict(pieces), L.START + word

    def rest(i):
        if i == len(s):
            return 1.0
        ways = [math.exp(log[s[i:j]]) * rest(j) for j in range(i + 1, len(s) + 1) if s[i:j] in log]
        if s[i] not in log:
            ways.append(math.prod(math.exp(log[f"<0x{b:02X}>"]) for b in s[i].encode()) * rest(i + 1))
        return sum(ways)

    return rest(0)


def test_marginal_is_the_sum_over_segmentations():
    pieces, _ = L.read_pieces(PATH)
    lattice = L.Lattice(pieces)
    for w in ("", "a", "the", "thonered", "éclair", "naïve|x", "你好", "\u0001z"):
        assert math.isclose(lattice.word(w), math.log(plain_word(pieces, w)), rel_tol=1e-9)
    assert math.isfinite(lattice.word("x" * 100_000))
    words = ["", "th", "the", "then", "thonered", "éclair", "écru", "naïve|x", "naïvety", "你好", "\u0001z"]
    alone = Counter()
    for w in words * 2:
        assert lattice.word(w) == L.Lattice(pieces).word(w)
        one = L.Lattice(pieces)
        one.expect(w, 3)
        alone.update(one.expected())
    for order in (sorted(words * 2), words[::-1] * 2):
        for w in order:
            lattice.expect(w, 3)
        assert lattice.expected() == pytest.approx(alone)
        lattice.counts.clear()


def test_weights_are_a_distribution():
    pieces, end = L.read_pieces(PATH)
    assert math.isclose(sum(math.exp(p) for _, p in pieces) + math.exp(end), 1, rel_tol=1e-9)


def plain_learn(c, pieces, end, rounds=2, prior=0.1):
    """Expected counts by a backward recursion, in plain probabilities where they don't vanish."""
    first, last, ends = pieces, end, c[None]
    for _ in range(rounds):
        got = Counter()
        for w, n in c.items():
            if w is None:
                continue
            if len(w) > 30:
                long = L.Lattice(pieces)
                long.expect(w, n)
                got.update(long.expected())
                continue
            log, s = dict(pieces), L.START + w
            steps = [(i, j, [s[i:j]]) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if s[i:j] in log]
            steps += [(i, i + 1, [f"<0x{b:02X}>" for b in x.encode()]) for i, x in enumerate(s) if x not in log]
            p = {(i, j): math.exp(sum(log[x] for x in xs)) for i, j, xs in steps}
            f, b = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
            for j in range(1, len(s) + 1):
                f[j] = sum(f[i] * q for (i, k), q in p.items() if k == j)
            for i in reversed(range(len(s))):
                b[i] = sum(q * b[k] for (h, k), q in p.items() if h == i)
            for i, j, xs in steps:
                for x in xs:
                    got[x] += n * f[i] * p[i, j] * b[j] / f[-1]
        share = prior * len(first)
        total = sum(got.values()) + ends + share
        pieces = [(x, math.log((got[x] + share * math.exp(v)) / total)) for x, v in first]
        end = math.log((ends + share * math.exp(last)) / total)
    return pieces, end


def test_learned_weights_fit_better(spark):
    words = Counter({"the": 90, "thonered": 7, "naïve|x": 3, "你好": 2})
    counted = spark.createDataFrame([*((w.encode(), n) for w, n in words.items()), (b"unseen", 0)], "word binary, c bigint")
    pieces, end = L.read_pieces(PATH)
    likely = []
    for rounds in range(4):
        learned, stop = L.learn(counted, pieces, end, 10, rounds)
        assert math.isclose(sum(math.exp(p) for _, p in learned) + math.exp(stop), 1, rel_tol=1e-9)
        lattice = L.Lattice(learned)
        prior = sum(0.1 * len(pieces) * math.exp(first) * now for (_, first), (_, now) in zip(pieces, learned, strict=True))
        likely.append(sum(n * lattice.word(w) for w, n in words.items()) + (10 + 0.1 * len(pieces) * math.exp(end)) * stop + prior)
    assert likely == sorted(likely)
    assert L.learn(counted.limit(0), pieces, end, 0)[1] == pytest.approx(end)


def test_batches_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").coalesce(1)
    key = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in rows)
    whole = key(L.score(docs, PATH).collect())
    monkeypatch.setattr(L, "BATCH_BYTES", 100)
    assert L._numbered(docs, 10).select("batch").distinct().count() > 10
    assert key(L.score(docs, PATH).collect()) == whole


ROWS = [(i, f"The cat{i % 5} sat on The mat{i % 9}\nÉté ÉTÉ\x0bend") for i in range(60)] + [(70, None), (71, ""), (72, " \t"), (73, "w " * 40_000), (73, "w"), (None, "the cat"), (74, "never seen words 你好"), (75, "x" * 70_000)]


def test_against_plain(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id bigint, text string, word int, batch string").repartition(3)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")) for _, t in ROWS]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in ROWS]
    assert any(held)
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in [*t, None])
    n, v = sum(c.values()), len(c)
    pieces, end = plain_learn(c, *L.read_pieces(PATH))
    lattice = L.Lattice(pieces)
    want = []
    for (d, _), t, h in zip(ROWS, tokens, held, strict=True):
        words = [*t, None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        model = sum(end if w is None else lattice.word(w) for w in words) / math.log(10)
        want.append((str(d), h, len(words), sum(c[w] > 0 for w in words), n, round(base, 6), round(model, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in L.score(docs, PATH).collect()]
    assert sorted(got) == sorted(want)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(6, "a b")], "doc_id bigint, text string")
    assert L.score(docs.limit(0), PATH).count() == 0
    assert L.score(docs, PATH).count() == 1
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(r.n_tokens for r in L.score(blank, PATH).collect()) == [1, 1]
