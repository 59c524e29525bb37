import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vellum.llm import substring_dedup as S

R = random.Random(5)


def prose(n):
    return "".join(R.choice("etaoinshrdlu  ") for _ in range(n))


PASSAGE, OTHER, LONG = prose(260), prose(500), prose(900)


def rows():
    out = [(i, prose(R.randint(0, 300)) + PASSAGE[R.randint(0, 30) : 230 + R.randint(0, 30)] + prose(R.randint(0, 300))) for i in range(40)]
    out += [(100 + i, prose(50) + OTHER[: 150 + 60 * i] + prose(20) + OTHER[100:] + LONG[i * 100 : i * 100 + 400]) for i in range(5)]
    out += [(200, LONG), (201, LONG), (201, LONG), (None, LONG[:199]), (202, "é" * 150 + prose(100)), (203, "é" * 151), (204, None), (205, ""), (206, "x" * 5000), (207, "ab" * 3000 + prose(30)), (208, PASSAGE[:199]), (209, PASSAGE[:200]), (210, PASSAGE[1:] + PASSAGE)]
    edited = list(LONG)
    for at in range(150, 900, 250):
        edited[at] = "#"
    return [*out, (211, "".join(edited))]


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    out = []
    for t in data:
        covered = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                covered[i + 1 : i + 201] = True
        left = bytes(b for b, c in zip(t, covered[1:], strict=False) if not c)
        out.append((len(t), int(covered.sum()), int((np.diff(covered.astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [S.HOT, 3])
def test_against_all_windows(spark, hot):
    data = rows()
    docs = spark.createDataFrame([(*r, "k", b"x") for r in data], "doc_id bigint, text string, key string, vellum_z binary").repartition(3)
    got = Counter((str(r.doc_id), r.vellum_length, r.vellum_removed, r.vellum_runs, hashlib.sha256(r.vellum_bytes).hexdigest()) for r in S.dedup_substrings(docs, hot).collect())
    want = Counter((str(d), *p) for (d, _), p in zip(data, plain([t for _, t in data]), strict=True))
    assert got == want


def test_long_texts_in_parts_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 700)
    data = [("a", LONG + OTHER + PASSAGE + LONG), ("b", prose(40) + OTHER), ("c", prose(3000) + LONG[300:] + prose(900)), ("d", OTHER + PASSAGE), ("d", None)]
    seen = Counter((i, w) for i, (_, t) in enumerate(data) for part in S._chunks([(t or "").encode()]) for _, p, at in part for w in range(at, at + len(p) - 199))
    assert set(seen.values()) == {1} and len(seen) == sum(max(0, len(t or "") - 199) for _, t in data)
    big = prose(300_000)
    data += [("e", big + LONG), ("f", prose(90) + big[55_000:]), ("f", big)]
    docs = spark.createDataFrame([(*r, [1], "e") for r in data], "doc_id string, text string, starts array<int>, ends string")
    got = Counter((r.doc_id, r.vellum_length, r.vellum_removed, r.vellum_runs, hashlib.sha256(r.vellum_bytes).hexdigest()) for r in S.dedup_substrings(docs).collect())
    assert got == Counter((d, *p) for (d, _), p in zip(data, plain([t for _, t in data]), strict=True))


def test_empty_table(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_suffix_sort():
    for size in (0, 1, 2, 37, 300):
        bodies = [("".join(R.choice("ab") for _ in range(R.randint(0, 40)))).encode() for _ in range(size)]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        length = np.array([len(b) for b in bodies], np.int64)
        start = np.concatenate(([0], np.cumsum(length)))[:-1].astype(np.int64)
        if not size:
            continue
        order, ext = S.sort_suffixes(data, start, length)
        got = [bodies[i] for i in order]
        assert got == sorted(bodies)
        assert ext[1:].tolist() == [S._alike(a, b) for a, b in zip(got, got[1:])]


def test_colliding_hashes_are_seen(monkeypatch):
    monkeypatch.setattr(S.PrefixHashes, "of", lambda self, a, b: (b - a).astype(np.uint64))
    bodies = [prose(30).encode() for _ in range(50)]
    data, length = np.frombuffer(b"".join(bodies), np.uint8), np.full(50, 30)
    order, _ = S.sort_suffixes(data, np.arange(50) * 30, length)
    assert [bodies[i] for i in order] == sorted(bodies)


def test_each_window_has_one_anchor_that_depends_on_it_alone():
    texts = [t.encode() for _, t in rows() if t]
    seen = {}
    text, lo, hi, anchor, *_ = S.anchors(texts)
    n = 0
    for t, a, b, at in zip(text, lo, hi, anchor, strict=True):
        for w in range(a, b + 1):
            n += 1
            assert seen.setdefault(texts[t][w : w + 200], at - w) == at - w
            assert w <= at <= w + 168
    assert n == sum(max(0, len(t) - 199) for t in texts)
