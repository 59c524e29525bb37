import math
import random

import numpy as np
import pytest

from vellum.llm import hard_negatives as H

R = random.Random(5)


def plain(rows, positives=5, negatives=10, low=30, high=90):
    ok = []
    for uid, (vec_id, label, v) in enumerate(rows):
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        ok.append((uid, vec_id, label, [max(-H.LARGEST, min(H.LARGEST, math.floor(256 * x))) for x in v]))
    out = []
    for uid, vec_id, label, a in ok:
        if vec_id % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, u, k) for u, i, k, v in ok if u != uid)
        for p, pid, _, _ in [s for s in scored if s[3] == label][:positives]:
            fits = [s for s in scored if s[3] != label and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(vec_id, pid, r, s[1], -p, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, dims=12, scale=1.0, ids=lambda i: i):
    centre = [[R.gauss(0, scale) for _ in range(dims)] for _ in range(3)]
    return [(ids(i), R.randrange(4), [R.gauss(0, scale / 2) + c for c in R.choice(centre)]) for i in range(n)]


CASES = {
    "plain": vectors(500),
    "large": vectors(210, scale=3e3),
    "larger than held": vectors(210, scale=1e9),
    "copies": vectors(150) + [(1000 + i, i % 3, [0.5] * 12) for i in range(400)],
    "repeated": vectors(120, ids=lambda i: i // 2 * 50),
    "ragged": [(i, i % 2, [R.gauss(0, 1)] * R.randrange(5)) for i in range(250)],
    "zeros": [(i, i % 2, [0.0] * 3) for i in range(130)],
    "odd": vectors(105) + [(200, None, [1.0]), (None, 1, [1.0]), (300, 1, None), (400, 1, [1.0, None]), (500, 1, [float("nan")]), (600, 2, [float("inf")]), (700, 3, []), (-100, -3, [0.3] * 12)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_plain(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, label int, embedding array<double>, score string, uid int")
    small = name in ("plain", "copies")
    got = H.hard_negatives(H.relabelled(df), block=2 if small else H.BLOCK, cell=40 if small else H.CELL)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_planes_drop_pairs_and_sums_are_exact(monkeypatch):
    """Chunk by chunk, with all three kinds of sums, against whole products."""
    monkeypatch.setattr(H, "ROWS", 64)
    for kind, size in ((np.float32, 100), (np.float64, 10**6), (np.int64, 1 << 22)):
        rng = np.random.default_rng(3)
        a, v = rng.integers(-size, size, (7, 700)), rng.integers(-size, size, (500, 700))
        if kind != np.int64:
            a, v = a[:, :20], v[:, :20]
        assert H.exact_kind(a, v) == kind
        k = np.dtype(kind)
        whole = a @ v.T
        low = np.sort(whole, axis=1)[:, [50, 400]].astype(k)
        judge = H.Windows(low, np.sort(whole, axis=1)[:, [90, 499]].astype(k), 4)
        left = 0
        for at in range(0, 500, 64):
            i, j, s = H.sliced(a, v[at : at + 64], np.ones((7, len(v[at : at + 64])), bool), judge, k)
            assert (s.astype(np.int64) == whole[i, j + at]).all()
            left += len(i)
            for w in range(2):
                inside = (s >= judge.low[i, w]) & (s <= judge.high[i, w])
                judge.raise_to(w, i[inside], s[inside])
        assert left < 7 * 500 / 4
        assert (judge.floor >= low).all()
