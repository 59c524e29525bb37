import random

import pytest

from vellum.llm import near_copies, simhash


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b)


def planted():
    """Texts, near copies of them at many similarities, and copies in other case."""
    r = random.Random(3)
    rows = []
    for _ in range(30):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([3, 30, 200, 300]))]
        rows.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6):
            near = list(base)
            for _ in range(changes):
                near[r.randrange(len(near))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(near))
        rows.append(" ".join(base).upper())
    return list(enumerate(rows))


def plain_kept(rows):
    low = {i: i for i, _ in rows}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, t in rows:
        for j, u in rows[:i]:
            if jaccard(t, u) >= 0.8:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return sorted(i for i, _ in rows if find(i) == i)


def test_stage_removes_all_near_copies(spark):
    rows = planted()
    between = [jaccard(rows[i][1], rows[j][1]) for i in range(0, 210, 7) for j in range(i + 1, i + 6)]
    assert sum(0.8 <= j < 0.95 for j in between) > 20 and sum(0.5 < j < 0.8 for j in between) > 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == plain_kept(rows)


@pytest.mark.parametrize("sample", [1, 64])
def test_large_groups_against_all_pairs(spark, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = {r.doc_id: bytes(r.key) for r in near_copies.keyed(docs).collect()}
    root = {bytes(r.key): bytes(r.root) for r in near_copies.near_copies(docs, simhash.components, small=2).collect()}
    classes = {}
    for i, _ in rows:
        classes.setdefault(root.get(key[i], key[i]), i)
    assert sorted(classes.values()) == plain_kept(rows)


def test_stage_links_by_fingerprints_first(spark, monkeypatch):
    """The trie join gets five-word fingerprints and gives pairs within its budget; what it finds is not looked for again."""
    seen = []

    def watched(fps, budget=simhash.BUDGET, hot=simhash.HOT, near=False):
        out = [(r.a, r.b) for r in real(fps, budget, hot, near).collect()]
        seen.append(([r.fp for r in fps.collect()], out, budget))
        return spark.createDataFrame(out, "a bigint, b bigint")

    real = simhash.links
    monkeypatch.setattr(simhash, "links", watched)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == plain_kept(rows)
    ((fps, pairs, budget),) = seen
    plain = {simhash.fingerprint(t.encode(), 5) for _, t in rows}
    assert {f & (2**64 - 1) for f in fps} == plain
    assert pairs and all(bin((a ^ b) & (2**64 - 1)).count("1") <= budget for a, b in pairs)
    again = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda texts, p: again.append(p.count()) or verified(texts, p))
    near_copies.near_copies(docs, simhash.components).count()
    near_copies.near_copies(docs, simhash.components, links=lambda f: real(f, simhash.NEAR, near=True)).count()
    alone, first, rest = again
    assert first >= len(pairs) and rest < alone
