import numpy as np
import pytest
import xxhash

from vellum.llm import simhash


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, budget=2):
    """Smallest id reached, by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= budget:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(rows))]


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, a string, vellum_x int")
    got = sorted((str(r[0]), r[1] & (2**64 - 1), str(r[2])) for r in simhash.near_duplicates(df, **how).collect())
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = sorted((str(d), f, str(c)) for (d, f), c in zip(fps, plain_classes(fps), strict=True))
    assert got == want


def test_texts(spark):
    base = [f"word{i} Thé x{i % 7}" for i in range(40)]
    rows = [(i, " ".join(base[: 20 + i % 5]), None, 1) for i in range(12)]
    rows += [(100, None, "a", 1), (101, "", "a", 1), (102, " \t\n", "a", 1), (103, "ONE", "a", 1), (104, "one", None, None), (104, "one", None, None), (None, "one", "b", 2), (105, "a b", "c", 3), (106, "x " * 30000, "d", 4)]
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(df).count() == 0


@pytest.mark.parametrize("hot", [200_000, 20])
def test_links_against_all_pairs(spark, hot):
    rng = np.random.default_rng(1)
    centres = [int(x) for x in rng.integers(0, 2**63, 6)]
    fps = sorted({c ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (25, 2))} | {int(x) for x in rng.integers(0, 2**63, 50)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {r.v: r.root for r in simhash.components(simhash.links(df, hot=hot)).collect()}
    classes = plain_classes(list(zip(signed, fps, strict=True)))
    assert {s: got.get(s, s) for s in signed} == dict(zip(signed, classes, strict=True))


def test_stage_keeps_one_of_each_class(spark):
    df = spark.createDataFrame([(1, "a b c d e", "en"), (2, "a b c d e", "en"), (3, "quite another text here", "en"), (None, "a b c d e", "en")], "doc_id bigint, text string, lang string")
    assert sorted(str(r.doc_id) for r in simhash.stage(spark, df, "").collect()) == ["1", "3", "None"]


def test_one_branch_whatever_the_budget(spark):
    """The driver plans and compiles one branch for all blocks of all ways, where it had one for each (16 with a budget of 3)."""
    df = spark.createDataFrame([(1,), (2,)], "fp bigint")
    plans = [simhash.links(df, budget)._jdf.queryExecution().optimizedPlan().toString() for budget in (2, 5)]
    assert [(p.count("Union"), p.count("Generate"), p.count("Aggregate")) for p in plans] == [(0, 3, 2)] * 2


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_links_of_split_groups_with_other_budgets(spark, budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(-(1 << 63), 1 << 63, 30, dtype=np.int64).view(np.uint64)
    values = {int(x) for x in base} | {int(x) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for x in base for d in (1, 2, 3)}
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in values], "fp bigint")
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= budget}
    for hot in (0, 2, 1000):
        got = {tuple(sorted(int(np.int64(x).view(np.uint64)) for x in r)) for r in simhash.links(df, budget, hot=hot, near=True).collect()}
        assert got <= want

        def classes(edges):
            low = {x: x for x in values}
            for _ in range(len(values)):
                moved = [(a, b) for a, b in edges if low[a] != low[b]]
                for a, b in moved:
                    low[a] = low[b] = min(low[a], low[b])
                if not moved:
                    return low

        assert classes(got) == classes(want)
