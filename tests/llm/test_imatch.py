import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.llm import imatch as M

R = random.Random(9)
POOL = [f"w{i}" for i in range(400)]


def words(text):
    return set(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()))


def printed(text, lexicon):
    found = sorted(words(text), key=str.encode)
    out = []
    for k in range(32):
        at, limit = 3 * (k // 4), M.LIMITS[k % 4]
        held = [w for w in found if w in lexicon and hashlib.sha256(w.encode()).hexdigest()[at : at + 3] < limit]
        out.append(hashlib.md5(" ".join(held).encode()).hexdigest()[:8] if held else "0" * 8)
    return out if set(out) != {"0" * 8} else [hashlib.md5(("-" + " ".join(found)).encode()).hexdigest()[:8]] * 32


def alike(a, b):
    families = [[x == y for x, y in zip(a[i : i + 4], b[i : i + 4], strict=True) if {x, y} != {"0" * 8}] for i in range(0, 32, 4)]
    judged = [f[0] for f in families if f]
    return sum(judged) / len(judged)


def plain(rows, band):
    texts = [t or "" for _, t in rows]
    df = {}
    for t in texts:
        for w in words(t):
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    lexicon = {w for w, c in df.items() if max(2, math.ceil(n * math.exp(-band[1]))) <= c <= math.floor(n * math.exp(-band[0]))}
    key = lambda i: -(1 << 63) if i is None else i
    ids = sorted({key(i) for i, _ in rows}, reverse=True)
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        following = ids[(ids.index(key(i)) + 1) % len(ids)]
        longest = max(len(u) // 3 for (j, _), u in zip(rows, texts, strict=True) if key(j) == key(i))
        start, fp = min((u[:longest], printed(u, lexicon)) for (j, _), u in zip(rows, texts, strict=True) if key(j) == following)
        k = len(t) // 3
        edited = t[: len(t) - k] + start[:k]
        own, other = printed(t, lexicon), printed(edited, lexicon)
        out.append((str(i), len(t), edited, "".join(own), "".join(other), alike(own, other), alike(own, fp)))
    return sorted(out)


def some(n, ids=lambda i: 3 * i):
    return [(ids(i), " ".join(R.choice(POOL) for _ in range(R.randrange(1, 120)))) for i in range(n)]


CASES = {
    "plain": some(60),
    "copies and repeated ids": some(12, ids=lambda i: i // 3) + [(100 + i, "W1 w2\tw3 w4 w5") for i in range(40)],
    "odd": [(None, "w1 \U0001f600 é w2 W2"), (1, None), (2, ""), (3, " \n\t"), (4, "only"), (5, "w1 w2 é " * 3000), (-7, "w1 w2 it's \\ 'quoted' %")],
    "one": [(1, "alone here")],
    "same id": [(1, "b"), (1, "a"), (1, None)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_plain(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id bigint, text string, key string, k int")
    got = M.edited_likeness(docs, band=(0.3, 6.9)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == plain(rows, (0.3, 6.9))


def test_equal_texts_have_equal_fingerprints_and_edits_are_told_from_strangers(spark):
    base = [" ".join(f"t{R.randrange(3000)}" for _ in range(150)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base)], "doc_id bigint, text string")
    out = M.edited_likeness(docs, band=(2.0, 6.9)).collect()
    assert sum(r.near_edited for r in out) > 0.25 * len(out) and sum(r.near_next for r in out) < 0.02 * len(out)
    twice = M.fingerprint(docs.union(docs), M.lexicon(docs), "vellum_imatch").groupBy("doc_id").agg(F.countDistinct("vellum_imatch").alias("n")).agg(F.max("n")).first()
    assert twice[0] == 1


def test_empty_table_and_too_large_a_lexicon(spark, monkeypatch):
    assert M.edited_likeness(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    monkeypatch.setattr(M, "LARGEST", 1)
    with pytest.raises(ValueError, match="band"):
        M._buckets(spark.range(2).withColumnRenamed("id", "h"))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = M.edited_likeness(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
