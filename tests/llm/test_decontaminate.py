import random
from collections import Counter

import duckdb
import pytest

from vellum.llm import decontaminate as D

R = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40


def some(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(some(n))) for i, n in enumerate([8, 12, 20, 25, 30, 45, 60, 33, 3, 5])] + [(10, None), (11, " "), (12, "alone")]


def documents():
    out = []
    for i in range(120):
        words = some(R.randint(0, 300))
        if i % 3 == 0:
            item = ITEMS[i % 10][1].split()
            for _ in range(i % 4):
                item[R.randrange(len(item))] = "changed"
            at = R.randint(0, len(words))
            words[at:at] = item
        out.append((i, " ".join(words).upper() if i % 5 == 0 else "\n".join(words)))
    return [*out, (500, None), (501, ""), (502, "x alone y"), (502, "x alone y"), (None, ITEMS[3][1]), (503, "long " * 30_000 + ITEMS[6][1])]


def plain(text, items):
    """Every passage against every item, by shingles alone."""
    step = max(len((t or "").split()) for _, t in items)
    words = (text or "").lower().split()
    out = set()
    for i, t in items:
        item = (t or "").split()
        if not item:
            continue
        cut = max(1, 2 * len(item) // 3)
        parts = [item, item[:cut], item[cut:]] if len(item) - cut >= D.SIZE else [item] * 3
        for s in range(0, max(1, len(words) - step), step):
            own = D.windows(words[s : s + 2 * step], min(D.SIZE, len(item)))
            whole, q, a = (len(own & D.shingles(p)) / len(D.shingles(p)) for p in parts)
            if whole >= 0.8 - 1e-9 and q >= 0.5 and a >= 0.5:
                out.add(i)
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 70])
def test_against_plain(spark, block_words):
    rows = documents()
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id bigint, text string, doc_id string")
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int")
    got = Counter((r.doc_id, r.item_id) for r in D.leaks(docs, items, block_words=block_words).collect())
    want = Counter((d, i) for d, t in rows for i in plain(t, ITEMS))
    assert len(want) > 15 and want[502, 12] == 2
    assert got == want


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 70])
def test_against_sql(spark, block_words):
    docs, items = [(d, t) for d, t in dict(documents()).items() if d is not None], [*ITEMS, (13, "of the")]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", items)
    want = con.sql(D.SQL)
    at = {c: i for i, c in enumerate(want.columns)}
    rows = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words).collect()
    got = sorted((r.doc_id, r.item_id, round(r.vellum_overlap, 6), round(r.vellum_question, 6), round(r.vellum_answer, 6)) for r in rows)
    assert got == sorted(tuple(r[at[c]] for c in ("doc_id", "item_id", "overlap", "question_overlap", "answer_overlap")) for r in want.fetchall())


def test_wand_returns_all_above_the_threshold():
    items = [(i, " ".join(some(20)).encode()) for i in range(400)]
    frequency = Counter(w for _, t in items for w in set(t.split()))
    index = D.Index(items, frequency, len(items), 20.0, 20)
    for _ in range(100):
        query = {index.number[w.encode()] for w in some(40) if w.encode() in index.number}
        scores = Counter()
        for (t, _), posting in index.postings.items():
            if t in query:
                for d, x in zip(*posting, strict=True):
                    scores[d] += x
        for threshold in (0.3, 0.6, 1.0):
            got = dict(index.search(query, threshold))
            assert set(got) == {d for d, s in scores.items() if s >= threshold}
            assert all(abs(got[d] - scores[d]) < 1e-9 for d in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert D.leaks(docs, items.limit(0)).count() == 0
    assert D.leaks(docs.limit(0), items).count() == 0
    assert D.leaks(docs, items).count() == 1
