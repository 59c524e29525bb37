import re
from math import comb

import duckdb
import pytest

from vellum.llm import quality_rules as Q


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + o for i, x in enumerate(windows) if seen[x] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "one", "a b c", "a b c a b c", "x x x x", "é ü\u00a0ö ñ | # é ü\u00a0ö ñ | #", "line one\nline one\n\n\n line one\nline two", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 90}" for i in range(4000)), "a\r\nb\x0bc\x0cd " * 30, " ".join(f"w{i % 5} v{i % 7}" for i in range(200)), "x" * 150_000]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, rule int")
    got = {r.doc_id: (r.vellum_words, r.vellum_word_chars, r.vellum_symbols, r.vellum_dup_lines, r.vellum_repeat_words) for r in Q.statistics(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_cutoffs_hold_the_risk(spark):
    """The chosen cutoff is the lowest whose exact binomial bound holds; strata are apart."""
    rows = [("en", 0.001 * (i % 20)) for i in range(6000)] + [("en", 0.9)] * 20 + [("fr", 0.0)] * 50
    data = spark.createDataFrame([(s, v, 0.0, 0.0, 0.0, 0.0) for s, v in rows], "vellum_stratum string, " + ", ".join(f"{r} double" for r in Q.RULES))
    safe = Q.cutoffs(data)
    share, level = 0.05 / 5, 0.05 / (5 * 5)
    good = [v for s, v in rows if s == "en"]

    def bound(c):
        k = sum(v > c for v in good)
        return sum(comb(len(good), i) * share**i * (1 - share) ** (len(good) - i) for i in range(k + 1)) <= level

    want = min(c for c in Q.GRID if all(bound(x) for x in Q.GRID if x >= c))
    assert safe["en", "symbols_per_word"] == want
    assert not any(s == "fr" for s, _ in safe)


def test_every_stratum_can_reject(spark, tmp_path):
    """With 640 good documents in each language, documents full of symbols are rejected in each; also in SQL."""
    plain_text = " ".join(f"w{i}" for i in range(60))
    rows = [(1000 * s + i, plain_text + f" x{i}", lang) for s, lang in enumerate([*Q.STRATA, "xx"]) for i in range(640)]
    rows += [(1000 * s + 900, " ".join(f"w{i} |" for i in range(60)), lang) for s, lang in enumerate([*Q.STRATA, "xx"])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1) for d, _, _ in rows if d % 1000 < 640], "doc_id bigint, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    out = Q.query(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()))
    assert [r[0] for r in got if not r[-1]] == [900, 1900, 2900, 3900, 4900]
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(Q.SQL)
    at = [want.columns.index(c) for c in out.columns]
    assert got == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "word " * 80, "xx")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    assert sorted((str(r.doc_id), r.vellum_kept) for r in Q.rule_documents(docs, labels).collect()) == [("1", False), ("1", False), ("None", False)]
    assert Q.rule_documents(docs.limit(0), labels.limit(0)).count() == 0
