import random

import pytest

from vellum.operators import mentions as M

WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
TEXTS = [(1, "see fooé here"), (2, "caféb x"), (3, "Foo bar\nline two FOO  bar"), (4, "xfoo foox 1foo"), (5, None), (6, ""), (7, "ΑΣ and ΑΣΒ"), (8, "İstanbul\nfoo"), (9, "(foo)\n\n[b x]"), (10, "a+b? .*\\E [x]"), (11, "\U0001f600foo\U0001f600"), (1, "foo again, a repeated id")]
PHRASES = ["foo", "b x", "foo bar", "FOO  bar", "ΑΣ", "a+b?", ".*\\E", "[x]", "oo", "é", "nowhere", "\n"]


def first(text, phrase, whole):
    at = text.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        before, after = text[at - 1 : at], text[end : end + 1]
        if not whole or not (phrase[0] in WORD and before and before in WORD) and not (phrase[-1] in WORD and after and after in WORD):
            return at
        at = text.find(phrase, at + 1)
    return -1


def plain(texts, phrases, fold=True, whole=True):
    out = []
    for i, t in texts:
        for p in {p.lower() if fold else p for p in phrases}:
            u = (t or "").lower() if fold else t or ""
            at = first(u, p, whole) if p else -1
            if at >= 0:
                out.append((i, p, at, t.count("\n", 0, at) + 1))
    return sorted(out)


@pytest.mark.parametrize("block", [M.BLOCK, 12])
@pytest.mark.parametrize("fold, whole", [(True, True), (False, False)])
def test_occurrences(spark, block, fold, whole):
    texts = spark.createDataFrame(TEXTS, "id int, content string")
    phrases = spark.createDataFrame([(p,) for p in [*PHRASES, "Foo", "", None]], "phrase string")
    got = M.occurrences(texts, phrases, fold, whole, block)
    assert sorted(map(tuple, got.collect())) == plain(TEXTS, PHRASES + ["Foo"], fold, whole)


def test_occurrences_of_random_phrases(spark):
    r = random.Random(2)
    texts = [(i, "".join(r.choice("ab é\n-") for _ in range(60))) for i in range(80)]
    phrases = sorted({"".join(r.choice("ab é-") for _ in range(r.randrange(1, 5))) for _ in range(150)})
    got = M.occurrences(spark.createDataFrame(texts, "id int, content string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), block=200)
    assert sorted(map(tuple, got.collect())) == plain(texts, phrases)
    none = spark.createDataFrame([], "phrase string")
    assert M.occurrences(spark.createDataFrame(texts, "id int, content string"), none).count() == 0


def test_candidate_phrases(spark):
    notes = spark.createDataFrame([("a", " Long title ", ["abc", "abcd", "1234", "\U0001f600\U0001f600x"]), ("b", None, None), ("c", "﻿Title", ["Title"])], "id string, title string, aliases array<string>")
    assert sorted(map(tuple, M.candidate_phrases(notes).collect())) == [("a", "Long title"), ("a", "abcd"), ("a", "\U0001f600\U0001f600x"), ("c", "Title")]


def test_mentions_and_their_support(spark):
    notes = spark.createDataFrame([("n1", "x\nUser Guide and guide, Shared"), ("n2", "the USER GUIDE\nguide"), ("n3", "guide"), ("t", "guide n-three")], "id string, content string")
    phrases = spark.createDataFrame([("t", "guide"), ("t", "User Guide"), ("n3", "Shared"), ("n2", "shared"), ("n3", "n-three")], "target string, phrase string")
    linked = spark.createDataFrame([("t", "n3")], "source string, target string")
    got = M.mention_pairs(notes, phrases, linked)
    assert sorted(map(tuple, got.collect())) == [("n1", "t", "user guide", 2, 2), ("n2", "t", "user guide", 4, 1)]
    many = spark.createDataFrame([("s", "t", i % 7, f"p{i}") for i in range(30)] + [("t", "s", 1, "back"), ("u", "v", 1, "linked")], "source string, target string, line bigint, phrase string")
    out = {(r.source, r.target): r for r in M.mention_support(many, spark.createDataFrame([("v", "u")], "source string, target string"), pieces=4).collect()}
    assert sorted(out) == [("s", "t"), ("t", "s")]
    hot = out["s", "t"]
    assert hot.support == 30 and hot.truncated and [tuple(e) for e in hot.evidence] == [(0, "p0"), (0, "p14"), (0, "p21"), (0, "p28")]
    assert not out["t", "s"].truncated
    assert M.mention_support(many, many.limit(0), least=2).count() == 1


def test_judgments_inside_words_and_across_blanks(spark):
    texts = spark.createDataFrame([(1, "a (foo bar) z"), (2, "ok foo bar ok"), (3, "xfoo barx"), (4, "foo  bar"), (5, None)], "id int, content string")
    items = spark.createDataFrame([(7, "foo bar"), (8, "foo bar"), (9, "z"), (10, None)], "item_id int, text string")
    assert sorted(map(tuple, M.judgments(texts, items).collect())) == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (3, 7), (3, 8)]
