import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.operators import snippets as S


@pytest.mark.parametrize(
    "text, phrase, terms, want",
    [
        ("one\ntwo Café here", "café", [], (2, 8)),
        ("ééé x needle", "needle", [], (1, 9)),
        ("İstanbul ve needle", "needle", [], (1, 12)),
        ("a\r\nb\n\nsecond TERM", "no such", ["term"], (4, 13)),
        ("ab", "ab", [], (1, 0)),
        ("later term, first other", "none", ["other", "term"], (1, 18)),
        ("\U0001f468‍\U0001f469‍\U0001f467 family", "family", [], (1, 6)),
        ("nothing", "phrase", ["term"], None),
        ("", "x", [], None),
    ],
)
def test_first_match(text, phrase, terms, want):
    assert S.first_match(text, phrase, terms) == want


def test_written_places_against_folding_of_prefixes():
    """The text before the place, folded, is as long as the folded place, but for graphemes that fold to several characters."""
    r = random.Random(8)
    for _ in range(400):
        line = "".join(r.choice(["a", "B", "é", "É", "ộ", " ", "\U0001f600", "ss"]) for _ in range(30))
        place = r.randrange(len(S.folded(line)))
        at = S.written_offset(line, place)
        assert len(S.folded(line[:at])) <= place < len(S.folded(line[: at + max(len(m) for m in S._GRAPHEMES.findall(line))]))
        assert unicodedata.combining(line[at]) == 0


def test_column(spark):
    long = "x " * 300 + "needle\n\tin   a haystack " + "y " * 500
    rows = [(1, long, "s1"), (2, "no match", "s2"), (3, None, "s3"), (4, "Needle", None), (5, "é NEEDLE　end", "s5")]
    out = spark.createDataFrame(rows, "id int, text string, summary string").withColumn("m", S.exact_match(F.col("text"), "needle", ["haystack"], F.col("summary")))
    got = {r.id: (r.m.line, r.m.offset, r.m.snippet) for r in out.collect()}
    assert got[1] == (1, 600, "…" + " ".join(long[420:1020].split()) + "…")
    assert got[2] == (None, None, "s2") and got[3] == (None, None, "s3") and got[4] == (1, 0, "Needle") and got[5] == (1, 3, "é NEEDLE end")
