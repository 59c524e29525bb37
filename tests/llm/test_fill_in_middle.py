import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vellum.llm import fill_in_middle as M

TEXTS = [None, "", "\n", "a", "a\nb\nc\nd\ne\nf\n", "é\r\nü x\n\n\n<", "<P", "S>\nM>\n<S\n<P\n", "has <M> inside", "<", "x\n" * 50_000, "no end " * 3000, "\U0001f600\n\U0001f600z\n" * 9]


def plain(i, t):
    t = t or ""
    h = hashlib.sha256(f"7:{i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or re.search("<[PSM]>", t):
        return len(units), "plain", None, None, t
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_plain(spark):
    rows = [(40 * k + i, t) for k in range(8) for i, t in enumerate(TEXTS)]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, output string").repartition(5)
    out = M.fill_in_middle(docs).withColumn("back", M.restored(F.col("vellum_output"), F.col("vellum_form"))).collect()
    assert len(out) == len(rows) and {r.vellum_form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        want = plain(r.doc_id, r.text)
        assert (r.vellum_n, r.vellum_form, r.vellum_prefix_chars, r.vellum_middle_chars, r.vellum_output) == want
        assert r.vellum_output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert r.back.text == (r.text or "") and r.back.sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_null_id_share_and_units(spark):
    docs = spark.createDataFrame([(None, "a b c"), *((i, "one two three four") for i in range(200))], "doc_id bigint, text string")
    out = M.fill_in_middle(docs, pattern=r"\S+\s*|\s+", share=30, spm=100).collect()
    forms = [r.vellum_form for r in out]
    assert {*forms} == {"plain", "spm"} and 30 < forms.count("spm") < 90
    assert {r.vellum_n for r in out} == {3, 4}


def test_restore_of_what_was_never_made():
    assert M.restore("abc", "psm", M.MARKS) is None and M.restore("<P>abc", "psm", M.MARKS) is None and M.restore("<P>a<S>b", "psm", M.MARKS) is None
    assert M.restore(None, "spm", M.MARKS) is None and M.restore("x", None, M.MARKS) is None and M.restore(None, "plain", M.MARKS) == ""


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aa", "b", "c"), ("xy", "yz", "q")])
def test_marks_that_could_be_misread(marks):
    with pytest.raises(ValueError):
        M._checked(marks)


def test_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
