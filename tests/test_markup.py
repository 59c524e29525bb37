from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators import markup as M


@pytest.mark.parametrize(
    "html, want",
    [
        ('<a/onclick=alert(1) href="x">t</a>', "<a>t</a>"),
        ('<img srcset="a 1x" src=b.png alt=\'q"q\' onerror=x>', '<img data-captured-src="b.png" alt="q&quot;q">'),
        ('<video poster=p><p>in</video>out', "out"),
        ('<p CLASS=a style="x" aria-Label="l" hidden open>', '<p class="a" aria-label="l" open>'),
        ('<a href="java\nscript:x">a</a><a href=" DATA:x">b</a><a href="HTTPS://u:p@h/x">c</a>', '<a>a</a><a>b</a><a data-captured-href="HTTPS://h/x">c</a>'),
        ("<script>if (a < b) '</scrip'</SCRIPT >tail", "tail"),
        ("<script>never ends", ""),
        ("<svg/>x<style/>y", "xy"),
        ("</iframe>x</br></p>", "x</p>"),
        ("a <!-- b --> c <!-- d", "a  c "),
        ('1 < 2 <b title="x>y">3</b>', "1 3</b>"),
        ("<custom-x on=1>t</custom-x><blink>u", "tu"),
        ('<b title="never ends', '&lt;b title="never ends'),
        ("<p a=1 / title=2>", "<p>"),
        ("<<b>>", "&gt;".replace("&gt;", ">")),
        ("", ""),
    ],
)
def test_cases(html, want):
    assert M.inert(html) == want


class Seen(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.tags, self.names = set(), set()

    def handle_starttag(self, tag, attrs):
        self.tags.add(tag)
        self.names |= {a for a, _ in attrs}


PIECES = st.sampled_from(["<", ">", "</", "/", "=", '"', "'", " ", "\n", "<!--", "-->", "script", "<script>", "</script>", "<a ", "href", "onclick", "src=", "javascript:", "x", "<img", "<p>", "</p>", "<svg", "style", "&", "é", "<iframe", "srcdoc=", "<b", "aria-x", "\x00"])


@settings(max_examples=600, deadline=None, database=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_whatever_comes_out_is_listed(html):
    seen = Seen()
    out = M.inert(html)
    seen.feed(out)
    seen.close()
    assert seen.tags <= M.KEPT
    assert all(n in M.ATTRIBUTES or n.startswith(("aria-", "data-captured-")) for n in seen.names)


def test_column(spark):
    out = [r[0] for r in spark.createDataFrame([("<p>x</p><form>y</form>",), (None,)], "h string").select(M.evidence(F.col("h"))).collect()]
    assert out[1] is None and out[0].endswith('<main data-captured-source="true"><p>x</p></main></body></html>\n') and "default-src 'none'" in out[0]
