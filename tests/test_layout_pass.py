"""Layout XML is parsed in one pass, with every issue of a document and the fonts of its earlier pages."""

import os

import pytest

from vellum.operators import pdf as P
from vellum.plans import queries as Q

FOLDER = os.environ.get("VELLUM_TABLES", "/root/testdata/sf0.001")
PAGE = '<page number="{}" height="9" width="9">'
TEXT = '<text top="{}" left="1" width="1" height="3" font="f">x &#38;&#x41; &#0; &lt;</text>'


def test_each_frame_reads_the_files_once(spark):
    files = spark.range(3).selectExpr("concat('d', id) AS document", f"concat('{PAGE.format(1)}', repeat('{TEXT.format(1)}', int(id)), '</page>') AS xml")
    frames = P.parse_layout_xml(files)
    assert [f._jdf.queryExecution().optimizedPlan().toString().count("Range (") for f in frames] == [1, 1, 1]
    assert [f.count() for f in frames] == [3, 0, 0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_the_query_reads_its_table_once(spark):
    plan = Q.QUERIES["parse_poppler_xml"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_issues_and_fonts_of_whole_documents(spark):
    size = '<fontspec id="f" size="{}"/>'
    rows = {
        "both": PAGE.format(1) + TEXT.format("-1") + "</page>" + PAGE.format(2),
        "pageless font": PAGE.format(1) + '<fontspec id="f" size="-2"/></page>',
        "empty page": PAGE.format(1) + "</page>",
        "late": PAGE.format(1) + TEXT.format(1) + size.format(5) + TEXT.format(2) + "</page>" + PAGE.format(2) + TEXT.format(3) + size.format(7) + TEXT.format(4) + "</page>",
    }
    fragments, _, issues = P.parse_layout_xml(spark.createDataFrame([*rows.items()], "document string, xml string"))
    assert sorted(map(tuple, issues.collect())) == [("both", "number"), ("both", "open-page"), ("pageless font", "number")]
    assert [(r.document, r.top, r.font_size, r.text) for r in fragments.orderBy("top").collect()] == [("late", float(t), s, "x &A &#0; <") for t, s in ((1, 3.0), (2, 5.0), (3, 5.0), (4, 7.0))]
