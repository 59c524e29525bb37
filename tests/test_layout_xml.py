from vellum.operators import pdf as P

GOOD = """<?xml version="1.0"?><pdf2xml producer="poppler" version="24.1">
<page number="1" position="absolute" top="0" left="0" height="1200" width="900">
<fontspec id="0" size="16" family="T" color="#000"/><fontspec id="1" size="9" family="T"/>
<text top="100" left="50" width="200" height="18" font="0"><b>Head &amp; &#60;all&#x3e; &#128512;</b></text>
<image top="5" left="6" width="7" height="8" src="p-1_1.png"/>
<text top="130" left="50" width="200" height="11" font="1">one
 <I class="x">two</I> &lt;b&gt;</text>
<text top="150" left="50" width="20" height="11" font="9">no font &#xD800;</text>
</page>
<page number="2" height="1200" width="900"><fontspec id="1" size="10" family="T"/>
<text top="1" left="2" width="3" height="4" font="1"></text><image top="1" left="1" width="1" height="1"/>
</page></pdf2xml>"""


def test_fragments_images_and_issues(spark):
    page = '<page number="1" height="9" width="9">'
    text = '<text top="{}" left="1" width="1" height="1" font="0">x</text></page>'
    bad = {"none": "<pdf2xml/>", "null": None, "nested": f"{page}{page}</page>", "open": f"{page}</page>{page}", "negative": page + text.format("-1"), "word": page + text.format("x"), "unnumbered": '<page height="9" width="9"></page>'}
    fragments, images, issues = P.parse_layout_xml(spark.createDataFrame([("good", GOOD), *bad.items()], "document string, xml string"))
    rows = fragments.orderBy("page", "place").collect()
    assert {r.document for r in rows} == {"good"}
    assert [(r.page, r.text, r.font_size, r.bold, r.italic, r.page_height) for r in rows] == [(1, "Head & <all> \U0001f600", 16.0, True, False, 1200.0), (1, "one\n two <b>", 9.0, False, True, 1200.0), (1, "no font &#xD800;", 11.0, False, False, 1200.0), (2, "", 10.0, False, False, 1200.0)]
    assert [tuple(r)[1:] for r in images.collect()] == [(1, 3, 5.0, 6.0, 7.0, 8.0, "p-1_1.png")]
    assert {(r.document, r.code) for r in issues.collect()} == {("none", "no-pages"), ("null", "no-pages"), ("nested", "open-page"), ("open", "open-page"), ("negative", "number"), ("word", "number"), ("unnumbered", "number")}
    lines = P.visual_lines(fragments).orderBy("page", "top").collect()
    assert [r.text for r in lines] == ["Head & <all> \U0001f600", "one two <b>", "no font &#xD800;", ""]
