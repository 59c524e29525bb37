from vellum.operators import capture, graph, pdf, search
from vellum.sources import markdown as M

NOTE = """---
title: Durable write path
aliases: [Agent memory]
tags: [Agents, "#retrieval", agents]
when: 2026-01-02
on: yes
owner: {name: Ada, teams: [search]}
relations:
  supports: notes/evidence
  Bad_Name: x
---
# Heading

Prose with [[notes/shared-context]] and [[target|label]] but not `[[code]]`.
```
[[fenced]]
```
    [[indented]]
<!-- [[comment]] --> \\[[escaped]] ![[pic.png]] ![alt](img/a%20b.png)
"""


def parsed(spark, *notes):
    return M.parse_notes(spark.createDataFrame(list(notes), "path string, text string"))


def test_parse_note(spark):
    rows = {r.path: r for r in parsed(spark, ("a/n.md", NOTE), ("b-c.md", "no heading here\n\nsecond"), ("bad.md", "---\nx: 1\nX: 2\n---\n"), ("open.md", "---\nx: 1\n"), ("null.md", None)).collect()}
    n = rows["a/n.md"]
    assert (n.id, n.title, n.tags, n.aliases, n.issue) == ("a/n", "Durable write path", ["agents", "retrieval"], ["Agent memory"], None)
    assert '"when":"2026-01-02"' in n.metadata_json and '"on":"yes"' in n.metadata_json
    assert n.summary.startswith("Prose with notes/shared-context")
    assert rows["b-c.md"].title == "b c" and rows["b-c.md"].summary == "no heading here"
    assert rows["bad.md"].issue == "keys differ only by case" and rows["open.md"].issue == "not closed"


def test_links_relations_attachments(spark):
    p = parsed(spark, ("a/n.md", NOTE)).cache()
    assert [(r.target, r.line, r.embedded) for r in M.wikilinks(p).orderBy("pos").collect()] == [("notes/shared-context", 14, False), ("target", 14, False), ("pic.png", 19, True)]
    assert sorted((r.predicate, r.kind) for r in M.relations(p).collect()) == [("Bad_Name", "malformed"), ("supports", "declared")]
    refs = M.attachments(p)
    files = spark.createDataFrame([("a/img/a b.png",), ("x/Pic.png",), ("y/pic2.png",)], "path string")
    assert sorted((r.target, r.kind, r.file) for r in M.attachment_join(refs, files).collect()) == [("img/a b.png", "resolved", "a/img/a b.png"), ("pic.png", "resolved", "x/Pic.png")]


def test_scan(spark, tmp_path):
    for name, text in {"a.md": "# A", "x/_b.md": "b", ".hidden/c.md": "c", "node_modules/d.md": "d", "x/AGENTS.md": "e", "x/f.txt": "f", "x/g.md": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    notes = {r.path: r for r in M.read_notes(M.scan_markdown_files(spark, str(tmp_path))).collect()}
    assert set(notes) - {"x/_b.md"} == {"a.md", "x/g.md"}
    assert notes["a.md"].text == "# A" and notes["x/g.md"].issue == "not UTF-8"


def test_note_paths(spark):
    paths = spark.createDataFrame([("é.md",), ("é.md",), ("ok/a.md",), ("a/../b.md",)], "path string")
    got = sorted((r.id, r.issue) for r in M.validate_note_paths(paths).collect())
    assert got == sorted([("é", "not canonical"), ("a/../b", "not canonical"), ("é", "collision"), ("é", "collision")])


def test_resolve_links(spark):
    notes = spark.createDataFrame([("a/n", "a/n.md"), ("a/m", "a/m.md"), ("b/m", "b/m.md"), ("c/only", "c/only.md")], "id string, path string")
    raw = [("a/n.md", t, 1, i) for i, t in enumerate(["#top", "c/only", "Only", "m", "./m", "../b/m", "x/y", "nope", "pic.png", "only#x", "c%2Fonly"])]
    got = graph.resolve_links(notes, spark.createDataFrame(raw, "source string, target string, line int, pos int")).orderBy("pos").collect()
    assert [(r.kind, r.target) for r in got] == [("self", "a/n.md"), ("resolved", "c/only.md"), ("resolved", "c/only.md"), ("ambiguous", None), ("resolved", "a/m.md"), ("resolved", "b/m.md"), ("broken", None), ("broken", None), ("attachment", None), ("resolved", "c/only.md"), ("resolved", "c/only.md")]
    assert got[3].candidates == ["a/m.md", "b/m.md"]


def test_replace_catalog():
    s, e = "<!-- catalog:start -->", "<!-- catalog:end -->"
    assert graph.replace_catalog(f"x\n{s}\nold\n{e}\ny", "new", s, e) == f"x\n{s}\nnew\n{e}\ny"


def test_git_log(spark):
    h = "a" * 40
    log = spark.createDataFrame([(f"\x1e{h}\x0086400\x00first\x00\na.md\x00b.md\x00",)], "value string")
    commits, paths = M.parse_git_log(log)
    assert [(r.hash, r.subject) for r in commits.collect()] == [(h, "first")]
    assert [r.path for r in paths.orderBy("pos").collect()] == ["a.md", "b.md"]


def test_captions_and_time_maps(spark):
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\nhello <b>big</b>\n\n00:00:02.500 --> 00:03.000\nbig world\n\n00:04.000 --> 00:05.000\nbig world"
    got = capture.parse_webvtt(spark.createDataFrame([("f", vtt)], "file string, content string")).orderBy("start_ms").collect()
    assert [(r.start_ms, r.text) for r in got] == [(1000, "hello big"), (2500, "world")]
    tm = '<http://e.org/>; rel="original", <http://w/1>; rel="first memento"; datetime="Tue, 02 Jan 2024 03:04:05 GMT"'
    got = capture.parse_timemap(spark.createDataFrame([("f", tm)], "file string, content string")).collect()
    assert [(r.original, r.memento, str(r.taken_at)) for r in got] == [("http://e.org/", "http://w/1", "2024-01-02 03:04:05")]


def test_layout(spark):
    rows = []
    for page in range(1, 6):
        rows += [("d", page, 1000.0, 10.0, 10.0, 50.0, 10.0, 10.0, f"Journal {page}"), ("d", page, 1000.0, 200.0, 10.0, 50.0, 20.0, 20.0, f"Chapter {page}")]
        rows += [("d", page, 1000.0, 250.0 + 12 * i, 10.0 + 60 * j, 50.0, 10.0, 10.0, f"w{i}{j}") for i in range(4) for j in range(3)]
    f = spark.createDataFrame(rows, "document string, page int, page_height double, top double, left double, width double, height double, font_size double, text string")
    lines = pdf.visual_lines(f)
    assert lines.filter("page = 1").count() == 6
    assert [r.margin for r in pdf.margin_repeat(lines).collect()] == ["journal #"]
    text = pdf.markdown(pdf.layout_blocks(lines)).first().text
    assert text.startswith("## Chapter 1\n\nw00 w01 w02 w10") and "Journal" not in text


def test_snippet_and_reconcile(spark):
    text = "x" * 300 + " needle " + "y" * 900
    s = spark.createDataFrame([(text,)], "t string")
    got = s.select(search.exact_snippet(s["t"], "needle", []).alias("s")).first().s
    assert got.startswith("…x") and got.endswith("y…") and "needle" in got and len(got) == 602
