"""PDF text geometry as windows: visual lines, body font, repeated margins, paragraphs, Markdown.

``fragments`` has document, page, page_height, top, left, width, height, font_size, text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def visual_lines(fragments: DataFrame, tolerance: float = 0.5, gap: float = 3.0) -> DataFrame:
    """One row a visual line: fragments whose tops differ by less than a share of their height, cut at wide gaps."""
    by_top = W.partitionBy("document", "page").orderBy("top", "left")
    rows = fragments.withColumn("new", F.coalesce((F.col("top") - F.lag("top").over(by_top) > tolerance * F.col("height")).cast("int"), F.lit(1)))
    rows = rows.withColumn("row", F.sum("new").over(by_top.rowsBetween(W.unboundedPreceding, 0)))
    across = W.partitionBy("document", "page", "row").orderBy("left")
    right = F.max(F.col("left") + F.col("width")).over(across.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("cut", F.coalesce((F.col("left") - right > gap * F.col("font_size")).cast("int"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("cut").over(across.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("document", "page", "row", "part").agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max("height").alias("height"), F.max("font_size").alias("font_size"), F.first("page_height").alias("page_height"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def font_mode(lines: DataFrame) -> DataFrame:
    """document, body: the rounded font size that holds most text, the smaller of equals."""
    sizes = lines.groupBy("document", F.round("font_size").alias("size")).agg(F.sum(F.length("text")).alias("weight"))
    return sizes.groupBy("document").agg(F.max_by("size", F.struct("weight", -F.col("size"))).alias("body"))


def margin_repeat(lines: DataFrame, band: float = 0.06, least: int = 3, share: float = 0.4) -> DataFrame:
    """document, margin: texts, numbers aside, in the top or bottom band of at least three and 40 % of the pages."""
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    pages = lines.groupBy("document").agg(F.count_distinct("page").alias("pages"))
    edge = lines.filter((F.col("top") < band * F.col("page_height")) | (F.col("top") + F.col("height") > (1 - band) * F.col("page_height")))
    seen = edge.groupBy("document", folded.alias("margin")).agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, "document").filter(F.col("n") >= F.greatest(F.lit(least), F.ceil(share * F.col("pages")))).select("document", "margin")


def layout_blocks(lines: DataFrame, wide: float = 1.55) -> DataFrame:
    """document, page, block, kind, text: runs of lines without a wide gap; larger type makes headings, marks make list items."""
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    body = lines.withColumn("margin", folded).join(margin_repeat(lines), ["document", "margin"], "left_anti").join(font_mode(lines), "document")
    order = W.partitionBy("document", "page").orderBy("top", "left")
    body = body.withColumn("gap", F.col("top") - F.lag("top").over(order))
    step = body.groupBy("document").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").alias("step"))
    kind = F.when(F.col("font_size") >= 1.2 * F.col("body"), "heading").when(F.col("text").rlike(r"^(?:[-•*]|\d+[.)])\s"), "item").otherwise("paragraph")
    body = body.join(step, "document").withColumn("kind", kind)
    new = (F.col("gap") >= wide * F.col("step")) | (F.col("kind") != F.lag("kind").over(order)) | (F.col("kind") == "item")
    body = body.withColumn("block", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "text"))), lambda x: x["text"]), " ")
    return body.groupBy("document", "page", "block").agg(F.first("kind").alias("kind"), text.alias("text"))


def markdown(blocks: DataFrame) -> DataFrame:
    """document, text: the blocks as Markdown in page order. A document is one row, as long as the document."""
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).when(F.col("kind") == "item", F.regexp_replace("text", r"^(?:[-•*]|\d+[.)])\s+", "- ")).otherwise(F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("page", "block", line.alias("line"))))
    return blocks.groupBy("document").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n\n").alias("text"))


def ocr_words(files: DataFrame) -> DataFrame:
    """file, text, confidence of OCR tables (tab-separated, word rows have level 5): confidence weighted by characters."""
    cells = files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "line")).select("file", "at", F.split("line", "\t").alias("c")).filter((F.size("c") == 12) & (F.col("c")[0] == "5"))
    words = cells.select("file", "at", F.col("c")[10].try_cast("double").alias("conf"), F.trim(F.col("c")[11]).alias("word")).filter("word <> '' AND conf >= 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return words.groupBy("file").agg(text.alias("text"), (F.sum(F.col("conf") * F.length("word")) / F.sum(F.length("word"))).alias("confidence"))


def pdf_info(files: DataFrame) -> DataFrame:
    """file, info: ``Key: value`` lines as a map."""
    pairs = F.filter(F.transform(F.split("content", "\n"), lambda l: F.struct(F.trim(F.substring_index(l, ":", 1)).alias("k"), F.trim(F.regexp_extract(l, "^[^:]*:(.*)$", 1)).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    return files.select("file", F.map_from_entries(F.array_sort(pairs)).alias("info"))


def _attribute(head: Column, name: str) -> Column:
    """An attribute of a tag up to its end (``head``), the last of its name; null if it is empty."""
    return F.nullif(F.regexp_extract(head, rf"(?s)^<.*\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, also within a lambda."""
    return F.transform(F.array(value), of)[0]


def _entities(text: Column) -> Column:
    """Numeric entities of any plane, then the five named ones; what is no character stays as it is."""

    def decoded(part: Column, code: Column) -> Column:
        def char(number: Column) -> Column:
            right = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
            return F.when(right, F.concat(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"), F.substr(part, F.length(code) + 2))).otherwise(F.concat(F.lit("&#"), part))

        return _let(F.when(F.lower(F.substring(code, 1, 1)) == "x", F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).try_cast("int"), char)

    one = lambda part: _let(F.regexp_extract(part, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1), lambda code: decoded(part, code))
    whole = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    out = F.when(F.contains(text, F.lit("&#")), _let(F.split(text, "&#"), whole)).otherwise(text)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def layout_rows(files: DataFrame) -> DataFrame:
    """Elements and issues of text geometry in XML (document, xml) as rows of one frame, in one pass over the files; see :func:`parse_layout_xml`.

    Rows with a ``code`` are issues and have only a document besides. The others have a ``kind`` (text, image or fontspec), page_at, place and the columns of fragments and images.
    Windows by document find the fonts and the documents with an issue, so files that are dealt by document are not shuffled again.
    """
    rows = files.select("document", F.coalesce("xml", F.lit("")).alias("xml"))
    pages = rows.select("document", F.regexp_count("xml", F.lit(r"<page\b[^>]*>")).alias("opened"), F.regexp_extract_all("xml", F.lit(r"(?s)<page\b[^>]*>.*?</page>"), 0).alias("pages"))
    nested = F.exists("pages", lambda p: F.regexp_count(p, F.lit(r"<page\b")) > 1)
    ended = F.when(F.col("opened") == 0, "no-pages").when(nested | (F.col("opened") != F.size("pages")), "open-page")
    each = pages.select("document", ended.alias("ended"), F.posexplode_outer("pages").alias("page_at", "xml"))
    each = each.select("document", "ended", "page_at", F.substring_index("xml", ">", 1).alias("head"), F.regexp_extract_all("xml", F.lit(r"(?s)<fontspec\b[^>]*/>|<image\b[^>]*/>|<text\b[^>]*>.*?</text>"), 0).alias("tokens"))
    number = lambda n: _attribute(F.col("head"), n).try_cast("double")
    page = each.select("document", "ended", "page_at", number("number").cast("int").alias("page"), number("width").alias("page_width"), number("height").alias("page_height"), "tokens")
    unplaced = F.col("page_at").isNotNull() & F.expr("page IS NULL OR page < 1 OR page_width IS NULL OR page_width < 0 OR page_height IS NULL OR page_height < 0")
    tokens = page.select("document", "ended", "page_at", "page", "page_width", "page_height", unplaced.alias("unplaced"), F.posexplode_outer("tokens").alias("place", "token"))
    kind = F.when(F.col("token").startswith("<text"), "text").when(F.col("token").startswith("<image"), "image").when(F.col("token").startswith("<fontspec"), "fontspec")
    tokens = tokens.withColumns({"kind": kind, "head": F.substring_index("token", ">", 1)})
    font = F.col("kind") == "fontspec"
    sizes = {n: F.when(~font, number(n)) for n in ("top", "left", "width", "height")}
    found = tokens.withColumns(sizes | {"font": F.when(F.col("kind") == "text", F.coalesce(_attribute(F.col("head"), "font"), F.lit(""))), "id": F.when(font, _attribute(F.col("head"), "id")), "size": F.when(font, number("size"))})
    lacking = F.lit(False)
    for n in sizes:
        lacking = lacking | F.col(n).isNull() | (F.col(n) < 0) | F.isnan(n)
    bad = F.when(font, F.col("id").isNotNull() & (F.col("size").isNull() | (F.col("size") < 0))).when(F.col("kind").isNotNull(), lacking).otherwise(False)
    found = found.withColumns({"bad": F.col("unplaced") | bad, "of": F.coalesce("id", "font")})
    by_font = W.partitionBy("document", "of").orderBy("page_at", "place").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("declared", F.last("size", ignorenulls=True).over(by_font))
    in_order = W.partitionBy("document").orderBy("of", "page_at", "place")
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = found.withColumns({"later": F.lag(F.lit(True)).over(in_order), "least": F.min("ended").over(whole), "most": F.max("ended").over(whole), "wrong": F.max("bad").over(whole)})
    codes = F.array_distinct(F.array_compact(F.array("least", "most", F.when(F.col("wrong"), "number"))))
    sound = F.col("least").isNull() & ~F.col("wrong")
    out = found.filter(sound | F.col("later").isNull()).withColumn("code", F.explode_outer(F.when(~sound, codes))).filter("code IS NOT NULL OR kind IS NOT NULL")
    body = F.when(F.col("kind") == "text", F.substr("token", F.length("head") + 2, F.length("token") - F.length("head") - F.lit(1 + len("</text>"))))
    base = ["document", "page", "page_width", "page_height", "place", "top", "left", "width", "height"]
    out = out.select("code", "kind", "page_at", *base, "font", F.coalesce("declared", "height").alias("font_size"), "head", body.alias("body"))
    tagged = F.contains("body", F.lit("<"))
    plain = F.when(tagged, F.regexp_replace("body", r"(?s)<[^>]*>", "")).otherwise(F.col("body"))
    source = F.when(F.col("kind") == "image", _attribute(F.col("head"), "src"))
    out = out.select("code", "kind", "page_at", *base, "font", "font_size", (tagged & F.col("body").rlike(r"(?i)<b(?:\s[^>]*)?>")).alias("bold"), (tagged & F.col("body").rlike(r"(?i)<i(?:\s[^>]*)?>")).alias("italic"), plain.alias("plain"), source.alias("source"))
    return out.select("code", "kind", "page_at", *base, "font", "font_size", "bold", "italic", _entities(F.col("plain")).alias("text"), "source")


def parse_layout_xml(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fragments, images, issues) of text geometry in XML (document, xml): pages with font, text and image elements.

    Fragments: document, page, page_width, page_height, place, top, left, width, height, font, font_size, bold, italic, text; they feed :func:`visual_lines`. A fragment's size is that of the last
    font of its id that was declared before it, on any page, else its height. Images: document, page, place, top, left, width, height, source. Issues: document, code: ``no-pages``,
    ``open-page`` (a page begins in another or isn't closed), ``number`` (a coordinate that is missing, negative or no number); documents with an issue give no rows.
    A document's elements are rows from the first step on; only its XML text is one value. Each of the three reads the files once; :func:`layout_rows` has them in one pass.
    """
    rows = layout_rows(files)
    sound = rows.filter("code IS NULL")
    fragments = sound.filter("kind = 'text'").select("document", "page", "page_width", "page_height", "place", "top", "left", "width", "height", "font", "font_size", "bold", "italic", "text")
    images = sound.filter("kind = 'image' AND source IS NOT NULL").select("document", "page", "place", "top", "left", "width", "height", "source")
    return fragments, images, rows.filter("code IS NOT NULL").select("document", "code")
