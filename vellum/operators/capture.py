"""Captured pages: HTML to text, completeness, scores, choice of extractions, saved URLs, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import count_words
from ..functions.url import identity

#: Elements that never show, dropped with all they hold.
HIDDEN = ("script", "style", "noscript", "template", "iframe", "object", "svg", "head")
#: Statuses from the best to the worst, and what each is worth.
STATUS = {"complete": 5_000, "partial": 2_000, "auth-required": -2_000, "blocked": -4_000, "unsupported": -5_000}
#: What gates say, as patterns: signs of a block, of a rate limit, of a login and of a paywall; what only articles about such things say; what unfinished pages say.
_HUMAN = "verify (?:that )?you are (?:a )?human"
_LIMIT = "(?:429(?: too many requests)?|too many requests|rate limit(?:ed| exceeded)?)"
_PAY = "(?:subscribe(?: now)? to (?:unlock (?:this|the) (?:article|story|content)|(?:keep|continue) reading)|create (?:an? |your )?account to (?:keep|continue) reading|register to (?:keep|continue) reading|sign up to (?:keep|continue) reading)"
BLOCK_WORDS = rf"(?:{_HUMAN}|(?:complete|solve) (?:the )?captcha|\bcaptcha\b|access denied|request (?:has been )?blocked|unusual traffic|cloudflare ray id)"
BLOCK_TITLE = rf"^(?:403(?: forbidden)?|access denied|request blocked|unusual traffic|{_HUMAN}|human verification|captcha|security (?:check|verification)|attention required|just a moment(?:\.{{3}})?|{_LIMIT})$"
BLOCK_CONTEXT = r"(?:\b(?:please )?(?:verify|confirm) (?:that )?you are (?:a )?human\b|\b(?:complete|solve) (?:the )?captcha\b|\b(?:you (?:do not|don't) have permission|you have been blocked)\b|\b(?:your|this) (?:request|access|ip(?: address)?) (?:has been|was|is) blocked\b|\bunusual traffic from your (?:computer )?network\b|\bautomated (?:queries|requests)\b|\b(?:before proceeding|to continue),? (?:please )?(?:verify|complete|enable)\b|\bcloudflare ray id\b)"
BLOCK_LINE = rf"(?:403(?: forbidden)?|access denied|request blocked|unusual traffic|{_HUMAN}|captcha|security (?:check|verification)|{_LIMIT})"
LIMIT_WORDS = rf"\b{_LIMIT}\b"
LIMIT_RETRY = r"\b(?:please )?(?:(?:try|retry) again(?: later| in \d+)|wait (?:a moment|before retrying)|respect the retry-after header)\b"
ABOUT_BLOCKS = r"(?:\bhow to\b|\btroubleshoot(?:ing)?\b|\b(?:this|the) (?:article|guide|tutorial)\b|\blearn (?:how|why)\b)"
LOGIN_WORDS = r"(?:\b(?:sign|log) in to (?:continue|read|view|see|access|comment|reply)\b|\blogin required\b|\bmembers? only\b|\bsubscriber-only\b|\bsubscribe to (?:continue|read)\b|\bthis content is private\b|\byou must be logged in\b)"
PAY_WORDS, PAY_LINE, PAY_TITLE = rf"\b{_PAY}\b", _PAY, rf"^{_PAY}[.!]?$"
ABOUT_PAYWALLS = r"\b(?:analy[sz](?:e|es|ed|ing)|discuss(?:es|ed|ing)?|examin(?:e|es|ed|ing)|quot(?:e|es|ed|ing)|stud(?:y|ies|ied|ying)|interface copy|wording|publishers? (?:sometimes )?(?:say|write|use))\b"
SHELL_WORDS = "(?:enable javascript|javascript is disabled|something went wrong|try reloading)"
#: The most characters and words of a page that is only a gate, the most words of one that a single line shows, and of one that asks for money.
GATE_CHARS, GATE_WORDS, LINE_WORDS, PAY_MOST = 4_096, 160, 24, 48


def title(html: Column) -> Column:
    return entities(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def entities(text: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


#: What makes a page plain text, in order: (pattern, replacement).
TEXT_STEPS = (
    ("(?s)<!--.*?-->", ""),
    *((f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", "") for tag in HIDDEN),
    (r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|table|br|section|article|nav|footer|header|blockquote|pre|main|body|html|!doctype)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
TIDY_STEPS = ((r"[ \t]*\n[ \t\n]*", "\n"), (r"^\n+|\n+$", ""))


def steps(text: Column, each) -> Column:
    for pattern, replacement in each:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def html_text(html: Column) -> Column:
    """Text of a page's shown elements, blocks on lines of their own."""
    return F.trim(steps(entities(steps(html, TEXT_STEPS)), TIDY_STEPS))


def _says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def _line(text: Column, pattern: str) -> Column:
    """Whether a line is what the pattern says and nothing else, as a heading or not."""
    return text.rlike(rf"(?i)(?:^|\n)[ \t]*(?:#{{1,6}}[ \t]+)?{pattern}[.!]?[ \t]*(?:\r?\n|$)")


def access_gates(text: Column, name: Column) -> Column:
    """A struct of ``blocked``, ``paywall`` and ``login``: what a page's text and title show of gates.

    A block or a paywall is only believed of a small page, by a title or line that says nothing else, or by its words in their context; an article about such things is none.
    """
    body, title_ = F.coalesce(text, F.lit("")), F.trim(F.regexp_replace(F.substring(F.coalesce(name, F.lit("")), 1, 500), r"\s+", " "))
    seen, words = F.concat(title_, F.lit("\n"), body), count_words(body)
    small = (F.length(body) <= GATE_CHARS) & (words <= GATE_WORDS)
    titled = _says(title_, BLOCK_TITLE)
    limited = _says(body, LIMIT_WORDS) & _says(body, LIMIT_RETRY)
    stated = (words <= LINE_WORDS) & _line(body, BLOCK_LINE)
    meant = titled | limited | (_says(body, BLOCK_WORDS) & _says(body, BLOCK_CONTEXT))
    asked = _says(title_, PAY_TITLE) | _line(body, PAY_LINE) | ((words <= PAY_MOST) & _says(seen, PAY_WORDS) & ~_says(seen, ABOUT_PAYWALLS))
    return F.struct((small & ~_says(seen, ABOUT_BLOCKS) & (stated | meant)).alias("blocked"), (small & asked).alias("paywall"), _says(seen, LOGIN_WORDS).alias("login"))


def extract_status(text: Column, name: Column, scope: Column | None = None, cut: Column | None = None) -> Column:
    """blocked, auth-required, unsupported, partial or complete.

    A gate on a short page is all there is of it; on a longer one what was captured is partial. So are threads and comments (``scope``), whose pages may go on unseen, and texts
    that were cut or only rendered (``cut``). Pages of fewer than 40 characters, or short ones that ask for scripts, are unsupported. Nulls count as empty, or as false.
    """
    body = F.coalesce(text, F.lit(""))
    gates = access_gates(text, name)
    gated = gates["paywall"] | gates["login"]
    shell = _says(F.concat(F.coalesce(name, F.lit("")), F.lit("\n"), body), SHELL_WORDS) & (F.length(body) < 500)
    partial = gated | F.coalesce(F.lit(False) if cut is None else cut, F.lit(False)) | F.coalesce(F.lit(False) if scope is None else scope.isin("thread", "comments"), F.lit(False))
    return F.when(gates["blocked"], "blocked").when(gated & (F.length(body) < 1_500), "auth-required").when(shell | (F.length(F.trim(body)) < 40), "unsupported").when(partial, "partial").otherwise("complete")


def score_extraction(status: Column, text: Column, items: Column, images: Column, links: Column) -> Column:
    weight = F.lit(0)
    for name, value in STATUS.items():
        weight = F.when(status == name, value).otherwise(weight)
    return weight + F.least(F.length(text), F.lit(50_000)) + 5 * F.least(count_words(text), F.lit(10_000)) + 50 * items + 100 * images + 5 * links


def choose_best(candidates: DataFrame) -> DataFrame:
    """One extraction a page (page_id, at, status, score): the best status, then score; the first of equals."""
    rank = F.lit(len(STATUS))
    for i, name in enumerate(STATUS):
        rank = F.when(F.col("status") == name, i).otherwise(rank)
    best = F.min_by(F.struct("at", "status", "score"), F.struct(rank, -F.col("score"), F.col("at")))
    return candidates.groupBy("page_id").agg(best.alias("b")).select("page_id", "b.*")


def rank_results(results: DataFrame, target: str) -> DataFrame:
    """Search results (query_id, url, score, at): the exact target first, then score, then order; one a URL identity."""
    keyed = results.withColumn("identity", identity(F.col("url"))).filter("identity IS NOT NULL").withColumn("exact", F.col("identity") == target)
    best = F.min_by(F.struct("url", "score", "at", "exact"), F.struct(~F.col("exact"), -F.col("score"), F.col("at")))
    once = keyed.groupBy("query_id", "identity").agg(best.alias("b")).select("query_id", "identity", "b.*")
    w = W.partitionBy("query_id").orderBy(F.col("exact").desc(), F.col("score").desc(), "at")
    return once.withColumn("rank", F.row_number().over(w).cast("bigint"))


def comment_count(json_ld: Column) -> Column:
    """The first ``commentCount`` in a JSON-LD text."""
    return F.regexp_extract(json_ld, r"\"commentCount\"\s*:\s*\"?(\d+)", 1).try_cast("bigint")


def discover_saved_urls(notes: DataFrame) -> DataFrame:
    """id, url, identity of notes with a ``source`` or ``source_url`` in their metadata."""
    url = F.coalesce(F.try_variant_get("metadata", "$.source_url", "string"), F.try_variant_get("metadata", "$.source", "string"))
    return notes.select("id", url.alias("url"), identity(url).alias("identity")).filter("identity IS NOT NULL")


def backfill(saved: DataFrame, have: DataFrame, refresh: bool = False) -> DataFrame:
    """id, identity, action: ``skip`` where metadata is there already (unless refreshed), else ``write``; ``alias`` for repeats of an identity."""
    w = W.partitionBy("identity").orderBy("id")
    known = have.select("identity", F.lit(True).alias("known")).distinct()
    out = saved.withColumn("n", F.row_number().over(w)).join(known, "identity", "left")
    return out.select("id", "identity", F.when(F.col("known") & ~F.lit(refresh), "skip").when(F.col("n") > 1, "alias").otherwise("write").alias("action"))


def parse_webvtt(files: DataFrame) -> DataFrame:
    """file, start_ms, text of each cue, without what the cue before it already showed."""
    body = F.regexp_replace("content", "\r\n?", "\n")
    blocks = files.select("file", F.posexplode(F.split(body, r"\n{2,}")).alias("at", "block"))
    stamp = r"(?m)^(?:(\d{2,}):)?(\d{2}):(\d{2})\.(\d{3})\s+-->"
    part = lambda i: F.coalesce(F.regexp_extract("block", stamp, i).try_cast("bigint"), F.lit(0))
    cues = blocks.filter(F.col("block").rlike(stamp)).select("file", "at", (((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)).alias("start_ms"), F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1).alias("raw"))
    clean = F.trim(F.regexp_replace(entities(F.regexp_replace("raw", r"<[^>]*>", "")), r"\s+", " "))
    cues = cues.withColumn("words", F.filter(F.split(clean, " "), lambda w: w != ""))
    cues = cues.withColumn("last", F.lag("words").over(W.partitionBy("file").orderBy("at")))
    overlap = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.size("words"), F.coalesce(F.size("last"), F.lit(0)))), lambda n: (n == 0) | (F.slice("words", F.lit(1), n) == F.slice("last", F.size("last") - n + 1, n))))
    overlap = F.when(F.col("last").isNull() | (F.size("last") == 0), 0).otherwise(overlap)
    fresh = F.array_join(F.slice("words", overlap + 1, F.greatest(F.size("words"), F.lit(1))), " ")
    return cues.select("file", "start_ms", fresh.alias("text")).filter("text <> ''")


def parse_timemap(files: DataFrame) -> DataFrame:
    """original, memento, taken_at of link-format time maps (content); maps with several originals give nothing."""
    links = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(<[^>]+>(?:\s*;\s*[a-z]+=\"[^\"]*\")+)"), 1)).alias("link"))
    attribute = lambda n: F.regexp_extract("link", f"{n}=\"([^\"]*)\"", 1)
    links = links.select("file", F.regexp_extract("link", "^<([^>]+)>", 1).alias("url"), F.split(attribute("rel"), r"\s+").alias("rel"), attribute("datetime").alias("at"))
    original = links.filter(F.array_contains("rel", "original")).groupBy("file").agg(F.count_distinct("url").alias("n"), F.min("url").alias("original")).filter("n = 1")
    return links.filter(F.array_contains("rel", "memento")).join(original, "file").select("original", F.col("url").alias("memento"), F.try_to_timestamp(F.regexp_replace("at", r"^[A-Za-z]+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")).alias("taken_at"))


def merge_snapshots(snapshots: DataFrame) -> DataFrame:
    """page, text of a page's snapshots (page, at, text) in order: each adds its lines after the longest overlap with the end of the one before.

    A page's snapshots are one row each; the overlap is found between two arrays of lines.
    """
    w = W.partitionBy("page").orderBy("at")
    rows = snapshots.withColumn("lines", F.split("text", "\n")).withColumn("last", F.lag("lines").over(w))
    most = F.least(F.size("lines"), F.coalesce(F.size("last"), F.lit(0)))
    overlap = F.array_max(F.filter(F.sequence(F.lit(0), most), lambda n: (n == 0) | (F.slice("lines", F.lit(1), n) == F.slice("last", F.greatest(F.size("last") - n + 1, F.lit(1)), n))))
    rows = rows.withColumn("n", F.when(F.col("last").isNull(), 0).otherwise(overlap))
    fresh = F.array_join(F.slice("lines", F.col("n") + 1, F.greatest(F.size("lines"), F.lit(1))), "\n")
    kept = rows.select("page", "at", fresh.alias("fresh")).filter("fresh <> ''")
    return kept.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "fresh"))), lambda r: r["fresh"]), "\n").alias("text"))


def image_sources(markdown: Column) -> Column:
    """Targets of a Markdown text's images, in order."""
    return F.regexp_extract_all(markdown, F.lit(r"!\[[^\]\n]*\]\(<?([^)<>\s]+)"), 1)


def absolute_links(markdown: Column, base: Column) -> Column:
    """Root-relative Markdown targets made absolute on the page's host; script URLs emptied."""
    site = F.regexp_replace(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), r"\$", r"\\\$")
    out = F.regexp_replace(markdown, F.lit(r"(!?\[[^\]\n]*\]\(<?)(?=/(?!/))"), F.concat(F.lit("$1"), site))
    return F.regexp_replace(out, r"(?i)(\]\(<?)\s*(?:javascript|vbscript|data):[^)>]*", "$1")


def parse_search_response(responses: DataFrame) -> DataFrame:
    """query_id, at, url, title, score of JSON responses (query_id, json); responses of another shape give one row without URL."""
    parsed = F.from_json("json", "struct<results:array<struct<url:string,title:string,score:double>>>")
    rows = responses.select("query_id", F.posexplode_outer(parsed["results"]).alias("at", "r"))
    return rows.select("query_id", "at", "r.*")


def annotation_join(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """id, kind of annotations (id, sha256, text) and images (id, sha256): matched, changed (other bytes) or missing."""
    have = images.select("id", F.col("sha256").alias("have"))
    return annotations.join(have, "id", "left").select("id", "text", F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("sha256"), "matched").otherwise("changed").alias("kind"))


def capture_slug(platform: Column, name: Column, content_id: Column) -> Column:
    """A file name from the platform and title, with the stable content id kept at its end."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""))
    tail = F.when(content_id.isNotNull() & (content_id != ""), F.concat(F.lit("-"), content_id)).otherwise("")
    return F.concat(platform, F.lit("-"), F.regexp_replace(F.substr(slug, F.lit(1), F.greatest(80 - F.length(tail) - F.length(platform), F.lit(1))), "-+$", ""), tail)


def effective_scope(platform: Column) -> Column:
    """Discussions are captured as threads, other pages as pages."""
    return F.when(platform.isin("x", "hacker-news", "reddit", "bluesky"), "thread").otherwise("page")
