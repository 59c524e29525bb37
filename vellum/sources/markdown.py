"""Markdown folders as DataFrames: files, notes, links, relations, attachments.

Files are found and read by Spark. Front matter is YAML and code masking is a line automaton, so
those two are small Python helpers inside one Arrow pass; links, headings and paragraphs are Spark
expressions over the masked lines.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfc, normalize_tags

#: Folders that are never searched.
IGNORED = ("node_modules", "dist", "build", "out", "coverage", "target", "vendor")
MOST_BYTES = 16 * 1024 * 1024
RELATION_NAME = re.compile(r"[a-z0-9]+(-[a-z0-9]+)*")


def scan_markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the Markdown files below a folder; hidden and ignored folders and ``AGENTS.md`` are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    path = F.regexp_replace(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"^[a-z]*:?/*\\Q{base}\\E/", "")
    parts = F.split("note", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*IGNORED)) | (F.try_element_at(parts, F.lit(-1)) == "AGENTS.md")
    return files.select(path.alias("note"), "content").filter(~hidden).select(F.col("note").alias("path"), "content")


def read_notes(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """path, text, issue: files over the size limit or that aren't UTF-8 keep no text and say why."""
    issue = F.when(F.octet_length("content") > most, "too large").when(~F.is_valid_utf8(F.try_validate_utf8(F.col("content").cast("string"))) | F.try_validate_utf8(F.col("content").cast("string")).isNull(), "not UTF-8")
    return files.select("path", F.when(issue.isNull(), F.col("content").cast("string")).alias("text"), issue.alias("issue"))


def validate_note_paths(notes: DataFrame) -> DataFrame:
    """id, issue of paths whose ids aren't canonical or are alike after Unicode composition."""
    ids = notes.select(F.regexp_replace("path", r"\.md$", "").alias("id"))
    bad = (F.col("id") != nfc(F.col("id"))) | (F.length("id") > 2048) | F.col("id").rlike(r"\\|[\x{0000}\r\n]|^/|/$|\.md$|(^|/)(\.[^/]*|)(/|$)")
    twice = ids.groupBy(nfc(F.col("id")).alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.collect_list("id").alias("ids")).filter("n > 1")
    return ids.filter(bad).select("id", F.lit("not canonical").alias("issue")).unionByName(twice.select(F.explode("ids").alias("id"), F.lit("collision").alias("issue")))


def _loader():
    """YAML as version 1.2's core schema reads it: no dates, only true and false, no repeated keys."""
    import yaml

    class Core(yaml.SafeLoader):
        yaml_implicit_resolvers = {}

        def construct_mapping(self, node, deep=False):
            keys = [k.value for k, _ in node.value]
            if len(set(keys)) < len(keys):
                raise ValueError("a key is repeated")
            return super().construct_mapping(node, deep)

    for kind, pattern, first in (("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]), ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")), ("int", r"^[-+]?[0-9]+$|^0o[0-7]+$|^0x[0-9a-fA-F]+$", list("-+0123456789")), ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", list("-+.0123456789"))):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{kind}", re.compile(pattern), first)
    Core.add_constructor("tag:yaml.org,2002:int", lambda self, n: int(n.value, 0) if n.value.lstrip("+-")[:2] in ("0x", "0o") else int(n.value))
    return Core


def front_matter(text: str) -> tuple[str | None, str | None, int]:
    """Metadata as JSON in authored order, what is wrong with it, and the lines it takes."""
    import yaml

    lines = text.split("\n")
    if lines[0].rstrip("\r") != "---":
        return None, None, 0
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip("\r") in ("---", "...")), None)
    if end is None:
        return None, "not closed", 0
    try:
        data = yaml.load("\n".join(lines[1:end]), _loader())
        if data is None:
            data = {}
        if not isinstance(data, dict):
            return None, "not a map", end + 1
        if len({str(k).lower() for k in data}) < len(data):
            return None, "keys differ only by case", end + 1
        return json.dumps(data, ensure_ascii=False, allow_nan=False, separators=(",", ":")), None, end + 1
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None, "not valid", end + 1


def mask(text: str, skip: int) -> list[str]:
    """The lines with front matter, fenced and indented code, comments and code spans blanked; line numbers stay."""
    out, fence, comment = [], "", False
    for i, line in enumerate(text.split("\n")):
        bare = line.lstrip(" ")
        mark = re.match(r"(`{3,}|~{3,})", bare) if len(line) - len(bare) < 4 else None
        if i < skip:
            line = ""
        elif fence:
            if mark and mark.group()[0] == fence[0] and len(mark.group()) >= len(fence) and not bare[len(mark.group()) :].strip():
                fence = ""
            line = ""
        elif mark:
            fence, line = mark.group(), ""
        elif re.match(r"(?: {4}|\t)", line):
            line = ""
        else:
            parts, rest = [], line
            while rest:
                if comment:
                    _, found, rest = rest.partition("-->")
                    comment = not found
                else:
                    head, found, rest = rest.partition("<!--")
                    parts.append(head)
                    comment = bool(found)
            line = re.sub(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)", lambda m: " " * len(m.group()), "".join(parts))
        out.append(line)
    return out


def parse_notes(notes: DataFrame) -> DataFrame:
    """path, text, metadata_json, issue, lines, plus id, title, tags, aliases, summary, links and relations.

    A note whose front matter is wrong keeps its text and says why in ``issue``.
    """
    schema = "path string, text string, metadata_json string, issue string, lines array<string>"

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                metadata, issue, skip = front_matter(text or "")
                rows.append((path, text, metadata, issue, mask(text or "", skip)))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.string()))], names=["path", "text", "metadata_json", "issue", "lines"])

    out = notes.select("path", "text").mapInArrow(run, schema)
    out = out.withColumn("id", F.regexp_replace("path", r"\.md$", "")).withColumn("metadata", F.try_parse_json(F.coalesce("metadata_json", F.lit("{}"))))
    heading = F.regexp_extract(F.try_element_at(F.filter("lines", lambda x: x.rlike(r"^ {0,3}#\s+\S")), F.lit(1)), r"^ {0,3}#\s+(.*?)\s*#*\s*$", 1)
    first = F.when(F.exists("lines", lambda x: x.rlike(r"^ {0,3}#\s+\S")), heading)
    named = F.replace(F.substring_index("id", "/", -1), F.lit("-"), F.lit(" "))
    declared = F.nullif(F.trim(F.try_variant_get("metadata", "$.title", "string")), F.lit(""))
    prose = F.try_element_at(F.filter(F.split(F.array_join("lines", "\n"), r"\n\s*\n"), lambda p: p.rlike(r"(?s)^\s*[^\s#>|`~<*+-]")), F.lit(1))
    summary = F.coalesce(F.try_variant_get("metadata", "$.description", "string"), prose)
    return out.withColumns({
        "title": F.coalesce(declared, first, named),
        "tags": normalize_tags(strings(F.col("metadata"), "tags")),
        "aliases": strings(F.col("metadata"), "aliases"),
        "summary": concise(summary),
    })


def strings(metadata: Column, key: str) -> Column:
    """A list of texts, or one text as a list."""
    many = F.try_variant_get(metadata, f"$.{key}", "array<string>")
    one = F.try_variant_get(metadata, f"$.{key}", "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def concise(text: Column, most: int = 180) -> Column:
    """Plain prose on one line, cut at a word where that keeps 65 % of the limit."""
    plain = F.regexp_replace(text, r"!?\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    plain = F.regexp_replace(plain, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[*_`]", ""), r"\s+", " "))
    head = F.substring(plain, 1, most - 1)
    at_word = F.regexp_extract(head, r"^(.*)\s\S*$", 1)
    cut = F.when(F.length(at_word) >= 0.65 * most, at_word).otherwise(F.rtrim(head))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(cut, F.lit("…")))


def wikilinks(parsed: DataFrame) -> DataFrame:
    """source, target, line, pos, embedded of each ``[[target|label]]`` that no odd backslash escapes."""
    each = parsed.select(F.col("path").alias("source"), F.posexplode("lines").alias("at", "text"))
    found = F.regexp_extract_all("text", F.lit(r"(?<!\\)(?:\\\\)*(!?\[\[[^\[\]\n]+\]\])"), 1)
    links = each.select("source", (F.col("at") + 1).alias("line"), F.posexplode(found).alias("n", "link"))
    target = F.trim(F.substring_index(F.regexp_extract("link", r"^!?\[\[(.*)\]\]$", 1), "|", 1))
    return links.select("source", target.alias("target"), F.col("line").cast("int").alias("line"), (F.col("line") * 10_000 + F.col("n")).alias("pos"), F.col("link").startswith("!").alias("embedded"))


def relations(parsed: DataFrame) -> DataFrame:
    """source, predicate, target, kind of the declared relations: a lower-kebab name and canonical ids, else ``malformed``."""
    entries = parsed.select(F.col("id").alias("source"), F.explode(F.from_json(F.to_json(F.try_variant_get("metadata", "$.relations", "variant")), "map<string,string>")).alias("predicate", "value"))
    listed = F.coalesce(F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")), F.array("value"))
    each = entries.select("source", "predicate", F.explode_outer(listed).alias("target"))
    good = F.col("predicate").rlike(f"^{RELATION_NAME.pattern}$") & F.col("target").isNotNull() & ~F.col("target").rlike(r"^$|\\|^/|/$|\.md$|(^|/)\.|//|\n")
    return each.select("source", "predicate", "target", F.when(good, "declared").otherwise("malformed").alias("kind"))


def attachments(parsed: DataFrame) -> DataFrame:
    """source, line, syntax, target of local files that a note shows or links, but notes."""
    each = parsed.select(F.col("path").alias("source"), F.posexplode("lines").alias("at", "text"))
    forms = {"markdown": r"!?\[[^\]\n]*\]\(<?([^)<>\s]+)>?(?:\s+\"[^\"]*\")?\)", "obsidian": r"!?\[\[([^\[\]|#\n]+\.[A-Za-z0-9]{1,8})(?:[|#][^\]]*)?\]\]"}
    out = None
    for name, form in forms.items():
        part = each.select("source", (F.col("at") + 1).cast("int").alias("line"), F.lit(name).alias("syntax"), F.explode(F.regexp_extract_all("text", F.lit(form), 1)).alias("target"))
        out = part if out is None else out.unionByName(part)
    return out.filter(~F.col("target").rlike(r"^[a-z][a-z0-9+.-]*:|^#|^//") & ~F.lower("target").endswith(".md")).withColumn("target", F.try_url_decode(F.replace("target", F.lit("+"), F.lit("%2B"))))


def attachment_join(references: DataFrame, files: DataFrame) -> DataFrame:
    """source, target, kind, file: exact path beside the note, else (Obsidian) the only file of that name, folded."""
    folder = F.regexp_replace("source", "[^/]*$", "")
    exact = F.when(F.col("target").startswith("/"), F.substr("target", F.lit(2))).otherwise(F.regexp_replace(F.concat(folder, "target"), r"(^|/)\./", "$1"))
    refs = references.withColumn("exact", exact).withColumn("base", F.lower(nfc(F.substring_index("target", "/", -1))))
    by_path = files.select(F.col("path").alias("exact"), F.col("path").alias("found"))
    by_name = files.groupBy(F.lower(nfc(F.substring_index("path", "/", -1))).alias("base")).agg(F.sort_array(F.collect_set("path")).alias("files"))
    out = refs.join(by_path, "exact", "left").join(by_name, "base", "left")
    bare = (F.col("syntax") == "obsidian") & ~F.contains("target", F.lit("/"))
    kind = F.when(F.col("found").isNotNull(), "resolved").when(bare & (F.size("files") == 1), "resolved").when(bare & (F.size("files") > 1), "ambiguous").when(F.exists("files", lambda f: F.lower(f) == F.lower("exact")), "case mismatch").otherwise("missing")
    return out.select("source", "target", kind.alias("kind"), F.coalesce("found", F.when(bare & (F.size("files") == 1), F.try_element_at("files", F.lit(1)))).alias("file"))


def parse_git_log(log: DataFrame, separator: str = "\x1e") -> tuple[DataFrame, DataFrame]:
    """commits (hash, committed_at, subject) and commit_paths (hash, pos, path) of a log in one text column ``value``.

    Records start with the separator; NUL frames their fields: hash, seconds, subject, then paths.
    """
    fields = log.select(F.explode(F.split("value", separator)).alias("record")).filter("record <> ''").select(F.split("record", "\\x{0000}").alias("f"))
    commits = fields.filter(F.col("f")[0].rlike("^[0-9a-f]{40}$")).select(F.col("f")[0].alias("hash"), F.timestamp_seconds(F.col("f")[1].try_cast("bigint")).alias("committed_at"), F.col("f")[2].alias("subject"), F.slice("f", F.lit(4), F.greatest(F.size("f") - 3, F.lit(0))).alias("paths"))
    paths = commits.select("hash", F.posexplode(F.filter("paths", lambda p: F.trim(F.regexp_replace(p, "\\s+", " ")) != "")).alias("pos", "path")).withColumn("path", F.regexp_replace("path", "^\n", ""))
    return commits.drop("paths"), paths
