"""Text functions as columns: folding, terms, words, slugs, dates, paths and redaction.

Everything is a Spark expression but Unicode normal forms, which Spark lacks: those go through
one Arrow function, and only for texts with a character that a normal form could change.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words left out of search terms.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "why", "with")
MOST_TERMS, MOST_QUERY_BYTES = 64, 16_384
#: White space of ECMAScript, inside a class.
WHITE = r"\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _former(form: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal


_NFC, _NFKC, _NFKD = (_former(f) for f in ("NFC", "NFKC", "NFKD"))


def nfc(text: Column) -> Column:
    """Below U+0300 no character and no pair changes under NFC: such texts stay in the JVM, and Python gets a null in their place."""
    plain = text.rlike(r"^[\x{0000}-\x{02FF}]*$")
    return F.coalesce(F.when(plain, text), _NFC(F.when(~plain, text)))


def nfkc(text: Column) -> Column:
    plain = text.rlike(r"^[\x{0000}-\x{009F}]*$")
    return F.coalesce(F.when(plain, text), _NFKC(F.when(~plain, text)))


def norm_text(text: Column) -> Column:
    """The fold for equality, order and search: NFC, lower case."""
    return F.lower(nfc(text))


def norm_tag(tag: Column) -> Column:
    return norm_text(F.regexp_replace(F.trim(tag), "^#+", ""))


def normalize_tags(tags: Column) -> Column:
    """Trimmed, without leading hash signs, in NFC, lower-cased, none empty, each once, in order. Nulls are left out; so would be a unit separator (U+001F) in a tag, which parts it."""
    composed = F.split(nfc(F.array_join(tags, "\u001f")), "\u001f")
    return F.array_distinct(F.filter(F.transform(composed, lambda t: F.lower(F.regexp_replace(F.trim(t), "^#+", ""))), lambda t: t != ""))


def search_terms(query: Column) -> Column:
    """Distinct terms of a query in order, without stop words and single characters unless nothing else is left."""
    raw = F.array_distinct(F.regexp_extract_all(norm_text(query), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}._/-]*"), 0))
    kept = F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def query_valid(query: Column) -> Column:
    """Whether a query is within the limits: not blank, bytes and distinct terms."""
    raw = F.array_distinct(F.regexp_extract_all(norm_text(query), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}._/-]*"), 0))
    return query.isNotNull() & (F.trim(query) != "") & (F.octet_length(query) <= MOST_QUERY_BYTES) & (F.size(raw) <= MOST_TERMS)


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")).cast("bigint")


def phrase_offset(text: Column, phrase: str) -> Column:
    """Offset of the first occurrence of a phrase that no ASCII letter or digit touches where the phrase ends in one; -1 if none."""
    word = lambda c: c.isascii() and c.isalnum()
    before = "(?<![A-Za-z0-9])" if word(phrase[0]) else ""
    after = "(?![A-Za-z0-9])" if word(phrase[-1]) else ""
    return F.regexp_instr(F.lower(text), F.lit(f"{before}\\Q{phrase.lower()}\\E{after}")) - 1


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def concept_key(text: Column) -> Column:
    return _dashed(F.regexp_replace(F.lower(nfkc(text)), "^#+", ""))


def slugify(text: Column, most: int = 80) -> Column:
    return F.regexp_replace(F.substring(_dashed(F.regexp_replace(F.lower(nfkc(text)), "['’]", "")), 1, most), "-+$", "")


def scope_slug(scope: Column, most: int = 48) -> Column:
    ascii_ = F.regexp_replace(F.regexp_replace(_NFKD(scope), r"\p{M}+", ""), "[^A-Za-z0-9]+", "-")
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.lower(ascii_), "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(slug == "", F.lit("repository")).otherwise(slug)


def scope_hub_id(scope: Column) -> Column:
    return F.concat(F.lit("scopes/"), scope_slug(scope), F.lit("--"), F.substring(F.sha2(nfc(scope), 256), 1, 12))


def utf8_prefix(text: Column, most: int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes."""
    head = F.substring(text, 1, most)
    sizes = F.transform(F.split(head, ""), lambda c: F.octet_length(c))
    fits = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, s: F.when(a["n"] + s <= most, F.struct((a["n"] + s).alias("n"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(most).alias("n"), a["k"].alias("k"))), lambda a: a["k"])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substr(head, F.lit(1), fits))


def calendar_date(text: Column) -> Column:
    """The date of a strict YYYY-MM-DD text, null if there is no such day."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def normalize_predicate(text: Column) -> Column:
    return F.regexp_replace(norm_text(F.trim(text)), r"[_\s]+", "-")


def compact_count(text: Column) -> Column:
    """``1.2k`` and ``3m`` as numbers."""
    number = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9][0-9,]*(?:\.[0-9]+)?)\s*([km]?)$", 1)
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^([0-9][0-9,]*(?:\.[0-9]+)?)\s*([km]?)$", 2)
    value = F.regexp_replace(number, ",", "").try_cast("double")
    return F.floor(value * F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1) + 0.5)


def canonical_path_error(path: Column) -> Column:
    """Null for a canonical repository path, else what is wrong with it."""
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.rlike(r"[\x{0000}-\x{001F}\x{007F}]"), "control")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.rlike(r"^(/|[A-Za-z]:)"), "absolute")
        .when(path.rlike(r"[*?\[\]{}]"), "glob")
        .when(path == ".", None)
        .when(path.rlike(r"(^|/)(\.\.?|)(/|$)"), "segment")
    )


def redact_tokens(text: Column) -> Column:
    """Values of assignments to credential names, private-key blocks, JSON web tokens and access-key ids, replaced."""
    out = F.regexp_replace(text, r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[redacted]")
    out = F.regexp_replace(out, r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[redacted]")
    out = F.regexp_replace(out, r"\bAKIA[0-9A-Z]{16}\b", "[redacted]")
    return F.regexp_replace(out, r"(?i)\b(token|secret|password|passwd|api[_-]?key|access[_-]?token)(\s*[=:]\s*)(\"[^\"\n]*\"|'[^'\n]*'|[^\s\"',;]+)", "$1$2[redacted]")


def redact_machine_paths(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?:/Users|/home)/[^/\s\"']+", "<home>")
    out = F.regexp_replace(out, r"(?i)[A-Z]:\\Users\\[^\\\s\"']+", "<home>")
    return F.regexp_replace(out, r"(?:/private)?/(?:tmp|var/folders)(?:/[^\s\"']*)?", "<temp>")


def sanitize_terminal(text: Column) -> Column:
    """Without escape sequences, control and bidirectional characters; tabs as four spaces."""
    out = F.regexp_replace(text, r"\x{001B}\][^\x{0007}\x{001B}]*(?:\x{0007}|\x{001B}\\)", "")
    out = F.regexp_replace(out, r"(?:\x{001B}\[|\x{009B})[0-?]*[ -/]*[@-~]", "")
    out = F.regexp_replace(out, r"\x{001B}.", "")
    out = F.regexp_replace(out, r"\r\n|[\r\x{2028}\x{2029}]", "\n")
    out = F.regexp_replace(out, "\t", "    ")
    return F.regexp_replace(out, r"[\x{0000}-\x{0009}\x{000B}-\x{001F}\x{007F}-\x{009F}\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")


def sniff_image(content: Column) -> Column:
    """Media type of an image from its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.rlike("^52494646.{8}57454250"), "image/webp")
        .when(head.rlike("^.{8}66747970(61766966|61766973)"), "image/avif")
    )


def canonical_metadata(metadata: Column) -> Column:
    """JSON of a VARIANT with keys in order."""
    return F.to_json(metadata)


def scalar_literal(text: Column) -> Column:
    """A VARIANT of a literal: true, false, null and numbers as such, quoted or other text as text."""
    plain = text.rlike(r"^(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|\"(?:[^\"\\]|\\.)*\")$")
    return F.when(plain, F.try_parse_json(text)).otherwise(F.try_variant_get(F.parse_json(F.to_json(F.struct(text.alias("v")))), "$.v", "variant"))


def marker(text: Column, name: str = "agent-context") -> Column:
    """The value of the one ``<!-- name: value -->`` comment before the first heading; null if there is none or more."""
    head = F.regexp_extract(F.concat(F.lit("\n"), text), r"(?s)^(.*?)(?:\n#{1,6}\s|$)", 1)
    unfenced = F.regexp_replace(head, r"(?s)\n(`{3,}|~{3,}).*?\n\1", "\n")
    found = F.regexp_extract_all(unfenced, F.lit(f"(?m)^<!--\\s*{name}:\\s*(\\S+)\\s*-->\\s*$"), 1)
    return F.when(F.size(found) == 1, F.get(found, 0))
