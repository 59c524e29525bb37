"""Personal data: an Aho-Corasick automaton finds anchors, local parsers expand them.

Anchors are the at-sign, ``://``, the plus sign, digits and words that announce an identifier.
From each anchor a parser walks outwards as far as its kind allows and validates what it finds:

email, ip, card, phone: the leftmost non-overlapping matches of four fixed patterns, each then
    validated (parts up to 255; 13 to 19 digits with a right check digit; 9 to 15 digits).
address: a URL with a user before its host, or with an IP address as host.
account: an identifier of 6 to 64 letters, digits, ``-``, ``_`` with a digit in it, after an
    announcing word and at most a few separators; after ``iban``, with a right checksum.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, pick, table

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
#: Words that announce an identifier.
CUES = ("account number", "account no", "account", "acct", "iban", "ssn", "social security number", "passport number", "passport", "api_key", "api-key", "apikey", "api key", "access key", "secret", "token", "password", "passwd", "customer id", "user id", "member id", "tax id", "driver license")
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL, _LABEL, _NAME = _ALNUM | frozenset("._%+-"), _ALNUM | {"-"}, _ALNUM | frozenset("-_")
_PHONE = _DIGITS | frozenset(" ().-")
_URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`|{}\\^")
_AFTER_HOST, _TRAILING = _URL_END | frozenset("/?#"), ".,;:!?)"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("://", ":"), ("+", "+"), *((d, "0") for d in "0123456789"), *((c, "?") for c in CUES)]:
        found.add_word(word, kind)
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    groups = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
        end, groups = _run(text, end + 1, _LABEL), groups + 1
    return (start, end) if groups else None


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _ips(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The matches of the dotted numbers from ``at``, four by four, and where those numbers end."""
    parts, end = [], at
    while True:
        start, end = end, _run(text, end, _DIGITS)
        parts.append((start, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
            end += 1
        else:
            break
    fours = [parts[i : i + 4] for i in range(0, len(parts) - 3, 4)]
    return [(f[0][0], f[3][1]) for f in fours if all(_octet(text[a:b]) for a, b in f)], end


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _card(text: str, at: int) -> tuple[bool, int]:
    """Whether the digits from ``at``, with single spaces or hyphens between, are a card number, and where they end."""
    end = _run(text, at, _DIGITS)
    while end + 1 < len(text) and text[end] in " -" and text[end + 1] in _DIGITS:
        end = _run(text, end + 1, _DIGITS)
    if end - at > 40:
        return False, end
    digits = text[at:end].replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and _luhn(digits), end


def _phone(text: str, at: int) -> tuple[bool, int] | None:
    """The same for the number after a plus sign; None if the pattern doesn't match."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15, end


def _address(text: str, at: int) -> tuple[int, int] | None:
    start = at
    while start > 0 and text[start - 1] in _ALNUM:
        start -= 1
    stop = at + 3
    while stop < len(text) and text[stop] not in _AFTER_HOST:
        stop += 1
    host = text[at + 3 : stop].rstrip(_TRAILING)
    user, sign, host = host.rpartition("@")
    name = host.partition(":")[0]
    parts = name.split(".")
    numeric = len(parts) == 4 and all(p and _DIGITS.issuperset(p) and _octet(p) for p in parts)
    named = len(parts) > 1 and all(p and _LABEL.issuperset(p) for p in parts)
    if start == at or not (numeric or sign and user and named):
        return None
    end = stop
    while end < len(text) and text[end] not in _URL_END:
        end += 1
    while text[end - 1] in _TRAILING:
        end -= 1
    return start, end


def _iban(name: str) -> bool:
    name = name.upper()
    return 15 <= len(name) <= 34 and name[:2].isalpha() and int("".join(str(int(c, 36)) for c in name[4:] + name[:4])) % 97 == 1


def _account(text: str, start: int, end: int, cue: str) -> tuple[int, int] | None:
    if start and text[start - 1] in _NAME:
        return None
    at = end
    while at < len(text) and at < end + 6 and text[at] in " \t:=#\"'":
        at += 1
    stop = min(_run(text, at, _NAME), at + 65)
    name = text[at:stop]
    if at == end or not 6 <= stop - at <= 64 or _DIGITS.isdisjoint(name):
        return None
    return (at, stop) if cue != "iban" or name.isalnum() and _iban(name) else None


def spans(text: str, lower: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """(start, end) in code points of each kind; ``lower`` is the text with A-Z lower-cased."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email, ip, card, phone, address, account = (found[k] for k in KINDS)
    after_email = after_ip = after_card = after_phone = after_address = after_account = 0
    for at, kind in anchors.iter(lower):
        if kind == "0":
            if at >= after_ip:
                some, after_ip = _ips(text, at)
                ip += some
            if at >= after_card:
                right, end = _card(text, at)
                if right:
                    card.append((at, end))
                after_card = end
        elif kind == "@":
            if at >= after_email and (e := _email(text, at, after_email)):
                email.append(e)
                after_email = e[1]
        elif kind == "+":
            if at >= after_phone and (p := _phone(text, at)):
                if p[0]:
                    phone.append((at, p[1]))
                after_phone = p[1]
        elif kind == ":":
            if at - 2 >= after_address and (a := _address(text, at - 2)):
                address.append(a)
                after_address = a[1]
        elif at >= after_account:
            for cue in CUES:
                start = at + 1 - len(cue)
                if start >= 0 and lower.startswith(cue, start) and (a := _account(text, start, at + 1, cue)):
                    account.append(a)
                    after_account = a[1]
                    break
    return found


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of spans of each kind (``vellum_email`` and so on), ``vellum_base`` and ``vellum_spans``.

    The last two list ``kind:start:end`` by kind, then start, joined by commas: of the four base
    kinds, and of all. A null or empty text has none. Each row stands for itself. A text is read whole,
    whatever its length; each anchor is parsed once a kind. Other columns are carried along, whatever their
    names but those. An empty table gives no rows.
    """

    def make():
        anchors = automaton()

        def of(texts):
            rows = []
            for t in texts:
                s = spans(t.decode(), t.lower().decode(), anchors) if t else dict.fromkeys(KINDS, ())
                listed = {k: ",".join(f"{k}:{a}:{b}" for a, b in s[k]) for k in KINDS}
                rows.append([*(len(s[k]) for k in KINDS), ",".join(listed[k] for k in BASE if s[k]), ",".join(x for x in listed.values() if x)])
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(len(KINDS) + 2)]

        return of

    return append(docs, make, {f"vellum_{k}": "bigint" for k in KINDS} | {"vellum_base": "string", "vellum_spans": "string"})


def query(spark, sf_dir) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_address, n_account of every document."""
    out = find_pii(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", *(F.col(f"vellum_{k}").alias(f"n_{k}") for k in BASE), F.sha2("vellum_base", 256).alias("base_sha256"), F.col("vellum_spans").alias("spans"), *(F.col(f"vellum_{k}").alias(f"n_{k}") for k in KINDS[4:]))
