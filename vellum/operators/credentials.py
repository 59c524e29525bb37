"""Credentials in texts: a scanner for assigned values, and fixed shapes, with counts.

A value's end depends on its quotes and on its key: a password may hold blanks, a token may not. Quotes and signs may be written as HTML entities; the scanner reads the text with entities
decoded, and replaces the written places. Keys are compared in snake case, so ``apiKey``, ``api-key`` and ``API_KEY`` are one.
"""

from __future__ import annotations

import html
from bisect import bisect_right

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose values are credentials, alone or, for the second list, also at the end of a longer key.
KEYS = frozenset("authorization cookie credential credentials csrf hdnea hdnat jwt password passwd proxy_authorization _auth secret session set_cookie token xsrf aws_access_key_id aws_secret_access_key".split())
ENDINGS = ("api_key", "authorization", "cookie", "credential", "credentials", "csrf", "csrf_token", "jwt", "key_pair_id", "passwd", "password", "private_key", "secret", "secret_key", "session", "session_id", "session_key", "session_token", "signature", "signed_url", "token", "xsrf", "xsrf_token")
#: What stands in place of a credential.
VALUE, BLOCK, WEB_TOKEN, ACCESS_KEY = "[REDACTED]", "[REDACTED_PEM_CREDENTIAL]", "[REDACTED JWT]", "[REDACTED ACCESS KEY]"

_BLOCK = regex.compile(r"(?is)-----BEGIN ((?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY|PGP PRIVATE KEY BLOCK|(?:X509 |TRUSTED )?CERTIFICATE)-----.*?(?:-----END \1-----|\Z)")
_WEB_TOKEN = regex.compile(r"(?a)\beyJ[a-zA-Z0-9_-]{8,}\.[a-zA-Z0-9_-]{8,}\.[a-zA-Z0-9_-]{8,}\b")
_ACCESS_KEY = regex.compile(r"(?a)\bAKIA[A-Z0-9]{16}\b")
_ENTITY = regex.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});")
_ASSIGNED = regex.compile(r"""(?i)(?<![a-z0-9_-])(?:(['"])(?<quoted>[a-z_][a-z0-9_-]{0,127})\1|(?<bare>[a-z_][a-z0-9_-]{0,127}))\s*[:=]\s*""")
_SCHEME = regex.compile(r"(?i)(?:basic|bearer)\s+")
#: Where an unquoted value ends, by kind of key.
_LINE, _HEADER, _WORD = regex.compile(r"[\r\n<]"), regex.compile(r"""[\s<>&,"']"""), regex.compile(r"[\s<>&;,)\]]")
_PHRASE_KEY = regex.compile(r"credential|pass(?:word|wd)?|private_key|secret|cookie")


class Decoded:
    """A text with its entities decoded, and where each place was written."""

    def __init__(self, text: str):
        self.starts, self.shifts, self.entities = [0], [0], set()
        out, at, length, shift = [], 0, 0, 0
        for m in _ENTITY.finditer(text) if "&" in text else ():
            char = html.unescape(m.group())
            if len(char) != 1:
                continue
            length += m.start() - at + 1
            out += [text[at : m.start()], char]
            self.entities.add(length - 1)
            at, shift = m.end(), m.end() - length
            self.starts.append(length)
            self.shifts.append(shift)
        self.text = "".join([*out, text[at:]]) if out else text

    def written(self, place: int) -> int:
        return place + self.shifts[bisect_right(self.starts, place) - 1]

    def end(self, at: int, stop) -> int:
        """The first character from a place on that ends a value and isn't an entity."""
        return next((m.start() for m in stop.finditer(self.text, at) if m.start() not in self.entities), len(self.text))


def snake(key: str) -> str:
    key = regex.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", key)
    return regex.sub(r"-+", "_", regex.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key)).lower()


def is_credential(key: str) -> bool:
    name = snake(key)
    return name in KEYS or any(name == e or name.endswith("_" + e) for e in ENDINGS)


def _value(text: Decoded, at: int, key: str) -> tuple[int, int]:
    """Start and end of the value that begins at a place of the decoded text."""
    quote = text.text[at : at + 1]
    if quote and quote in "\"'":
        closing = regex.compile(rf"(?:\\.|[^\\{quote}\r\n])*+{quote}").match(text.text, at + 1)
        if closing:
            return at + 1, closing.end() - 1
    name = snake(key)
    if name in ("authorization", "proxy_authorization"):
        scheme = _SCHEME.match(text.text, at)
        return at, text.end(scheme.end() if scheme else at, _HEADER)
    return at, text.end(at, _LINE if _PHRASE_KEY.search(name) else _WORD)


def assignments(text: str) -> list[tuple[int, int]]:
    """Where the values of credential keys are written, left to right."""
    decoded, found, at = Decoded(text), [], 0
    while m := _ASSIGNED.search(decoded.text, at):
        at, key = m.end(), m["quoted"] or m["bare"]
        if is_credential(key):
            start, end = _value(decoded, at, key)
            if end > start:
                found.append((decoded.written(start), decoded.written(end - 1) + 1 if end - 1 not in decoded.entities else decoded.written(end)))
                at = max(at, end)
    return found


def redact(text: str) -> tuple[str, int]:
    """The text without its credentials, and how many there were."""
    text, blocks = _BLOCK.subn(BLOCK, text)
    spans = assignments(text)
    for start, end in reversed(spans):
        text = text[:start] + VALUE + text[end:]
    text, tokens = _WEB_TOKEN.subn(WEB_TOKEN, text)
    text, keys = _ACCESS_KEY.subn(ACCESS_KEY, text)
    return text, blocks + len(spans) + tokens + keys


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("count", T.LongType())])


@F.pandas_udf(_RESULT)
def _redacted(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, 0) if t is None else redact(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "count"])


def redact_credentials(text: Column) -> Column:
    """A struct of the ``text`` without credentials and their ``count``; null stays null, with none. Texts that hold nothing a credential could begin with stay in the JVM."""
    may = text.rlike(r"(?i)[:=&]|-----BEGIN|eyJ|AKIA")
    found = _redacted(F.when(may, text))
    return F.when(may, found).otherwise(F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("count")))
