"""Inert copies of captured pages: an HTML tokenizer with an allow-list of elements and attributes.

What isn't listed doesn't pass, so a new element or attribute is harmless until someone lists it. Text stays, but for elements whose content is no text. Nothing that is kept can load or run:
addresses become data attributes.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that go with all that they hold.
REMOVED = frozenset("applet audio button datalist embed form frame frameset iframe math noscript object plaintext script select style svg template textarea video xmp".split())
#: Elements that stay.
KEPT = frozenset("a abbr address article aside b bdi bdo blockquote br caption cite code col colgroup dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd li main mark nav ol p picture pre q rp rt ruby s samp section small span strong sub summary sup table tbody td tfoot th thead time title tr u ul var wbr".split())
#: Of these, the ones without an end tag.
VOID = frozenset("br col hr img wbr".split())
#: Attributes that stay, beside those that begin with aria-.
ATTRIBUTES = frozenset("alt class colspan datetime dir height headers id lang open role rowspan scope span start title width".split())
#: Attributes that hold an address.
ADDRESSES = frozenset("cite href poster src".split())
#: What an inert page may load.
POLICY = "default-src 'none'; img-src 'none'; media-src 'none'; style-src 'none'; script-src 'none'; connect-src 'none'; frame-src 'none'; object-src 'none'; base-uri 'none'; form-action 'none'"

_TOKEN = regex.compile(r"""(?s)(?P<comment><!--(?:.*?-->|.*))|<(?P<tag>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|(?P<open><)|(?P<text>[^<]+)""")
_NAME = regex.compile(r"\s*(/?)\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = regex.compile(r"""(?s)([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_SCHEME = regex.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")


def _escaped(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def address(value: str) -> str | None:
    """An address as data: http, https, mailto or relative, without a user's name and password; null for others."""
    plain = "".join(c for c in value if c > "\x1f").strip()
    scheme = _SCHEME.match(plain)
    if scheme and scheme.group().lower() not in ("http:", "https:", "mailto:"):
        return None
    return regex.sub(r"^((?i:https?):)?//[^/?#@]*@", r"\1//", plain)


def attributes(inside: str, at: int) -> str:
    """The attributes of a tag that stay, from a place in it on, as far as the first slash between attributes."""
    out = []
    while at < len(inside):
        if inside[at].isspace():
            at += 1
            continue
        if inside[at] == "/":
            break
        found = _ATTRIBUTE.match(inside, at)
        if found is None:
            at += 1
            continue
        at = found.end()
        name, value = found[1].lower(), next((g for g in found.groups()[1:] if g is not None), None)
        if name in ADDRESSES:
            held = address(value) if value is not None else None
            out += [f'data-captured-{name}="{_escaped(held)}"'] if held is not None else []
        elif name in ATTRIBUTES or name.startswith("aria-"):
            out.append(name if value is None else f'{name}="{_escaped(value)}"')
    return "".join(f" {x}" for x in out)


def inert(html: str) -> str:
    """The page's inert copy. An element that goes takes all up to its end tag, or to the end of the page; a tag that never ends is text."""
    out, at = [], 0
    while at < len(html):
        token = _TOKEN.match(html, at)
        at = token.end()
        if token["text"] is not None:
            out.append(token["text"])
        elif token["open"] is not None:
            out.append("&lt;" + html[at:].replace("<", "&lt;"))
            break
        elif token["tag"] is not None and (named := _NAME.match(token["tag"])):
            closes, name = bool(named[1]), named[2].lower()
            if name in REMOVED:
                if not closes and not token["tag"].rstrip().endswith("/"):
                    end = regex.compile(rf"(?is)</\s*{name}\b").search(html, at)
                    last = _TOKEN.match(html, end.start()) if end else None
                    at = len(html) if last is None or last["tag"] is None else last.end()
            elif name in KEPT and closes:
                out.append("" if name in VOID else f"</{name}>")
            elif name in KEPT:
                out.append(f"<{name}{attributes(token['tag'], named.end())}>")
    return "".join(out)


@F.pandas_udf(T.StringType())
def _inert(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: None if x is None else inert(x))


def sanitize_html(html: Column) -> Column:
    """The inert copy of each page; null stays null."""
    return _inert(html)


def evidence(html: Column) -> Column:
    """An inert copy as a page of its own, which may load nothing."""
    head = f'<!doctype html>\n<html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><meta name="referrer" content="no-referrer"></head><body><main data-captured-source="true">'
    return F.concat(F.lit(head), sanitize_html(html), F.lit("</main></body></html>\n"))
