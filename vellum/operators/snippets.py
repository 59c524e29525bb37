"""Where a text matches a query, in the text as it was written: line, place and the words around it.

Texts are compared in NFC and lower case, which changes lengths: a composed character is one where the written text has several, and some letters grow when lowered.
Places in the folded text are therefore mapped back by graphemes: the folded widths of a line's graphemes are added up until the place is reached.
"""

from __future__ import annotations

import unicodedata
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is shown before the match, and in all.
BEFORE, WIDTH = 180, 600
_GRAPHEMES = regex.compile(r"\X")
_BLANK = regex.compile(r"[\s﻿]+")
_FOUND = "line int, offset int, snippet string"


def folded(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def written_offset(line: str, place: int) -> int:
    """The place in a written line of a place in the folded line: the start of the grapheme that covers it."""
    starts = [m.span() for m in _GRAPHEMES.finditer(line)]
    ends = accumulate(len(folded(line[a:b])) for a, b in starts)
    return next((a for (a, _), end in zip(starts, ends, strict=True) if end > place), len(line))


def first_match(text: str, phrase: str, terms: list[str]) -> tuple[int, int] | None:
    """(line from 1, offset in code points) of the phrase, else of the first term that occurs; the phrase and terms are folded."""
    low = folded(text)
    place = next((at for what in (phrase, *terms) if (at := low.find(what)) >= 0), -1)
    if place < 0:
        return None
    line, start = low.count("\n", 0, place), low.rfind("\n", 0, place) + 1
    written = 0
    for _ in range(line):
        written = text.index("\n", written) + 1
    end = text.find("\n", written)
    return line + 1, written + written_offset(text[written : end if end >= 0 else len(text)], place - start)


def around(text: str, offset: int) -> str:
    start = max(0, offset - BEFORE)
    end = min(len(text), start + WIDTH)
    return ("…" if start else "") + _BLANK.sub(" ", text[start:end]).strip(" ") + ("…" if end < len(text) else "")


def _matcher(phrase: str, terms: list[str]):
    def run(texts: pd.Series, summaries: pd.Series) -> pd.DataFrame:
        rows = []
        for text, summary in zip(texts, summaries, strict=True):
            found = first_match(text, phrase, terms) if text is not None else None
            rows.append((None, None, summary) if found is None else (*found, around(text, found[1])))
        out = pd.DataFrame(rows, columns=["line", "offset", "snippet"])
        return out.astype({"line": "Int32", "offset": "Int32"})

    return F.pandas_udf(run, _FOUND)


def exact_match(text: Column, phrase: str, terms: list[str], summary: Column | None = None) -> Column:
    """A struct of ``line``, ``offset`` (code points) and ``snippet`` for a folded phrase and its folded terms.

    Up to 600 characters from 180 before the match, white space as single blanks, with ellipses where the text goes on. A text that matches nothing, or is null, has its summary as
    snippet and no line. Texts without a match leave the JVM only if they hold characters that folding in the JVM could miss.
    """
    plain = text.rlike(r"^[\x{0000}-\x{02FF}]*$")
    low = F.lower(text)
    hit = F.lit(False)
    for what in (phrase, *terms):
        hit = hit | F.contains(low, F.lit(what))
    summary = F.lit(None).cast("string") if summary is None else summary
    return _matcher(phrase, list(terms))(F.when(~plain | hit, text), summary)
