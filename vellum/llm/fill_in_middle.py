"""Fill-in-the-middle: texts cut into prefix, middle and suffix, which are put in another order between marks.

Two pandas UDFs that run once an Arrow batch. The first walks a text's units (lines, or what
another pattern matches) with ``regex``'s ``finditer`` and keeps only their end offsets, in a compact array;
a hash of seed and id chooses two of them, and two lookups slice the text. The second rebuilds
the text from an output and its form. Seeds and digests are ``hashlib``'s.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, table

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A unit: a line with its end.
LINES = r"[^\n]*\n|[^\n]+"

_CUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
_RESTORED = "text string, sha256 string"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The marks, if no text without them can hold one across the place where another begins or ends."""
    for a in marks:
        if not a or any(b in a for b in marks if b is not a) or any(a.endswith(b[:i]) for b in marks for i in range(1, len(b))):
            raise ValueError(f"marks must not be empty, hold or overlap one another: {marks}")
    if len(set(marks)) < 3:
        raise ValueError(f"marks must differ: {marks}")
    return marks


def cut(doc_id, text: str | None, seed: int, units, marks: tuple[str, str, str], share: int, spm: int) -> tuple:
    """One text's row of ``_CUT``. ``units`` is a compiled pattern."""
    text, name = text or "", "" if doc_id is None else str(doc_id)
    drawn = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
    ends = array("q", [0])
    ends.extend(m.end() for m in units.finditer(text))
    n = len(ends) - 1
    if not text or any(m in text for m in marks) or h3 % 100 >= share:
        return n, "plain", None, None, text, _digest(text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first], ends[second]
    before, within, after = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    form, output = ("spm", after + before + within) if h4 % 100 < spm else ("psm", before + after + within)
    return n, form, a, b - a, output, _digest(output)


def restore(output: str | None, form: str | None, marks: tuple[str, str, str]) -> str | None:
    """The text of an output of ``cut``; null for a null form, and for an output that the form can't have made."""
    if form == "plain":
        return output or ""
    order = {"psm": (0, 1, 2), "spm": (1, 0, 2)}.get(form)
    if order is None or output is None or not output.startswith(marks[order[0]]):
        return None
    second = output.find(marks[order[1]])
    third = output.find(marks[2], second)
    if second < 0 or third < 0:
        return None
    starts = (0, second, third, len(output))
    part = {k: output[starts[i] + len(marks[k]) : starts[i + 1]] for i, k in enumerate(order)}
    return part[0] + part[2] + part[1]


def _cutter(seed: int, pattern: str, marks: tuple[str, str, str], share: int, spm: int):
    columns = [f.split(" ")[0] for f in _CUT.split(", ")]

    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        units = regex.compile(pattern)
        rows = [cut(i, t, seed, units, marks, share, spm) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return F.pandas_udf(run, _CUT)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """A struct of the rebuilt ``text`` and its ``sha256``, both null where nothing can be rebuilt."""
    marks = _checked(marks)

    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [restore(o, f, marks) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": [None if t is None else _digest(t) for t in texts]}, dtype=object)

    return F.pandas_udf(run, _RESTORED)(output, form)


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 7, pattern: str = LINES, marks: tuple[str, str, str] = MARKS, share: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with ``vellum_n`` (units), ``vellum_form``, ``vellum_prefix_chars``, ``vellum_middle_chars``, ``vellum_output`` and ``vellum_output_sha256``.

    ``share`` percent of texts are cut, ``spm`` percent of these with the suffix first; the rest, empty texts and texts that hold a mark stay
    ``plain``, with null lengths. ``pattern`` must match every character of a text, once. A null text is empty, a null id counts as no text
    in the seed. Repeated rows are cut alike. A text is cut whole whatever its length; beside it a task holds one batch and its outputs.
    Other columns are carried along, whatever their names but those above. An empty table gives no rows.
    """
    marks = _checked(marks)
    clash = sorted(c for c in docs.columns if c in {"vellum_fim", *(f"vellum_{f.split(' ')[0]}" for f in _CUT.split(", "))})
    if clash:
        raise ValueError(f"columns of these names are added here: {clash}")
    cutter = _cutter(seed, pattern, marks, share, spm)
    out = docs.withColumn("vellum_fim", cutter(F.col(f"`{id}`").cast("string"), F.col(f"`{text}`")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"vellum_fim.{f.split(' ')[0]}").alias(f"vellum_{f.split(' ')[0]}") for f in _CUT.split(", ")))


def query(spark, sf_dir) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    out = fill_in_middle(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    back = restored(F.col("vellum_output"), F.col("vellum_form"))
    return out.select("doc_id", F.col("vellum_n").alias("n"), F.col("vellum_form").alias("form"), F.col("vellum_prefix_chars").alias("prefix_chars"), F.col("vellum_middle_chars").alias("middle_chars"), F.col("vellum_output_sha256").alias("output_sha256"), back["sha256"].alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
         [('0x' || substr(h, 1 + 8 * i, 8))::bigint for i in [0, 1, 2, 3]] AS r FROM d
), c AS (
  SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
              WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suf FROM c
)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::bigint END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::bigint END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
