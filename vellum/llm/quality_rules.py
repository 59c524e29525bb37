"""Quality rules with risk-controlled cutoffs.

Each rule rejects documents whose statistic exceeds a cutoff. Cutoffs come from a fixed grid and
from labelled holdout documents: within a stratum (language), a cutoff is safe if the exact
binomial bound shows that the rule rejects at most a share ``alpha / rules`` of good documents,
at a confidence of ``1 - delta`` that holds for all strata and rules at once (Bonferroni). Within a rule
and stratum the cutoffs are tested in a fixed order, from the loosest on, until one is not safe,
which needs no correction; the last safe one is taken. Where the loosest is not safe, the rule rejects nothing.
So per stratum at most ``alpha`` of the good documents are rejected beyond the base rules. A stratum
needs at least ln(delta / tests) / ln(1 - alpha / rules) good documents (619 with the defaults) for any cutoff.

Everything is DataFrame and SQL functions. Statistics are computed once and written; the labelled
part is reduced to counts for each (stratum, rule, grid cell), a few hundred rows whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, table

_SPACE = r"[\\x20\\x09-\\x0D]"
#: Strata; documents in other languages, or none, form one more.
STRATA = ("en", "fr", "de", "es")
OTHER = "other"
#: Each rule's statistic, of the columns that :func:`statistics` adds.
RULES = {
    "symbols_per_word": "vellum_symbols / vellum_words",
    "capitals_per_char": "vellum_capitals / vellum_word_chars",
    "bangs_per_word": "vellum_bangs / vellum_words",
    "dup_lines_per_line": "vellum_dup_lines / vellum_lines",
    "repeat_words_per_word": "vellum_repeat_words / vellum_words",
}
#: The grid of every rule: shares from 0.02 to 1.6, each a quarter above the last.
GRID = tuple(round(0.02 * 1.25**i, 6) for i in range(20))

_TRIMMED = "trim(BOTH '\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D' FROM coalesce(text, ''))"


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with word, symbol, line and repetition counts of each whole text (null: no words).

    Windows of three words are compared by their 64-bit hashes within a text. Where few distinct
    windows repeat, they are looked up in a list; where many do, positions are sorted by hash.
    """
    words = docs.withColumn("vellum_w", F.expr(f"if({_TRIMMED} = '', cast(array() as array<string>), split({_TRIMMED}, '{_SPACE}+'))"))
    words = words.withColumn("vellum_l", F.expr("filter(split(coalesce(text, ''), '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    out = words.select(
        "*",
        F.expr("cast(size(vellum_w) as bigint)").alias("vellum_words"),
        F.expr("cast(length(array_join(vellum_w, '')) as bigint)").alias("vellum_word_chars"),
        F.expr("cast(regexp_count(coalesce(text, ''), '[#*$%&|<>]') as bigint)").alias("vellum_symbols"),
        F.expr("cast(regexp_count(coalesce(text, ''), '[A-Z]') as bigint)").alias("vellum_capitals"),
        F.expr("cast(regexp_count(coalesce(text, ''), '!') as bigint)").alias("vellum_bangs"),
        F.expr("cast(size(vellum_l) as bigint)").alias("vellum_lines"),
        F.expr("cast(size(vellum_l) - size(array_distinct(vellum_l)) as bigint)").alias("vellum_dup_lines"),
        F.expr("if(size(vellum_w) < 3, cast(array() as array<bigint>), slice(transform(vellum_w, (w, i) -> xxhash64(w, get(vellum_w, i + 1), get(vellum_w, i + 2))), 1, greatest(size(vellum_w) - 2, 0)))").alias("vellum_h"),
    ).drop("vellum_w", "vellum_l")
    out = out.withColumn("vellum_s", F.expr("if(size(array_distinct(vellum_h)) = size(vellum_h), cast(array() as array<bigint>), sort_array(vellum_h))"))
    out = out.withColumn("vellum_d", F.expr("array_distinct(filter(vellum_s, (x, i) -> x = get(vellum_s, i - 1)))"))
    out = out.withColumn("vellum_r", F.expr("if(size(vellum_d) <= 64, cast(array() as array<struct<x:bigint,i:int>>), sort_array(transform(vellum_h, (x, i) -> struct(x as x, i as i))))"))
    found = """CASE WHEN size(vellum_d) = 0 THEN cast(array() as array<int>)
      WHEN size(vellum_d) <= 64 THEN filter(transform(vellum_h, (x, i) -> if(array_contains(vellum_d, x), i, -1)), i -> i >= 0)
      ELSE sort_array(transform(filter(vellum_r, (r, i) -> coalesce(r.x = get(vellum_r, i - 1).x, false) OR coalesce(r.x = get(vellum_r, i + 1).x, false)), r -> r.i)) END"""
    out = out.withColumn("vellum_at", F.expr(found))
    cover = "aggregate(vellum_at, struct(0 as e, 0 as n), (a, p) -> struct(p + 3 as e, a.n + p + 3 - greatest(a.e, p) as n), a -> cast(a.n as bigint))"
    out = out.withColumn("vellum_repeat_words", F.expr(cover)).drop("vellum_h", "vellum_s", "vellum_d", "vellum_r", "vellum_at")
    return out.withColumn("vellum_base_failed", F.expr("vellum_words < 50 OR 100 * vellum_repeat_words > 50 * vellum_words"))


def cutoffs(labelled: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> dict[tuple[str, str], float]:
    """The safe cutoff of each (stratum, rule), from good documents that pass the base rules.

    ``labelled`` has vellum_stratum and the rules' statistics. At most strata x rules rows come to the driver.
    """
    share, tests = alpha / len(RULES), (len(STRATA) + 1) * len(RULES)
    grid = "array(" + ", ".join(f"{c}D" for c in GRID) + ")"
    long = labelled.select("vellum_stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES))).alias("r"))
    cells = long.groupBy("vellum_stratum", "r.rule", F.expr(f"size(filter({grid}, c -> r.value > c))").alias("cell")).count()
    tried = cells.groupBy("vellum_stratum", "rule").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("cell", "count"))).alias("by_cell"))
    tried = tried.select("vellum_stratum", "rule", "n", F.posexplode(F.expr(grid)).alias("at", "cutoff"), "by_cell")
    tried = tried.withColumn("k", F.expr("aggregate(map_keys(by_cell), 0L, (a, c) -> if(c > at, a + by_cell[c], a))"))
    odds, first = math.log(share / (1 - share)), f"n * {math.log1p(-share)}D"
    tail = f"aggregate(sequence(1L, greatest(k, 1L)), struct({first} as t, exp({first}) as s), (a, i) -> if(i > k, a, struct(a.t + ln((n - i + 1) / i) + {odds}D as t, a.s + exp(a.t + ln((n - i + 1) / i) + {odds}D) as s)), a -> a.s)"
    unsafe = tried.filter(~(F.expr(f"k < n * {share}D") & F.expr(f"{tail} <= {delta / tests}D")))
    loosest = tried.groupBy("vellum_stratum", "rule").agg(F.lit(0).alias("none")).join(unsafe.groupBy("vellum_stratum", "rule").agg(F.max("cutoff").alias("unsafe")), ["vellum_stratum", "rule"], "left").collect()
    safe = {(r.vellum_stratum, r.rule): [c for c in GRID if r.unsafe is None or c > r.unsafe] for r in loosest}
    return {k: min(c) for k, c in safe.items() if c}


def with_rules(stats: DataFrame) -> DataFrame:
    """The statistics with each rule's value (0 where there is nothing to divide by) and the stratum."""
    stats = stats.withColumns({r: F.expr(f"coalesce(try_divide({e.split(' / ')[0]}, {e.split(' / ')[1]}), 0D)") for r, e in RULES.items()})
    return stats.withColumn("vellum_stratum", F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise(F.lit(OTHER)))


def judge(stats: DataFrame, safe: dict[tuple[str, str], float]) -> DataFrame:
    """``vellum_kept``: false if the base rules fail or a rule's value exceeds its cutoff in the document's stratum."""
    reject = F.col("vellum_base_failed")
    for (stratum, rule), cutoff in sorted(safe.items()):
        reject = reject | ((F.col("vellum_stratum") == stratum) & (F.col(rule) > cutoff))
    return stats.withColumn("vellum_kept", ~reject)


def rule_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, ``vellum_base_failed`` and ``vellum_kept`` of each document.

    Null and empty texts have no words and fail the base rules. Null or unknown languages form the
    stratum ``other``. Repeated rows are judged alike. Documents without a label, or with a null
    one, do not count for cutoffs; of repeated labels the lower holds. No labels: only the base rules reject.
    A value equal to a cutoff is not rejected. A long text is one row: its arrays take some fifty bytes a word.
    """
    stats = materialize(with_rules(statistics(pick(docs, "doc_id", "lang", "text")).drop("text")), "rules")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("vellum_quality")).filter("vellum_quality = 1").select("doc_id")
    return judge(stats, cutoffs(stats.filter("NOT vellum_base_failed").join(good, "doc_id", "left_semi"), alpha, delta))


def query(spark, sf_dir) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    out = rule_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = {"vellum_words": "n_words", "vellum_word_chars": "word_chars", "vellum_symbols": "n_symbols", "vellum_dup_lines": "n_dup_lines", "vellum_repeat_words": "n_repeat_words", "vellum_base_failed": "base_failed", "vellum_kept": "kept"}
    return out.select("doc_id", *(F.col(a).alias(b) for a, b in names.items()))


_WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_SHARE = 0.05 / len(RULES)
SQL = f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {_WS}) <> '') AS l
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'other' END AS stratum,
         len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
         length(text) - length(replace(text, '!', '')) AS n_bangs,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
), v AS (
  SELECT doc_id, stratum, base_failed, r.rule, coalesce(r.value, 0) AS value
  FROM (SELECT doc_id, stratum, base_failed, unnest([
    {{'rule': 1, 'value': n_symbols / nullif(n_words, 0)}}, {{'rule': 2, 'value': n_capitals / nullif(word_chars, 0)}},
    {{'rule': 3, 'value': n_bangs / nullif(n_words, 0)}}, {{'rule': 4, 'value': n_dup_lines / nullif(n_lines, 0)}},
    {{'rule': 5, 'value': n_repeat_words / nullif(n_words, 0)}}]) AS r FROM b)
), good AS (
  SELECT v.* FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)
), grid AS (
  SELECT unnest([{", ".join(map(str, GRID))}])::DOUBLE AS cutoff
), t AS (
  SELECT stratum, rule, cutoff, count(*)::DOUBLE AS n, count(*) FILTER (value > cutoff) AS k FROM good, grid GROUP BY ALL
), tested AS (
  SELECT stratum, rule, cutoff, k < n * {_SHARE} AND list_sum(list_transform(range(k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln({1 - _SHARE})))) <= {0.05 / (5 * len(RULES))} AS ok FROM t
), safe AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tested a
  WHERE NOT EXISTS (SELECT 1 FROM tested b WHERE b.stratum = a.stratum AND b.rule = a.rule AND b.cutoff >= a.cutoff AND NOT b.ok) GROUP BY ALL
), bad AS (
  SELECT DISTINCT v.doc_id FROM v JOIN safe ON safe.stratum = v.stratum AND safe.rule = v.rule AND v.value > safe.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""
