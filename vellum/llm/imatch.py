"""I-Match fingerprints: hashes of a text's terms that several randomised subsets of a lexicon hold.

Terms are a text's distinct words in lower case. The lexicon holds the terms whose inverse document frequency over
all documents, ln(documents / documents with the term), lies in a band. There are ``FAMILIES`` families of subsets; each takes a
term by three hex digits of the term's SHA-256, and has a subset of a 4,096th of the lexicon, of a 512th, a 64th and an eighth, one inside the next.
Subsets are random, fixed, and need no table of their own. A signature is a hash of the sorted terms of the text that a subset holds.

Signatures of sparse subsets survive an edit that changes many terms, those of dense ones only small edits. The likeness of two fingerprints is the share of
families that agree; a family is judged by its sparsest subset in which either text has a term, so that long and short texts are compared by a few terms a family.

Everything is DataFrame and SQL functions. Document frequencies are counted over all documents by the terms' 64-bit hashes. A term in the band occurs in
at least a share exp(-band[1]) of the documents, so the lexicon has at most (mean distinct words a document) / exp(-band[1]) terms, whatever the
number of documents: 330,000 for 330 words and the default band. It reaches the tasks as a literal in the plan, an array of short lists found by hash.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pick, table

#: Least and largest inverse document frequency of the lexicon's terms: in at most 5 % and at least 0.1 % of the documents, and in two.
BAND = (3.0, 6.9)
#: Limits of three hex digits, from the sparsest subsets to the densest, and how many families of such subsets there are.
LIMITS, FAMILIES = ("001", "008", "040", "200"), 8
#: Most terms of a lexicon: 32 MB.
LARGEST = 4_000_000
_NONE = "0" * 8
#: The id that a null one counts as.
_NULL_ID = -(1 << 63)


def terms(text: str) -> str:
    """SQL for the distinct terms of a text (null: none)."""
    return f"array_distinct(array_remove(split(lower(coalesce({text}, '')), '[\\\\x20\\\\x09-\\\\x0D]+'), ''))"


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """The hashes ``h`` of the terms in the band, over all of ``docs``; written once."""
    n = docs.count()
    least, most = max(2, math.ceil(n * math.exp(-band[1]))), math.floor(n * math.exp(-band[0]))
    hashes = docs.select(F.explode(F.expr(f"transform({terms(f'`{text}`')}, w -> xxhash64(w))")).alias("h"))
    held = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most))
    return materialize(held.select("h"), "lexicon")


def _buckets(words: DataFrame) -> tuple[str, int]:
    """SQL for a literal array of lists of hashes, and its length; a hash is in the list at its remainder. At most ``LARGEST`` hashes come to the driver."""
    hashes = [r.h for r in words.limit(LARGEST + 1).collect()]
    if len(hashes) > LARGEST:
        raise ValueError(f"the lexicon has more than {LARGEST} terms: choose a band with a smaller largest inverse document frequency")
    size = 1 << max(0, len(hashes) - 1).bit_length()
    lists: list[list[int]] = [[] for _ in range(size)]
    for h in sorted(hashes):
        lists[h % size].append(h)
    return f"from_json('{json.dumps(lists, separators=(',', ':'))}', 'array<array<bigint>>')", size


def fingerprint(docs: DataFrame, words: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a text column's fingerprint: 32 signatures of 8 hex digits, family by family, sparse subsets first.

    ``words`` has the lexicon's hashes. A subset without a term of the text has the signature of zeros; where all have, as in texts without a term of the
    lexicon, every signature is a hash of all terms of the text. Equal texts have equal fingerprints, at any length; null texts count as empty ones,
    and an empty lexicon or table is no special case. ``docs`` may have any other columns.
    """
    lists, size = _buckets(words)
    n, digits = FAMILIES * len(LIMITS), "substr(x.s, 1 + 3 * e, 3)"
    found = f"sort_array(filter(t, w -> array_contains(get({lists}, cast(pmod(xxhash64(w), {size}L) AS int)), xxhash64(w))))"
    inner = ", ".join(f"filter(f, x -> {digits} < '{limit}')" for limit in LIMITS[:-1])
    family = _let("f", f"filter(h, x -> {digits} < '{LIMITS[-1]}')", f"array({inner}, f)")
    subsets = f"flatten(transform(sequence(0, {FAMILIES - 1}), e -> {family}))"
    signatures = f"array_join(transform({subsets}, s -> if(size(s) = 0, '{_NONE}', substr(md5(array_join(s.w, ' ')), 1, 8))), '')"
    whole = f"repeat(substr(md5(concat('-', array_join(sort_array(t), ' '))), 1, 8), {n})"
    either = _let("p", _let("h", f"transform({found}, w -> struct(w AS w, sha2(w, 256) AS s))", signatures), f"if(p = repeat('{_NONE}', {n}), {whole}, p)")
    return docs.withColumn(name, F.expr(_let("t", terms(f"`{text}`"), either)))


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with a value computed once; a column of its own could be put into lambdas by the optimizer, and computed for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def likeness(a: str, b: str) -> Column:
    """From 0 to 1, of two fingerprint columns; 1 for equal ones."""
    pair = "struct(substr(`{}`, 1 + 8 * ({} * e + l), 8) AS x, substr(`{}`, 1 + 8 * ({} * e + l), 8) AS y)".format(a, len(LIMITS), b, len(LIMITS))
    first = f"filter(transform(sequence(0, {len(LIMITS) - 1}), l -> {pair}), p -> p.x <> '{_NONE}' OR p.y <> '{_NONE}')"
    judged = f"filter(transform(sequence(0, {FAMILIES - 1}), e -> get({first}, 0)), p -> p IS NOT NULL)"
    return F.expr(f"size(filter({judged}, p -> p.x = p.y)) / size({judged})")


def following(keys: DataFrame) -> DataFrame:
    """``keys`` (distinct, column ``key``) with ``next``: the next lower key, and after the lowest the highest.

    Keys are dealt out by range and followed within each partition; only one row a partition meets the others.
    """
    dealt = materialize(keys.repartitionByRange(F.desc("key")).withColumn("part", F.spark_partition_id()), "keys")
    heads = dealt.groupBy("part").agg(F.max("key").alias("head"))
    top = heads.agg(F.max("head").alias("top"))
    heads = heads.select("part", F.lead("head").over(W.orderBy("part")).alias("head")).crossJoin(F.broadcast(top))
    ahead = dealt.withColumn("next", F.lead("key").over(W.partitionBy("part").orderBy(F.desc("key"))))
    return ahead.join(F.broadcast(heads), "part").withColumn("next", F.coalesce("next", "head", "top")).drop("part", "head", "top")


def edited_likeness(docs: DataFrame, id: str = "doc_id", text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many of the next document, by
    descending id; after the last comes the first. A null id counts as the smallest 64-bit integer. Rows that share an id share the next document: the next
    lower id, and of several rows with that id the one whose beginning, as far as it is needed, sorts first. A null text is empty.
    Other columns are left out. An empty table gives no rows, a single document follows itself.

    Texts shuffle once by id, for both roles of a document, and once more as beginnings.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id}`").cast("bigint"), F.lit(_NULL_ID)).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words = lexicon(rows, band=band)
    keys = rows.groupBy("key").agg(F.max(F.expr("length(text) DIV 3")).alias("k"))
    links = following(keys).select(F.col("key").alias("of"), "k", "next")
    printed = fingerprint(rows, words, "fingerprint")
    ahead = printed.join(links, F.col("key") == F.col("next"))
    ahead = ahead.groupBy("of").agg(F.min(F.struct(F.expr("substr(text, 1, k)").alias("start"), F.col("fingerprint").alias("next_fingerprint"))).alias("n"))
    out = printed.join(ahead, F.col("key") == F.col("of")).withColumn("n_chars", F.length("text").cast("bigint"))
    out = out.withColumn("edited", F.expr("concat(substr(text, 1, int(n_chars - n_chars DIV 3)), substr(n.start, 1, int(n_chars DIV 3)))"))
    out = out.select(F.expr(f"nullif(key, {_NULL_ID + 1}L - 1L)").alias("doc_id"), "n_chars", "edited", "fingerprint", F.col("n.next_fingerprint").alias("next_fingerprint"))
    out = fingerprint(out, words, "edited_fingerprint", "edited")
    return out.withColumns({"near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "next_fingerprint")}).drop("next_fingerprint")


def query(spark, sf_dir) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    out = edited_likeness(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


SQL = """
WITH d AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS id, doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::bigint AS n FROM documents
), e AS (
  SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS following, coalesce(lead(id) OVER w, first_value(id) OVER w) AS next FROM d WINDOW w AS (ORDER BY id DESC)
), x AS (
  SELECT id, 0 AS e, t FROM e UNION ALL SELECT id, 1, substr(t, 1, n - n // 3) || substr(following, 1, n // 3) FROM e
), w AS (
  SELECT id, e, t, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D]+'), lambda s: s <> ''))) AS terms FROM x
), lex AS (
  SELECT term FROM (SELECT unnest(terms) AS term FROM w WHERE e = 0) GROUP BY term
  HAVING count(*) >= greatest(2, ceil((SELECT count(*) FROM d) * exp(-6.9))) AND count(*) <= floor((SELECT count(*) FROM d) * exp(-3.0))
), hit AS (
  SELECT id, e, term, sha256(term) AS s FROM (SELECT id, e, unnest(terms) AS term FROM w) JOIN lex USING (term)
), k AS (
  SELECT k, 1 + 3 * (k // 4) AS pos, ['001', '008', '040', '200'][k % 4 + 1] AS lim FROM (SELECT unnest(range(32)) AS k)
), sig AS (
  SELECT id, e, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS sig FROM hit JOIN k ON substr(s, pos, 3) < lim GROUP BY id, e, k
), held AS (SELECT DISTINCT id, e FROM sig), f AS (
  SELECT w.id, w.e, k.k, CASE WHEN held.id IS NULL THEN substr(md5('-' || coalesce(array_to_string(terms, ' '), '')), 1, 8) ELSE coalesce(sig, '00000000') END AS sig
  FROM w CROSS JOIN k LEFT JOIN sig USING (id, e, k) LEFT JOIN held ON held.id = w.id AND held.e = w.e
), pair AS (
  SELECT a.id, 'edited' AS what, a.k, a.sig AS x, b.sig AS y FROM f a JOIN f b ON a.id = b.id AND a.k = b.k AND a.e = 0 AND b.e = 1
  UNION ALL SELECT a.id, 'next', a.k, a.sig, b.sig FROM f a JOIN e ON a.id = e.id AND a.e = 0 JOIN f b ON b.id = e.next AND b.e = 0 AND a.k = b.k
), near AS (
  SELECT id, what, avg((x = y)::int) AS near
  FROM (SELECT * FROM pair WHERE x <> '00000000' OR y <> '00000000' QUALIFY row_number() OVER (PARTITION BY id, what, k // 4 ORDER BY k) = 1) GROUP BY id, what
), fp AS (SELECT id, e, string_agg(sig, '' ORDER BY k) AS fp FROM f GROUP BY id, e)
SELECT e.doc_id, e.n AS n_chars, sha256(x.t) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, m.near AS near_edited, o.near AS near_next
FROM e JOIN x ON x.id = e.id AND x.e = 1 JOIN fp a ON a.id = e.id AND a.e = 0 JOIN fp b ON b.id = e.id AND b.e = 1
JOIN near m ON m.id = e.id AND m.what = 'edited' JOIN near o ON o.id = e.id AND o.what = 'next'
"""
