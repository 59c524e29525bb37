"""URL filter: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A listed URL is a host and a path prefix. It fits a page whose host is that host or one below
it and whose path starts with that path; the longest that fits decides. A page's possible
entries are its host and the hosts above it, each with the path cut to the lengths that occur
in the list. Those go through the Bloom filter, inside the row; only distinct (host, path)
pairs with a possible hit go on to the exact join, which removes the false positives.

The filter has ``blocks`` blocks of eight 32-bit words (2,048 blocks: 64 KB), whatever the
list's length: a longer list lets more pages through to the join, which stays exact.
Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

#: The listed URLs of the query and their verdicts.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The eight odd multipliers of the published split-block Bloom filter; each chooses one bit of a word.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def host_and_path(url: str = "url") -> tuple:
    """Expressions for a URL's host and path; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: str, blocks: int) -> str:
    return f"pmod(shiftrightunsigned({key}, 32), {blocks})"


def _bit(key: str, i: int) -> str:
    """One of 32 bits, from 31 low bits of the hash (the product stays below 2**63)."""
    return f"cast(shiftrightunsigned(({key} & 2147483647L) * {SALTS[i]}L & 4294967295L, 27) as int)"


def bloom(keys: DataFrame, blocks: int) -> list[list[int]]:
    """The filter of the column ``h`` (64-bit hashes): at most ``blocks`` rows of eight words come to the driver."""
    words = keys.groupBy(F.expr(_block("h", blocks)).alias("b")).agg(*(F.expr(f"bit_or(shiftleft(1L, {_bit('h', i)}))").alias(f"w{i}") for i in range(8)))
    out = [[0] * 8 for _ in range(blocks)]
    for r in words.collect():
        out[r.b] = list(r)[1:]
    return out


def may_hold(h: str, blocks: int) -> str:
    """SQL for whether the filter in the column ``vellum_bloom`` (an array of words) may hold a hash."""
    at = f"{_block(h, blocks)} * 8"
    return " AND ".join(f"(shiftrightunsigned(vellum_bloom[cast({at} + {i} as int)], {_bit(h, i)}) & 1L) = 1L" for i in range(8))


def filter_urls(pages: DataFrame, rules: DataFrame, blocks: int = 2048, small_list: int = 10_000) -> DataFrame:
    """``pages`` with ``vellum_host``, ``vellum_path``, ``vellum_rule`` and ``vellum_verdict``.

    ``rules`` has host, path and verdict. The longest rule that fits decides (ties: the smaller
    text); of repeated rules with different verdicts ``allow`` wins. Where none fits, the rule is
    null and the verdict ``allow``. Null and empty URLs have an empty host and path; repeated
    pages are judged alike; an empty list allows every page. The list is sent to all executors
    only if it has at most ``small_list`` rows, else it is joined by shuffle. A long URL has as many
    possible entries as its host has labels and the list has lengths. Other columns of ``pages`` are carried along, whatever
    their names but those above. An empty table gives no rows.
    """
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("vellum_verdict"))
    rules = rules.select(F.xxhash64("host", "path").alias("h"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("vellum_rule"), "vellum_verdict")
    n = rules.count()
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    words = F.split(F.lit(",".join(str(w) for block in bloom(rules, blocks) for w in block)), ",").cast("array<bigint>")
    host, path = host_and_path("url")
    judged = pages.withColumns({"vellum_host": host, "vellum_path": path})
    if not n:
        return judged.withColumns({"vellum_rule": F.lit(None).cast("string"), "vellum_verdict": F.lit("allow")})
    urls = judged.select("vellum_host", "vellum_path").distinct()
    labels = "split(vellum_host, '[.]', -1)"
    hosts = f"transform(sequence(0, size({labels}) - 1), i -> array_join(slice({labels}, i + 1, size({labels}) - i), '.'))"
    cuts = "filter(array(" + ", ".join(map(str, lengths)) + "), n -> n <= length(vellum_path))"
    urls = urls.withColumn("hosts", F.expr(hosts)).withColumn("paths", F.expr(f"transform({cuts}, n -> substring(vellum_path, 1, n))"))
    urls = urls.withColumn("entries", F.expr("flatten(transform(hosts, x -> transform(paths, y -> struct(x as host, y as path, xxhash64(x, y) as h))))"))
    urls = urls.withColumn("vellum_bloom", words).withColumn("entries", F.expr(f"filter(entries, e -> {may_hold('e.h', blocks)})"))
    possible = urls.select("vellum_host", "vellum_path", F.explode("entries").alias("e"))
    listed = F.broadcast(rules) if n <= small_list else rules
    exact = possible.join(listed, (F.col("e.h") == F.col("h")) & (F.col("e.host") == F.col("rule_host")) & (F.col("e.path") == F.col("rule_path")))
    longest = F.struct(-F.length("vellum_rule"), F.col("vellum_rule"))
    best = exact.groupBy("vellum_host", "vellum_path").agg(F.min_by("vellum_rule", longest).alias("vellum_rule"), F.min_by("vellum_verdict", longest).alias("vellum_verdict"))
    out = judged.join(best, ["vellum_host", "vellum_path"], "left")
    return out.select(*judged.columns, "vellum_rule", F.coalesce("vellum_verdict", F.lit("allow")).alias("vellum_verdict"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def query(spark, sf_dir) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    out = filter_urls(pick(table(spark, sf_dir, "pages"), "page_id", "url"), rules_table(spark))
    return out.select("page_id", F.col("vellum_host").alias("host"), F.col("vellum_path").alias("path"), F.col("vellum_rule").alias("rule"), F.col("vellum_verdict").alias("verdict"))


SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), m AS (
  SELECT q.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM q LEFT JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
