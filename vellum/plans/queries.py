"""Queries over the driver's tables by name, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..operators import authoring as A
from ..operators import capture as C
from ..operators import credentials as CR
from ..operators import evaluate as E
from ..operators import evaluation_corpus as EC
from ..operators import graph as G
from ..operators import history as H
from ..operators import markup as MK
from ..operators import memory as M
from ..operators import mentions as MN
from ..operators import pdf as P
from ..operators import platform_threads as PT
from ..operators import query as Q
from ..operators import retrievers as R
from ..operators import search as S
from ..operators import snippets as SN
from ..operators import threads as TH
from ..sources.tables import table, view, with_views
from ..streaming import events as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: two tags, numbers and labels as metadata."""
    n = view(spark, sf_dir, "notes")
    return n.withColumns({
        "aliases": F.array(F.concat(F.lit("doc "), F.col("note_idx").cast("string"))),
        "tags": F.array_compact(F.array("tag_lang", "tag_source")),
        "metadata_text": F.concat(F.lit('{"lang":"'), F.coalesce("tag_lang", F.lit("")), F.lit('","source":"'), F.coalesce("tag_source", F.lit("")), F.lit('","n_chars":'), F.coalesce(F.col("n_chars").cast("string"), F.lit("")), F.lit("}")),
        "metadata": F.parse_json(F.to_json(F.struct(F.col("tag_lang").alias("lang"), F.struct(F.col("tag_source").alias("name"), F.array(F.lit("a"), F.col("tag_lang")).alias("kinds")).alias("source"), "n_chars", "quality", "toxic"))),
    })


# --- text functions -----------------------------------------------------------------------------


@query("norm_text", "select doc_id, sha256(lower(nfc_normalize(text))) as folded from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.norm_text(F.col("text")), 256).alias("folded"))


@query("norm_tag", "select doc_id, lower(nfc_normalize(regexp_replace(trim('  ##' || source || ' '), '^#+', ''))) as tag from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.norm_tag(F.concat(F.lit("  ##"), "source", F.lit(" "))).alias("tag"))


@query("normalize_tags", "select doc_id, case when lower(lang) = lower(source) then lower(lang) else lower(lang) || ',' || lower(source) end as tags from documents")
def _(spark, d):
    tags = F.array(F.concat(F.lit("#"), F.upper("lang")), F.col("lang"), F.lit("#"), F.concat(F.lit(" "), "source"))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.normalize_tags(tags), ",").alias("tags"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query("search_terms", f"""
with r as (select item_id, list_distinct(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}._/-]*')) as t from benchmark),
k as (select item_id, t, list_filter(t, lambda x: length(x) > 1 and x not in ({_STOP})) as f from r)
select item_id, array_to_string(list_sort(case when len(f) > 0 then f else t end), ' ') as terms, len(case when len(f) > 0 then f else t end) as n from k""")
def _(spark, d):
    t = X.search_terms(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(t), " ").alias("terms"), F.size(t).cast("bigint").alias("n"))


@query("count_words", "select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{000B}\\x{00A0}\\x{2028}\\x{2029}\\x{3000}\\x{FEFF}]+'), lambda x: x <> '')) as words from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_words(F.col("text")).alias("words"))


@query("phrase_offset", "select doc_id, case when text is null then null else length(regexp_extract(lower(text), '(?s)^(.*?)(?:^|[^a-z0-9])the(?:[^a-z0-9]|$)', 0)) > 0 end as found from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (X.phrase_offset(F.col("text"), "the") >= 0).alias("found"))


@query("concept_key", "select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '^#+', ''), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') as key from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.concept_key(F.concat("p_name", F.lit(" / "), "p_type")).alias("key"))


@query("slugify", "select doc_id, rtrim(left(trim(regexp_replace(replace(lower(nfc_normalize(text)), '''', ''), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), 80), '-') as slug from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query("scope_hub_id", "select n_nationkey, 'scopes/' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') || '--' || left(sha256(n_name), 12) as hub from nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.scope_hub_id(F.col("n_name")).alias("hub"))


@query("canonical_path", """
select page_id, case when p = '' then 'empty' when p like '/%' then 'absolute' when regexp_matches(p, '[*?\\[\\]{}]') then 'glob'
  when regexp_matches(p, '(^|/)(\\.\\.?|)(/|$)') then 'segment' end as error
from (select page_id, replace(regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1), '#', '/../') as p from pages)""")
def _(spark, d):
    p = F.replace(F.regexp_extract("url", "^[a-z]+://[^/]+/?(.*)$", 1), F.lit("#"), F.lit("/../"))
    return table(spark, d, "pages").select("page_id", X.canonical_path_error(p).alias("error"))


@query("utf8_prefix", "select doc_id, left(text, list_max(list_filter(range(0, 101), lambda k: octet_length(encode(left(text, k))) <= 100))) as head from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.utf8_prefix(F.col("text"), 100).alias("head"))


@query("calendar_date", "select o_orderkey, try_cast(s as date) as day from (select o_orderkey, '1996-02-' || lpad(cast(o_orderkey % 33 as varchar), 2, '0') as s from orders)")
def _(spark, d):
    s = F.concat(F.lit("1996-02-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", X.calendar_date(s).alias("day"))


@query("normalize_predicate", "select o_orderkey, regexp_replace(lower(trim(' ' || o_orderpriority || '_IS ')), '[_\\s]+', '-', 'g') as predicate from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.normalize_predicate(F.concat(F.lit(" "), "o_orderpriority", F.lit("_IS "))).alias("predicate"))


@query("compact_count", "select p_partkey, case p_size % 3 when 0 then p_size when 1 then p_size * 1000 + 500 else p_size * 1000000 + 500000 end as n from part")
def _(spark, d):
    s = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5K"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5m")))
    return table(spark, d, "part").select("p_partkey", X.compact_count(s).alias("n"))


# In the documents, credentials are quoted values of the key token.
@query("redact_credentials", """select doc_id, sha256(regexp_replace(text, '\\b((?i:token)\\s*[=:]\\s*")[^"\\r\\n]+(")', '\\1[REDACTED]\\2', 'g')) as clean, coalesce(len(regexp_extract_all(text, '\\b(?i:token)\\s*[=:]\\s*"[^"\\r\\n]+"')), 0)::bigint as count from documents""")
def _(spark, d):
    found = table(spark, d, "documents").select("doc_id", CR.redact_credentials(F.col("text")).alias("r"))
    return found.select("doc_id", F.sha2("r.text", 256).alias("clean"), "r.count")


@query("redact_machine_paths", """select page_id, case page_id % 4 when 0 then 'see <home>/' || page_id when 1 then '<home>\\d ' || page_id when 2 then 'in <temp> ' || page_id else 'http://' || page_id || '/x' end as clean from pages""")
def _(spark, d):
    """Home folders of two kinds of systems, temporary folders, and texts without either, each with the row's number in it."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    text = F.when(k == 0, F.concat(F.lit("see /home/u"), n, F.lit("/"), n)).when(k == 1, F.concat(F.lit("C:\\Users\\u"), n, F.lit("\\d "), n)).when(k == 2, F.concat(F.lit("in /private/tmp/a"), n, F.lit("/b "), n)).otherwise(F.concat(F.lit("http://"), n, F.lit("/x")))
    return table(spark, d, "pages").select("page_id", X.redact_machine_paths(text).alias("clean"))


@query("sanitize_terminal", "select doc_id, sha256(replace(text, chr(9), '    ')) as clean from documents")
def _(spark, d):
    s = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m‮"))
    return table(spark, d, "documents").select("doc_id", F.sha2(X.sanitize_terminal(s), 256).alias("clean"))


# --- URL functions ------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^(?i:https?)://([^/?#:]*)', 1))"


@query("canonicalize_url", """
with p as (select page_id, regexp_extract(url, '^([^?#]*)', 1) as base, regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) as q from pages),
k as (select page_id, base, list_filter(string_split(q, '&'), lambda x: x <> '' and not starts_with(lower(split_part(x, '=', 1)), 'utm_') and lower(split_part(x, '=', 1)) not in ('fbclid', 'gclid', 'dclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', 'mibextid')) as q from p)
select page_id, case when len(q) > 0 then base || '?' || array_to_string(q, '&') else base end as url from k""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonicalize(F.col("url")).alias("url"))


@query("source_url_identity", f"""
select page_id, case when regexp_matches(url, '^(?i:https?)://[^/?#]') then lower(regexp_extract(url, '^((?i:https?))://', 1)) || '://' || {_HOST}
  || (case when starts_with(rest, '/') then rest else '/' || rest end) end as identity
from (select page_id, url, regexp_extract(regexp_replace(url, '#.*$', ''), '^(?i:https?)://[^/?#]*(.*)$', 1) as rest from pages)""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.identity(F.col("url")).alias("identity"))


_ROUTED = ["https://x.com/user_1/status/{n}?s=20", "https://mobile.twitter.com/u/likes/{n}", "https://news.ycombinator.com/item?a=b&id={n}", "https://old.reddit.com/r/sub/comments/a{n}/title/c{n}/", "https://redd.it/b{n}", "https://bsky.app/profile/me.test/post/p{n}", "https://pub.substack.com/p/{n}", "https://www.youtube.com/watch?v=v{n}&t=1", "https://youtu.be/y{n}", "https://github.com/o/r/pull/{n}", "https://www.linkedin.com/posts/me_activity-{n}-x", "https://forum.example.org/t/slug/{n}", "https://www.tiktok.com/@u/video/{n}", "https://notx.com/u/status/{n}", "https://www.facebook.com/a/posts/f{n}", "https://threads.net/@u/post/t{n}"]
_ROUTES = [("x", "'handle=user_1;postId=' || n"), ("generic", "'host=mobile.twitter.com'"), ("hacker-news", "'itemId=' || n"), ("reddit", "'commentId=c' || n || ';postId=a' || n || ';subreddit=sub'"), ("reddit", "'postId=b' || n"), ("bluesky", "'actor=me.test;postId=p' || n"), ("substack", "'publication=pub'"), ("youtube", "'contentId=v' || n"), ("youtube", "'contentId=y' || n"), ("github", "'contentId=' || n || ';owner=o;repository=r;route=pull'"), ("linkedin", "'contentId=me_activity-' || n || '-x'"), ("discourse", "'topicId=' || n"), ("tiktok", "'contentId=' || n"), ("generic", "'host=notx.com'"), ("facebook", "'contentId=f' || n"), ("threads", "'contentId=t' || n")]


@query("classify_platform_url", f"""with k as (select page_id, page_id as n, url, {_HOST} as host from pages)
select page_id, 'own' as which, case when regexp_matches(url, '^(?i:https?)://[^/?#]') then 'generic' end as platform, case when regexp_matches(url, '^(?i:https?)://[^/?#]') then 'host=' || host end as ids from k
union all select page_id, 'made', case page_id % {len(_ROUTES)} {' '.join(f"when {i} then '{p}'" for i, (p, _) in enumerate(_ROUTES))} end, case page_id % {len(_ROUTES)} {' '.join(f"when {i} then {v}" for i, (_, v) in enumerate(_ROUTES))} end from k""")
def _(spark, d):
    """The pages' own URLs, and for each page one of a site's, with the page's number as its id."""
    made = F.replace(F.element_at(F.array(*map(F.lit, _ROUTED)), (F.col("page_id") % len(_ROUTED) + 1).cast("int")), F.lit("{n}"), F.col("page_id").cast("string"))
    urls = table(spark, d, "pages").select("page_id", F.explode(F.array(F.struct(F.lit("own").alias("which"), "url"), F.struct(F.lit("made").alias("which"), made.alias("url")))).alias("u")).select("page_id", "u.which", "u.url")
    out = U.classify(urls)
    ids = F.array_join(F.array_sort(F.transform(F.map_entries("vellum_ids"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return out.select("page_id", "which", F.col("vellum_platform").alias("platform"), ids.alias("ids"))


@query("is_private_host", """with v4 as (select c_custkey, 4 as version, a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168)
  or (a = 192 and b = 0) or (a = 198 and b in (18, 19)) or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113) as private
from (select c_custkey, c_custkey % 256 as a, (c_custkey * 7) % 256 as b, c_custkey % 128 as c from customer)),
v6 as (select c_custkey, 6, (f & 65024) = 64512 or (f & 65472) in (65152, 65216) or (f & 65280) = 65280 or f in (100, 256, 8194, 16382, 24320) or (f = 8193 and (g <= 511 or g = 3512)) or (f = 16383 and (g & 61440) = 0)
from (select c_custkey, case when c_custkey % 3 = 0 then 8193 else c_custkey * 977 % 65536 end as f, c_custkey * 7 % 4096 as g from customer)),
mapped as (select c_custkey, 46, private from v4)
select * from v4 union all select * from v6 union all select * from mapped""")
def _(spark, d):
    """IPv4 addresses, IPv6 ones, and the former inside the latter."""
    k, c = F.col("c_custkey"), table(spark, d, "customer")
    four = F.concat_ws(".", (k % 256).cast("string"), (k * 7 % 256).cast("string"), (k % 128).cast("string"), F.lit("9"))
    six = F.concat(F.hex(F.when(k % 3 == 0, 8193).otherwise(k * 977 % 65536)), F.lit(":"), F.lower(F.hex(k * 7 % 4096)), F.lit("::"), F.hex(k % 65536))
    each = F.array(F.struct(F.lit(4).alias("version"), four.alias("host")), F.struct(F.lit(6).alias("version"), six.alias("host")), F.struct(F.lit(46).alias("version"), F.concat(F.lit("[::ffff:"), four, F.lit("]")).alias("host")))
    return c.select("c_custkey", F.explode(each).alias("a")).select("c_custkey", "a.version", U.is_private_host(F.col("a.host")).alias("private"))


# --- filters, orders, limits --------------------------------------------------------------------


@query("filter_equals", with_views(" select id from notes where lower(tag_lang) = 'en' and quality = 1", "notes"))
def _(spark, d):
    return Q.filter_notes(notes(spark, d), [("lang", "equals", "EN"), ("quality", "equals", 1)]).select("id")


@query("filter_exists", with_views(" select id from notes where toxic is not null", "notes"))
def _(spark, d):
    return Q.filter_notes(notes(spark, d), [("toxic", "exists", True)]).select("id")


@query("filter_one_of", with_views(" select id from notes where tag_source in ('src1', 'src2', 'src7')", "notes"))
def _(spark, d):
    return Q.filter_notes(notes(spark, d), [("source.name", "one_of", ["SRC1", "src2", "src7"])]).select("id")


@query("filter_and", with_views(" select id from notes where tag_lang = 'fr' and tag_source = 'src0' and quality is null", "notes"))
def _(spark, d):
    return Q.filter_notes(notes(spark, d), [("source.kinds", "equals", "fr"), ("source.name", "equals", "src0"), ("quality", "exists", False)]).select("id")


@query("filter_tags", with_views(" select id from notes where tag_lang = 'de' and tag_source = 'src3'", "notes"))
def _(spark, d):
    return Q.filter_tags(notes(spark, d), ["#DE", " src3"]).select("id")


@query("filter_scopes", with_views(" select distinct id from scopes where scope in ('ASIA', 'EUROPE/NATION_3')", "scopes"))
def _(spark, d):
    held = view(spark, d, "scopes").groupBy("id").agg(F.collect_set("scope").alias("scopes"))
    held = held.withColumn("scopes_valid", M.scope_error(F.col("scopes")).isNull())
    return Q.filter_scopes(held, ["ASIA", "EUROPE/NATION_3"]).select("id")


@query("metadata_at_path", with_views(""" select id, tag_lang as kind, tag_source as name, case when note_idx % 3 = 1 then n_chars end as folded, case when note_idx % 3 <> 2 then 1 end as exact, null as padded, null as quoted_off, tag_lang as quoted from notes""", "notes"))
def _(spark, d):
    """Exact keys, keys that only one other spelling fits (with two it is ambiguous), canonical positions, and a key with quotes and dots in it."""
    n = notes(spark, d)
    more = F.when(F.col("note_idx") % 3 == 2, F.lit("X-Size")).otherwise(F.lit("other"))
    size = F.when(F.col("note_idx") % 3 == 0, "x-size").otherwise("X-SIZE")
    m = F.parse_json(F.to_json(F.create_map(F.lit("Source"), F.to_json(F.struct(F.array(F.lit("a"), F.col("tag_lang")).alias("Kinds"), F.col("tag_source").alias("name"))), size, F.coalesce(F.col("n_chars").cast("string"), F.lit("null")), more, F.lit("0"), F.lit("it's a \"key\""), F.to_json(F.struct(F.col("tag_lang").alias("v"))))))
    raw = n.select("id", "tag_lang", "note_idx", m.alias("m"))
    # Values were texts of JSON; as one document they are nested.
    whole = F.parse_json(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(F.try_variant_get("m", "$", "map<string,string>")), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"), e["value"])), ","), F.lit("}")))
    held = raw.select("id", "note_idx", whole.alias("m"))
    get = lambda path, kind="string": F.try_variant_get(Q.at_path(F.col("m"), path), "$", kind)
    exact = F.when(Q.at_path(F.col("m"), "X-Size").isNotNull() | (F.col("note_idx") % 3 != 2), F.when(F.col("note_idx") % 3 != 2, F.lit(1)))
    return held.select("id", get("source.kinds.1").alias("kind"), get("SOURCE.name").alias("name"), F.when(F.col("note_idx") % 3 == 1, get("x-Size", "bigint")).alias("folded"), exact.alias("exact"), get("source.kinds.01").alias("padded"), get("it's a .v").alias("quoted_off"), get('it\'s a "key".v').alias("quoted"))


@query("sort_metadata", with_views(""", k as (select id, path, note_idx, case note_idx % 7 when 0 then null when 1 then 0 when 2 then 1 when 3 then 2 when 4 then 3 when 5 then 4 else 5 end as kind,
case note_idx % 7 when 2 then note_idx % 2 when 3 then n_chars / 2.0 end as num, case note_idx % 7 when 4 then lower(coalesce(tag_source, 'None')) when 5 then '["' || lower(coalesce(tag_lang, 'x')) || '",' || note_idx % 5 || ']' when 6 then '{"a":' || note_idx % 9 || '}' end as txt from notes)
select id, row_number() over (order by kind is null, kind desc, num desc, txt desc, lower(path), note_idx) as rank from k""", "notes"))
def _(spark, d):
    """All kinds of values, from missing to objects, downwards."""
    i = F.col("note_idx") % 7
    text = F.when(i == 1, "null").when(i == 2, F.when(F.col("note_idx") % 2 == 1, "true").otherwise("false")).when(i == 3, (F.col("n_chars") / 2).cast("string")).when(i == 4, F.concat(F.lit('"'), F.coalesce("tag_source", F.lit("None")), F.lit('"')))
    text = text.when(i == 5, F.concat(F.lit('["'), F.coalesce("tag_lang", F.lit("x")), F.lit('", '), F.col("note_idx") % 5, F.lit("]"))).when(i == 6, F.concat(F.lit('{"a": '), F.col("note_idx") % 9, F.lit("}")))
    rows = view(spark, d, "notes").withColumn("value", F.try_parse_json(text))
    # A range sort needs columns that ascend: kinds and numbers are negated, and texts are ranked first.
    held = Q.checkpointed(rows.select("id", "note_idx", *(k.alias(f"k{n}") for n, k in enumerate(Q.sort_values(F.col("value"))))))
    texts = Q.ranked(held.select("k3").distinct(), ["k3"]).withColumnRenamed("rank", "t")
    placed = held.join(texts, held["k3"].eqNullSafe(texts["k3"])).select("id", "note_idx", F.col("k0").alias("missing"), (-F.col("k1")).alias("kind"), (-F.col("k2")).alias("num"), (-F.col("t")).alias("txt"), F.col("k4").alias("p"))
    ordered = Q.ranked(placed.withColumn("n", F.coalesce(F.col("num"), F.lit(float("inf")))), ["missing", "kind", "n", "txt", "p", "note_idx"])
    return ordered.select("id", "rank")


@query("sort_builtin", with_views(" select id, path from part_notes order by lower(title), path", "part_notes"))
def _(spark, d):
    return view(spark, d, "part_notes").orderBy(F.lower("title"), "path").select("id", "path")


@query("topk_per_group", """with r as (select tag_lang as lang, id, n_chars, row_number() over (partition by tag_lang order by n_chars desc, note_idx) as rank, count(*) over (partition by tag_lang) as total from notes)
select lang, id, rank, total, least(total, 5) as returned, total > 5 as truncated from r where rank <= 5""")
def _(spark, d):
    df = notes(spark, d).select(F.col("tag_lang").alias("lang"), "id", "n_chars", "note_idx")
    return Q.top_per_group(df, ["lang"], [F.col("n_chars").desc(), F.col("note_idx")], 5).select("lang", "id", F.col("rank").cast("bigint").alias("rank"), "total", "returned", "truncated")


SQL["topk_per_group"] = with_views(", " + SQL["topk_per_group"].removeprefix("with "), "notes")


@query("bounded_details", with_views(" select id, (select count(*) from notes where quality = 0) as total, least(20, (select count(*) from notes where quality = 0)) as returned, (select count(*) from notes where quality = 0) > 20 as truncated from notes where quality = 0 order by note_idx limit 20", "notes"))
def _(spark, d):
    low = notes(spark, d).filter("quality = 0").select("id", "note_idx")
    return Q.bounded_details(low, [F.col("note_idx")], 20).drop("note_idx")


@query("nearest_rank_percentile", "select quantile_disc(n_chars, 0.5) as p50, quantile_disc(n_chars, 0.95) as p95, quantile_disc(n_chars, 0.99) as p99 from documents")
def _(spark, d):
    return Q.percentile(table(spark, d, "documents"), "n_chars", 0.5, 0.95, 0.99)


@query("cumulative_budget", "select conv_id, turn, running from (select conv_id, turn, sum(octet_length(encode(text))) over (partition by conv_id order by turn) as running from conversations) where running <= 600")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("size"))
    return Q.cumulative_budget(c, "size", "turn", 600, "conv_id").select("conv_id", "turn", "running")


# --- links and relations ------------------------------------------------------------------------


@query("contextual_links", with_views(" select source, target, min(line) as line from raw_links where source <> target group by all", "raw_links"))
def _(spark, d):
    return G.contextual_links(view(spark, d, "raw_links"))


@query("backlinks", with_views(" select target, source, line from links", "links"))
def _(spark, d):
    return G.backlinks(view(spark, d, "links"))


@query("note_connections", with_views(", l as (select source, target from raw_links where source <> target group by all) select id, path, (select count(*) from l where l.target = n.path) as inbound, (select count(*) from l where l.source = n.path) as outbound from part_notes n", "raw_links", "part_notes"))
def _(spark, d):
    return G.note_connections(view(spark, d, "part_notes"), G.contextual_links(view(spark, d, "raw_links")))


@query("query_join_connections", with_views(" select n.id, count(l.source) as inbound from part_notes n left join links l on l.target = n.path where n.tag_brand = 'Brand#11' group by n.id", "links", "part_notes"))
def _(spark, d):
    n = view(spark, d, "part_notes")
    return n.filter("tag_brand = 'Brand#11'").join(G.note_connections(n, view(spark, d, "links")).select("id", "inbound"), "id").select("id", "inbound")


@query("orphans", with_views(" select id, path from part_notes where path not in (select source from sparse_links union select target from sparse_links)", "sparse_links", "part_notes"))
def _(spark, d):
    return G.orphans(view(spark, d, "part_notes"), view(spark, d, "sparse_links"))


@query("edges_among_results", with_views(" select source, target, line from links where source in (select path from part_notes where tag_brand < 'Brand#3') and target in (select path from part_notes where tag_brand < 'Brand#3')", "links", "part_notes"))
def _(spark, d):
    return G.edges_among(view(spark, d, "links"), view(spark, d, "part_notes").filter("tag_brand < 'Brand#3'"))


_DECLARED = """declared as (select source, predicate, case when length(target) % 3 = 0 then replace(target, 'parts/', '') when length(target) % 3 = 1 then target || 'x' else target end as target from relations
  union all select id, 'self', id from part_notes), pn as (select id from part_notes)"""


def _declared(spark, d):
    r = view(spark, d, "relations")
    changed = F.when(F.length("target") % 3 == 0, F.replace("target", F.lit("parts/"), F.lit(""))).when(F.length("target") % 3 == 1, F.concat("target", F.lit("x"))).otherwise(F.col("target"))
    p = view(spark, d, "part_notes")
    return r.select("source", "predicate", changed.alias("target")).unionByName(p.select(F.col("id").alias("source"), F.lit("self").alias("predicate"), F.col("id").alias("target"))), p


@query("resolve_relations", with_views(f", {_DECLARED} select distinct source, predicate, target, case when target in (select id from pn) then 'resolved' when target in (select replace(id, 'parts/', '') from pn) then 'malformed' else 'broken' end as kind from declared", "relations", "part_notes"))
def _(spark, d):
    declared, p = _declared(spark, d)
    return G.resolve_relations(p, declared)


@query("relation_hygiene", with_views(f""", {_DECLARED}, r as (select distinct source, predicate, target, case when target in (select id from pn) then 'resolved' when target in (select replace(id, 'parts/', '') from pn) then 'malformed' else 'broken' end as kind from declared)
select 'self' as kind, source, predicate, target from r where kind = 'resolved' and source = target union all select kind, source, predicate, target from r where kind <> 'resolved'""", "relations", "part_notes"))
def _(spark, d):
    declared, p = _declared(spark, d)
    return G.relation_hygiene(G.resolve_relations(p, declared))


@query("reciprocal_join", "with r as (select distinct l_partkey as a, l_suppkey as b, l_returnflag as p from lineitem) select cast(x.a as varchar) as source, x.p as predicate, cast(x.b as varchar) as target from r x join r y on x.a = y.b and x.b = y.a and x.p = y.p where cast(x.a as varchar) < cast(x.b as varchar)")
def _(spark, d):
    r = table(spark, d, "lineitem")
    return G.reciprocal(r.select(F.col("l_partkey").cast("string").alias("source"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").cast("string").alias("target")).distinct())


@query("lookup_note", with_views(" select n_name as query, case when n = 1 then 'found' when n > 1 then 'ambiguous' else 'missing' end as outcome, case when n = 1 then id end as id from (select n_name, (select count(*) from notes where lower(title) = lower(q)) as n, (select min(id) from notes where lower(title) = lower(q)) as id from (select 'Document ' || n_nationkey as n_name, 'Document ' || n_nationkey as q from nation))", "notes"))
def _(spark, d):
    q = table(spark, d, "nation").select(F.concat(F.lit("Document "), F.col("n_nationkey").cast("string")).alias("query"))
    return G.lookup_note(notes(spark, d), q)


@query("catalog_groups", "select n.n_name as \"group\", count(*) as n, string_agg('- [[' || n.n_name || '/s' || s_suppkey || ']] ' || s_name, chr(10) order by '- [[' || n.n_name || '/s' || s_suppkey || ']] ' || s_name) as lines from supplier join nation n on s_nationkey = n_nationkey group by 1")
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return G.catalog_groups(s.select(F.concat("n_name", F.lit("/s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title")))


@query("tag_support", "select tag, count(*) as support from (select distinct p_partkey, unnest([lower(p_brand), lower(p_type)]) as tag from part) where tag not in (select lower(p_brand) from part where p_size = 1) group by tag having count(*) >= 3")
def _(spark, d):
    p = table(spark, d, "part")
    return G.tag_support(p.select(F.col("p_partkey").alias("id"), F.array(F.lower("p_brand"), F.lower("p_type")).alias("tags")), p.filter("p_size = 1").select(F.lower("p_brand").alias("tag")).distinct(), 3)


@query("pair_support", with_views(", i as (select distinct source as note, target as item from relations) select x.note as a, y.note as b, count(*) as support from i x join i y on x.item = y.item and x.note < y.note group by all having count(*) >= 20", "relations"))
def _(spark, d):
    return G.pair_support(view(spark, d, "relations").select(F.col("source").alias("note"), F.col("target").alias("item")), 20)


@query("percolate_rank", with_views(", i as (select distinct source as note, target as item from relations) select 'relation' as kind, x.note || ' ' || y.note as identity, count(*) as support from i x join i y on x.item = y.item and x.note < y.note group by all order by support desc, identity limit 50", "relations"))
def _(spark, d):
    pairs = G.pair_support(view(spark, d, "relations").select(F.col("source").alias("note"), F.col("target").alias("item")), 1)
    return G.percolate_rank(pairs.select(F.lit("relation").alias("kind"), F.concat_ws(" ", "a", "b").alias("identity"), "support"), 50)


@query("suggest_concept_id", "select lower(n_name) as tag, 'concepts/' || k || case when n_nationkey % 3 = 0 then '' when n_nationkey % 3 = 1 then '-concept' else '-concept-2' end as id from (select *, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') as k from nation)")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("tag"), X.concept_key(F.col("n_name")).alias("key"))
    taken = n.filter("n_nationkey % 3 > 0").select(F.concat(F.lit("concepts/"), "key").alias("id")).union(n.filter("n_nationkey % 3 = 2").select(F.concat(F.lit("concepts/"), "key", F.lit("-concept"))))
    return G.suggest_concept_id(n, taken)


_WORDS = "[\\p{L}\\p{N}]+"

# The first place of a phrase with clean ends; the text before it gives the line.
_CLEAN = """(case when regexp_matches(left(phrase, 1), '[a-z0-9]') then '(?:^|[^a-z0-9])' else '' end) || regexp_escape(phrase) || (case when regexp_matches(right(phrase, 1), '[a-z0-9]') then '(?:[^a-z0-9]|$)' else '' end)"""
_MENTIONS = f"""t as (select 'items/b' || item_id as target, lower(text) as phrase from benchmark),
o as (select phrase, min(target) as target from t where phrase <> '' group by phrase having count(distinct target) = 1),
m as (select doc_id, source as origin, target, phrase, regexp_extract(lower(text), '(?s)\\A(.*?' || (case when regexp_matches(left(phrase, 1), '[a-z0-9]') then '(?:^|[^a-z0-9])' else '' end) || ')' || regexp_escape(phrase) || (case when regexp_matches(right(phrase, 1), '[a-z0-9]') then '(?:[^a-z0-9]|$)' else '' end), 1) as before
  from documents, o where regexp_matches(lower(text), {_CLEAN}))"""


def _named(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as notes, benchmark items as phrases, and no links."""
    b = table(spark, d, "benchmark").select(F.concat(F.lit("items/b"), F.col("item_id").cast("string")).alias("target"), F.col("text").alias("phrase"))
    n = table(spark, d, "documents").select(F.concat(F.lit("articles/d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"), F.col("source").alias("origin"))
    return n, b, b.select(F.col("target").alias("source"), "target").limit(0)


@query("mention_pairs", f"with {_MENTIONS} select 'articles/d' || doc_id as source, target, phrase, len(before) as \"offset\", 1 + len(before) - len(replace(before, chr(10), '')) as line from m")
def _(spark, d):
    return MN.mention_pairs(*_named(spark, d))


# Documents of one source stand for one note's texts, so that a pair gathers support; pairs whose item is the first of its source's are explicit.
@query("mention_support", f"""with {_MENTIONS}, s as (select 'sources/' || coalesce(origin, '') as source, target, 1 + len(before) - len(replace(before, chr(10), '')) as line, phrase from m),
x as (select source, min(target) as target from s group by source),
k as (select *, row_number() over (partition by source, target order by line, phrase) as k, count(*) over (partition by source, target) as n from s where not exists (select 1 from x where x.source = s.source and x.target = s.target))
select source, target, any_value(n) as support, any_value(n) > 3 as truncated, string_agg(line || ':' || phrase, '|' order by k) as evidence from k where k <= 3 group by source, target""")
def _(spark, d):
    n, b, none = _named(spark, d)
    names = n.select(F.col("id").alias("source"), F.concat(F.lit("sources/"), F.coalesce("origin", F.lit(""))).alias("note"))
    found = MN.mention_pairs(n, b, none).join(names, "source").select(F.col("note").alias("source"), "target", "line", "phrase")
    explicit = found.groupBy("source").agg(F.min("target").alias("target"))
    out = MN.mention_support(found, explicit, pieces=3)
    return out.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["line"].cast("string"), e["phrase"])), "|"))


@query("navigate_links", with_views(""", e as (select source as f, target as t from sparse_links union select target, source from sparse_links),
l1 as (select distinct t as node from e where f = (select min(source) from sparse_links)),
l2 as (select distinct t as node from e where f in (select node from l1))
select node, min(distance) as distance from (select min(source) as node, 0 as distance from sparse_links union all select node, 1 from l1 union all select node, 2 from l2) group by node""", "sparse_links"))
def _(spark, d):
    links = view(spark, d, "sparse_links")
    return G.neighbours(links, links.agg(F.min("source")).first()[0], 2, 1000)[0]


@query("graph_context", with_views(""", s as (select source as seed, row_number() over (order by source) - 1 as seed_rank from (select distinct source from sparse_links order by source limit 10)),
e as (select source as seed, target as id from sparse_links union select target, source from sparse_links),
k as (select e.seed, e.id, s.seed_rank, row_number() over (partition by e.seed order by e.id) as n from e join s on s.seed = e.seed where e.id not in (select seed from s))
select id, count(*) as seeds, min(seed_rank) as seed_rank from k where n <= 3 group by id""", "sparse_links"))
def _(spark, d):
    links = view(spark, d, "sparse_links")
    seeds = [r[0] for r in links.select("source").distinct().orderBy("source").limit(10).collect()]
    return G.graph_context(links, seeds)


@query("build_thread_tree", "with recursive t as (select conv_id, turn, cast(0 as bigint) as depth, turn as root from conversations where turn = 0 union all select c.conv_id, c.turn, t.depth + 1, t.root from conversations c join t on c.conv_id = t.conv_id and c.turn - 1 = t.turn) select * from t")
def _(spark, d):
    return G.thread_depths(view(spark, d, "thread"))


@query("walk_thread_counts", "select conv_id, count(*) as items, count(*) filter (role = 'user') as users, max(turn) as last from conversations group by conv_id")
def _(spark, d):
    return view(spark, d, "thread").groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("role") == "user").alias("users"), F.max("turn").alias("last"))


# --- repository memory --------------------------------------------------------------------------

_MATCH = "m as (select target, id, scope, length(scope) - length(replace(scope, '/', '')) + 1 as depth, case when scope = target then 'exact' else 'ancestor' end as kind from targets, scopes where scope = target or starts_with(target, scope || '/'))"


@query("scope_prefix_join", with_views(f", {_MATCH} select target, id, scope, depth, kind from m", "targets", "scopes"))
def _(spark, d):
    return M.scope_matches(view(spark, d, "targets"), view(spark, d, "scopes"))


@query("deepest_scope_match", with_views(f", {_MATCH} select target, id, scope, depth, kind from m qualify row_number() over (partition by target, id order by depth desc, scope) = 1", "targets", "scopes"))
def _(spark, d):
    return M.deepest_scopes(view(spark, d, "targets"), view(spark, d, "scopes"))


@query("analyze_scopes", with_views(" select id, case when count(distinct lower(scope)) < count(*) then 'collision' end as error, count(*) as n from scopes group by id", "scopes"))
def _(spark, d):
    held = view(spark, d, "scopes").groupBy("id").agg(F.collect_list("scope").alias("scopes"))
    return held.select("id", M.scope_error(F.col("scopes")).alias("error"), F.size("scopes").cast("bigint").alias("n"))


@query("classify_memory", """select o_orderkey, case o_orderkey % 5 when 0 then 'maintainedKnowledge' when 1 then case o_orderstatus when 'O' then 'activePlans' when 'F' then 'historicalPlans' else 'invalid: status' end
 when 2 then case when o_orderkey % 2 = 0 then 'datedResearch' else 'invalid: place' end when 3 then case when o_orderkey % 33 between 1 and 29 then 'reports' else 'invalid: date' end else 'invalid: type' end as "group" from orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "note").when(k % 5 == 1, "plan").when(k % 5 == 2, "market-research").when(k % 5 == 3, "report")
    status = F.when(k % 5 == 2, "snapshot").when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "F", "completed").otherwise("odd")
    path = F.when(k % 2 == 0, "projects/a/market/b.md").otherwise("elsewhere/b.md")
    day = F.concat(F.lit("1996-02-"), F.lpad((k % 33).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", M.classify(kind, status, path, F.lit("2024-02-29"), day).alias("group"))


_MEMORY_NOTES = "select 'suppliers/s' || s_suppkey as id, case when s_acctbal < 0 then 'activePlans' else 'maintainedKnowledge' end as grp, s_name as title, 'suppliers/s' || s_suppkey || '.md' as path from supplier"


@query("memory_context", with_views(f""", {_MATCH}, b as (select target, id, depth from m qualify row_number() over (partition by target, id order by depth desc, scope) = 1),
n as ({_MEMORY_NOTES}),
r as (select target, grp, n.id, row_number() over (partition by target, grp order by depth desc, title, path) as rank, count(*) over (partition by target, grp) as total from b join n on b.id = n.id)
select target, grp as "group", id, rank, total, total > 3 as truncated from r where rank <= 3""", "targets", "scopes"))
def _(spark, d):
    s = table(spark, d, "supplier")
    id_ = F.concat(F.lit("suppliers/s"), F.col("s_suppkey").cast("string"))
    n = s.select(id_.alias("id"), F.when(F.col("s_acctbal") < 0, "activePlans").otherwise("maintainedKnowledge").alias("group"), F.col("s_name").alias("title"), F.concat(id_, F.lit(".md")).alias("path"))
    return M.memory_context(view(spark, d, "targets"), view(spark, d, "scopes"), n)


@query("scope_collisions", with_views(", s as (select id, scope from scopes union all select id, lower(scope) from scopes where id like '%7') select distinct id, scope from s where lower(scope) in (select lower(scope) from s group by lower(scope) having count(distinct scope) > 1)", "scopes"))
def _(spark, d):
    s = view(spark, d, "scopes")
    return M.scope_collisions(s.unionByName(s.filter("id LIKE '%7'").select("id", F.lower("scope").alias("scope"))))


@query("memory_audit", with_views(", g as (select id, count(*) as n from scopes group by id) select (select count(*) from supplier) as notes, (select count(*) from g) as declared, cast(0 as bigint) as invalid, (select sum(n)::bigint from g) as declarations, (select max(n) from g) as most, (select count(distinct scope) from scopes) as distinct_scopes", "scopes"))
def _(spark, d):
    s = view(spark, d, "scopes")
    held = s.groupBy("id").agg(F.collect_list("scope").alias("scopes"))
    all_ = table(spark, d, "supplier").select(F.concat(F.lit("suppliers/s"), F.col("s_suppkey").cast("string")).alias("id")).join(held, "id", "left")
    return M.audit_counts(s, all_)


@query("scope_state", with_views(" select distinct scope, case when exists (select 1 from targets where target = scope or starts_with(target, scope || '/')) then 'present' else 'absent' end as state from scopes", "targets", "scopes"))
def _(spark, d):
    return M.scope_state(view(spark, d, "scopes"), view(spark, d, "targets").withColumnRenamed("target", "path"))


@query("source_inbox", with_views(", s as (select path, case when note_idx % 4 > 0 then '1996-02-' || lpad(cast(note_idx % 33 as varchar), 2, '0') end as clipped from part_notes where tag_brand <> 'Brand#55'), m as (select path from part_notes where tag_brand = 'Brand#55') select path, try_cast(clipped as date) as clipped from s where path not in (select target from links where source in (select path from m))", "links", "part_notes"))
def _(spark, d):
    p = view(spark, d, "part_notes")
    clipped = F.when(F.col("note_idx") % 4 > 0, F.concat(F.lit("1996-02-"), F.lpad((F.col("note_idx") % 33).cast("string"), 2, "0")))
    return M.source_inbox(p.filter("tag_brand <> 'Brand#55'").select("path", clipped.alias("clipped")), view(spark, d, "links"), p.filter("tag_brand = 'Brand#55'").select("path"))


SQL["inbox_semijoin"], QUERIES["inbox_semijoin"] = SQL["source_inbox"], QUERIES["source_inbox"]

_GUIDES = "g as (select scope, sum(length(id)) as words from scopes group by scope)"


def _guides(spark, d):
    return view(spark, d, "scopes").groupBy("scope").agg(F.sum(F.length("id")).alias("words"))


@query("guide_inheritance", with_views(f", {_GUIDES} select a.scope, count(*) as guides, sum(b.words)::bigint as words from g a join g b on b.scope = a.scope or starts_with(a.scope, b.scope || '/') group by a.scope", "scopes"))
def _(spark, d):
    return M.guide_inheritance(_guides(spark, d))


@query("audit_guides", with_views(f", {_GUIDES} select g.scope, words::bigint as words, n as bullets, case when words > 200 or n > 20 then 'high' when words > 100 or n > 10 then 'low' else 'none' end as advice from g join (select scope, count(*) as n from scopes group by scope) b on b.scope = g.scope", "scopes"))
def _(spark, d):
    return M.audit_guides(_guides(spark, d), view(spark, d, "scopes").select("scope", F.col("id").alias("bullet")), 100, 10)


@query("duplicate_bullets", with_views(" select id as bullet, count(*) as n, count(distinct scope) as guides from scopes group by id having count(*) > 1", "scopes"))
def _(spark, d):
    return M.duplicate_bullets(view(spark, d, "scopes").select("scope", F.col("id").alias("bullet")))


@query("guide_totals", with_views(f", {_GUIDES} select count(*) as guides, sum(words)::bigint as words, max(words)::bigint as most from g", "scopes"))
def _(spark, d):
    return _guides(spark, d).agg(F.count(F.lit(1)).alias("guides"), F.sum("words").alias("words"), F.max("words").alias("most"))


@query("snapshot_diff", with_views(f", {_GUIDES}, b as (select scope, count(*) * 13 as words from scopes where scope <> 'ASIA' group by scope) select g.scope, coalesce(b.words, 0)::bigint as before, g.words::bigint as after from g left join b on b.scope = g.scope where g.words > coalesce(b.words, 0)", "scopes"))
def _(spark, d):
    base = view(spark, d, "scopes").filter("scope <> 'ASIA'").groupBy("scope").agg((F.count(F.lit(1)) * 13).alias("words"))
    return M.snapshot_diff(base, _guides(spark, d))


@query("marker_reciprocity", "select n_name as scope, case when n_nationkey % 5 = 0 then 'hub missing' when n_nationkey % 5 = 1 then 'marker missing' else 'scope differs' end as issue from nation where n_nationkey % 5 < 2 or n_nationkey % 5 = 2")
def _(spark, d):
    n = table(spark, d, "nation").withColumn("hub", X.scope_hub_id(F.col("n_name")))
    hubs = n.filter("n_nationkey % 5 <> 0").select("hub", F.when(F.col("n_nationkey") % 5 == 2, "other").otherwise(F.col("n_name")).alias("scope"))
    return M.marker_reciprocity(n.filter("n_nationkey % 5 <> 1").select(F.col("n_name").alias("scope"), "hub"), hubs)


# --- change history -----------------------------------------------------------------------------


@query("commit_note_join", with_views(" select n.id, n.path, c.hash, committed_at, subject from commits c join commit_paths p on p.hash = c.hash join part_notes n on n.path = p.path", "commits", "commit_paths", "part_notes"))
def _(spark, d):
    return H.commit_note_join(view(spark, d, "commits"), view(spark, d, "commit_paths"), view(spark, d, "part_notes"))


@query("git_history", with_views(" select n.id, c.hash, row_number() over (partition by n.id order by committed_at desc, c.hash) as rank from commits c join commit_paths p on p.hash = c.hash join part_notes n on n.path = p.path qualify rank <= 5", "commits", "commit_paths", "part_notes"))
def _(spark, d):
    return H.git_history(view(spark, d, "commits"), view(spark, d, "commit_paths"), view(spark, d, "part_notes"))


@query("cochange", with_views(" select x.path as a, y.path as b, count(*) as commits from commit_paths x join commit_paths y on x.hash = y.hash and x.path < y.path group by all having count(*) >= 2", "commit_paths"))
def _(spark, d):
    return H.cochange(view(spark, d, "commit_paths"))


_STRENGTH = "(case when contains(lower({0}), '1-urgent p7') then 2.011 else ((case when contains(lower({0}), '1-urgent') then 1 else 0 end) + (case when contains(lower({0}), 'p7') then 1 else 0 end)) / 2 end)"


@query("git_search", with_views(f""", b as (select hash, max({_STRENGTH.format('path')}) as bp from commit_paths group by hash),
s as (select n.id, c.hash, {_STRENGTH.format('subject')} as bs, bp, row_number() over (partition by n.id order by committed_at desc, c.hash) - 1 as i from commits c join b on b.hash = c.hash join commit_paths p on p.hash = c.hash join part_notes n on n.path = p.path),
t as (select id, hash, bs * 4 + bp * 2 + 1 / (100 + i) as score from s where bs > 0 or bp > 0),
r as (select id, score, row_number() over (partition by id order by score desc, hash) as place from t)
select id, round(sum(score / place), 6) as score from r group by id order by score desc, id limit 20""", "commits", "commit_paths", "part_notes"))
def _(spark, d):
    return H.git_search(view(spark, d, "commits"), view(spark, d, "commit_paths"), view(spark, d, "part_notes"), "1-urgent p7", ["1-urgent", "p7"])


# --- retrieval ----------------------------------------------------------------------------------

_FIELDS = {"title": "lower(title)", "alias": "lower('doc ' || note_idx)", "path": "lower(path || chr(10) || id)", "tag": "lower(concat_ws(chr(10), tag_lang, tag_source))", "content": "lower(coalesce(content, ''))", "metadata": """lower('{"lang":"' || coalesce(tag_lang, '') || '","source":"' || coalesce(tag_source, '') || '","n_chars":' || coalesce(n_chars::varchar, '') || '}')"""}


def _exact_sql(phrase: str, terms: list[str], limit: int) -> str:
    add = [f"case when contains({_FIELDS[k]}, '{phrase}') then {n} else 0 end" for k, n in S.PHRASE.items()]
    add += [f"case when contains({_FIELDS[k]}, '{t}') then {n} else 0 end" for t in terms for k, n in S.TERM.items()]
    matched = " + ".join(f"(case when {' or '.join(f'contains({_FIELDS[k]}, {chr(39)}{t}{chr(39)})' for k in S.TERM)} then 1 else 0 end)" for t in terms)
    any_phrase = " or ".join(f"contains({_FIELDS[k]}, '{phrase}')" for k in S.PHRASE)
    need = len(terms) if len(terms) <= 1 else min(3, -(-len(terms) // 2))
    identity = {"title": f"lower(title) = '{phrase}'", "alias": f"lower('doc ' || note_idx) = '{phrase}'", "path": f"lower(path) = '{phrase}' or lower(id) = '{phrase}'"}
    add += [f"case when {c} then {S.IDENTITY[k]} else 0 end" for k, c in identity.items()]
    return with_views(f""", s as (select id, path, {' or '.join(f'({c})' for c in identity.values())} as identity, ({any_phrase}) as phrase, {matched} as matched, {' + '.join(add)} as score from notes)
select id, path, identity, (score + floor(matched * 100 / {len(terms)} + 0.5))::bigint as score from s where identity or phrase or matched >= {need} order by identity desc, 4 desc, path limit {limit}""", "notes")


@query("exact_search", _exact_sql("doc 77 ", ["doc", "77"], 40).replace("'doc 77 '", "'doc 77'"))
def _(spark, d):
    phrase, terms = S.terms_of(spark, "Doc 77")
    return S.exact_search(notes(spark, d), phrase, terms)


def _lanes(spark, d):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return S.keyword_search(docs, asked, 10)


_BM25 = f"""w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') as words from documents),
z as (select count(*) as n, avg(len(words)) as mean from w),
asked as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) as term from benchmark),
tf as (select doc_id, term, length, count(*) as tf from (select doc_id, len(words) as length, unnest(words) as term from w) where term in (select term from asked) group by all),
idf as (select term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf, any_value(mean) as mean from tf, z group by term),
sc as (select query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from tf join idf using (term) join asked using (term) group by all),
kw as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, score from sc qualify rank <= 10)"""


@query("keyword_search", f"with {_BM25} select query_id, doc_id, rank from kw")
def _(spark, d):
    return _lanes(spark, d).select("query_id", "doc_id", "rank")


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return S.semantic_search(v, v.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector"), 10)


_COSINE = "vs as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 5) as score from embeddings v, embeddings q where q.vec_id % 100 = 0), vl as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, score from vs qualify rank <= 10)"


@query("semantic_search", f"with {_COSINE} select query_id, doc_id, rank, score from vl")
def _(spark, d):
    return _vectors(spark, d)


_FUSED = "select query_id, doc_id, round(sum(weight / (60 + rank)) / any_value(best), 6) as score from lanes join (select query_id, sum(weight / 61) as best from (select distinct query_id, lane, weight from lanes) group by query_id) using (query_id) group by query_id, doc_id"
_LANES = "lanes as (select 'a' as lane, 1.0 as weight, query_id, doc_id, rank from vl union all select 'b', 0.5, query_id, doc_id, 11 - rank from vl where doc_id % 2 = 0)"


@query("rrf_fuse", f"with {_COSINE}, {_LANES} select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from ({_FUSED})")
def _(spark, d):
    v = _vectors(spark, d)
    lanes = v.select(F.lit("a").alias("lane"), F.lit(1.0).alias("weight"), "query_id", "doc_id", "rank").unionByName(v.filter("doc_id % 2 = 0").select(F.lit("b").alias("lane"), F.lit(0.5).alias("weight"), "query_id", "doc_id", (11 - F.col("rank")).alias("rank")))
    return S.rrf_fuse(lanes)


@query("hybrid_search", f"""with {_BM25}, vs as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 5) as score from embeddings v, embeddings q where q.vec_id in (select item_id from benchmark)),
vl as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from vs qualify rank <= 10),
lanes as (select 'keyword' as lane, 1.0 as weight, query_id, doc_id, rank from kw union all select 'vector', 1.0, query_id, doc_id, rank from vl), f as ({_FUSED})
select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, score, (query_id, doc_id) in (select (query_id, doc_id) from kw) as keyword, (query_id, doc_id) in (select (query_id, doc_id) from vl) as vector from f qualify rank <= 10""")
def _(spark, d):
    """Benchmark items by their words and by the vector of the same id, both over document ids."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    wanted = v.withColumnRenamed("doc_id", "query_id").join(items, "query_id", "left_semi")
    return S.hybrid(_lanes(spark, d), S.semantic_search(v, wanted, 10), 10)


@query("semantic_reconcile", "select d.doc_id, 'd' || d.doc_id as id from documents d where d.doc_id % 4 > 0")
def _(spark, d):
    t = table(spark, d, "documents")
    rows = t.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2(F.when(F.col("doc_id") % 4 == 0, F.lit("changed")).otherwise(F.col("text")), 256).alias("hash"))
    live = t.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("hash"))
    return S.semantic_reconcile(rows, live)[0].select("doc_id", "id")


# --- evaluation ---------------------------------------------------------------------------------

_QRELS = "select b.item_id as query_id, d.doc_id, 3 as relevance from benchmark b join documents d on contains(d.text, b.text)"
_METRICS = f"""qr as ({_QRELS}), ideal as (select query_id, count(*) as relevant, least(count(*), 10) as m from qr group by query_id),
idl as (select query_id, relevant, list_sum(list_transform(range(1, m + 1), lambda i: 7 / log2(i + 1))) as ideal from ideal),
got as (select query_id, count(*) as found, min(rank) as first, sum(7 / log2(rank + 1)) as dcg from kw join qr using (query_id, doc_id) group by query_id),
met as (select item_id as query_id, case when relevant is not null then round(coalesce(found, 0) / relevant, 6) end as recall, case when relevant is not null then round(coalesce(1 / first, 0), 6) end as mrr,
  case when relevant is not null then round(coalesce(dcg / ideal, 0), 6) end as ndcg, case when relevant is null then case when item_id in (select query_id from kw) then 0 else 1 end end::bigint as no_answer
  from benchmark left join idl on idl.query_id = item_id left join got on got.query_id = item_id)"""


def _judged(spark, d) -> DataFrame:
    """query_id, doc_id, relevance of the items that a document holds, inside words too."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return MN.judgments(docs, table(spark, d, "benchmark").select("item_id", "text")).select(F.col("item_id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(3).alias("relevance"))


def _metrics(spark, d) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return E.eval_metrics(_lanes(spark, d), _judged(spark, d), asked, 10)


@query("qrels_join", f"with {_BM25}, qr as ({_QRELS}) select query_id, doc_id, rank, coalesce(relevance, 0) as relevance from kw left join qr using (query_id, doc_id)")
def _(spark, d):
    return _lanes(spark, d).join(_judged(spark, d), ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"))


@query("eval_metrics", f"with {_BM25}, {_METRICS} select * from met")
def _(spark, d):
    return _metrics(spark, d)


for _k in ("recall", "mrr", "ndcg"):
    QUERIES[f"{_k}_at_k"] = lambda spark, d, k=_k: _metrics(spark, d).select("query_id", k)
    SQL[f"{_k}_at_k"] = f"with {_BM25}, {_METRICS} select query_id, {_k} from met"

_SYSTEMS = "sys as (select 'a' as system, query_id % 3 as class, recall, mrr, ndcg, no_answer, query_id from met union all select 'b', query_id % 3, recall * (query_id % 4) / 4, mrr * (query_id % 4) / 4, ndcg * (query_id % 4) / 4, no_answer, query_id from met)"


def _systems(spark, d) -> DataFrame:
    m = _metrics(spark, d).withColumn("class", F.col("query_id") % 3)
    half = m.withColumns({k: F.col(k) * (F.col("query_id") % 4) / 4 for k in ("recall", "mrr", "ndcg")})
    return m.withColumn("system", F.lit("a")).unionByName(half.withColumn("system", F.lit("b")))


@query("metric_means", f"with {_BM25}, {_METRICS}, {_SYSTEMS} select system, class, count(*) as n, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, round(avg(no_answer), 6) as no_answer from sys group by grouping sets ((system), (system, class))")
def _(spark, d):
    return E.metric_means(_systems(spark, d))


QUERIES["benchmark_report"], SQL["benchmark_report"] = QUERIES["metric_means"], SQL["metric_means"]


@query("paired_join", f"with {_BM25}, {_METRICS}, {_SYSTEMS} select 'b' as candidate, 'mrr' as metric, y.query_id, y.mrr - x.mrr as difference from sys x join sys y on x.query_id = y.query_id and x.system = 'a' and y.system = 'b' where x.mrr is not null")
def _(spark, d):
    return E.paired(_systems(spark, d), "a", "mrr")


_HALF = "4294967296::hugeint"
_BOOT = f"""v as (select row_number() over (order by y.query_id) - 1 as k, y.mrr - x.mrr as difference from sys x join sys y on x.query_id = y.query_id and x.system = 'a' and y.system = 'b' where x.mrr is not null),
n as (select count(*) as n from v), i as (select unnest(range(10000 * n)) as i, n from n),
a as (select i, n, (({1 ^ E.fnv1a(chr(98) + chr(0) + 'mrr')} + (i + 1) * 1831565813) % 4294967296)::bigint as t from i),
b as (select i, n, ((xor(t, t >> 15)::hugeint * (t | 1)) % {_HALF})::bigint as t from a),
c as (select i, n, xor(t, ((t + ((xor(t, t >> 7)::hugeint * (t | 61)) % {_HALF})::bigint) % 4294967296)) as t from b),
m as (select i // c.n as r, avg(difference) as m from c join v on k = floor(xor(t, t >> 14) / 4294967296.0 * c.n) group by 1),
o as (select m, row_number() over (order by m, r) as place from m)"""


@query("paired_bootstrap", f"with {_BM25}, {_METRICS}, {_SYSTEMS}, {_BOOT} select 'b' as candidate, 'mrr' as metric, round((select avg(difference) from v), 6) as mean, round((select m from o where place = 251), 6) as low, round((select m from o where place = 9750), 6) as high")
def _(spark, d):
    out = E.paired_bootstrap(E.paired(_systems(spark, d), "a", "mrr"))
    return out.select("candidate", "metric", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


_RUNS = """rn as (select 'a' as system, item_id as query_id, 'ready' as status, (item_id * 7 % 19 + length(text) % 5)::double as elapsed_ms from benchmark union all
select 'b', item_id, case when item_id % 11 = 0 then 'failed' when item_id % 13 = 0 then 'unavailable' when item_id % 5 = 0 then 'degraded' else 'ready' end, (item_id * 3 % 23)::double from benchmark),
ms as (select system, query_id, query_id % 3 as class, status, elapsed_ms, case when status in ('failed', 'unavailable') then recall * 0 else recall end as recall, case when status in ('failed', 'unavailable') then mrr * 0 else mrr end as mrr,
  case when status in ('failed', 'unavailable') then ndcg * 0 else ndcg end as ndcg, case when status in ('failed', 'unavailable') then no_answer * 0 else no_answer end as no_answer from rn join met using (query_id))"""


def _measured(spark, d) -> DataFrame:
    """Runs of two systems with the same hits, of which the second fails on some queries."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    i, judged = F.col("query_id"), Q.checkpointed(_judged(spark, d))
    a = b.select(F.lit("a").alias("system"), "query_id", F.lit("ready").alias("status"), (i * 7 % 19 + F.length("text") % 5).cast("double").alias("elapsed_ms"))
    status = F.when(i % 11 == 0, "failed").when(i % 13 == 0, "unavailable").when(i % 5 == 0, "degraded").otherwise("ready")
    runs = a.union(b.select(F.lit("b"), "query_id", status, (i * 3 % 23).cast("double")))
    hits = _lanes(spark, d).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("system"), "query_id", "doc_id", "rank")
    answered = judged.select("query_id", F.lit("answerable").alias("answer")).distinct()
    asked = b.join(answered, "query_id", "left").select("query_id", (i % 3).alias("class"), F.coalesce("answer", F.lit("no-answer")).alias("answer"))
    return EC.run_metrics(runs, hits, judged, asked)


@query("eval_report", f"""with {_BM25}, {_METRICS}, {_RUNS} select system, class, count(*) as n, count(*) filter (status = 'ready') as ready, count(*) filter (status = 'degraded') as degraded, count(*) filter (status = 'unavailable') as unavailable, count(*) filter (status = 'failed') as failed,
round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, round(avg(no_answer), 6) as no_answer,
quantile_disc(elapsed_ms, 0.5) as p50, quantile_disc(elapsed_ms, 0.9) as p90, quantile_disc(elapsed_ms, 0.95) as p95, quantile_disc(elapsed_ms, 0.99) as p99 from ms group by grouping sets ((system), (system, class))""")
def _(spark, d):
    return EC.eval_report(_measured(spark, d))


_LINE = "trim(regexp_replace(text, '[\\x00\\r\\n]+', ' ', 'g'))"


# Four items a manifest; of each five manifests, one is right and four have a defect of their own.
@query("parse_eval_corpus", f"""with b as (select item_id // 4 as m, item_id % 4 as p, item_id, {_LINE} as text, item_id // 4 % 5 as bad from benchmark),
s as (select m from b group by m having count(distinct item_id % 2) < 2)
select 'query' as kind, 'm' || m as manifest, 'q' || item_id as name, text as value from b where bad = 0 and m not in (select m from s)
union all select 'judgment', 'm' || m, 'q' || item_id, 'd' || item_id || ':' || (item_id % 3 + 1) from b where bad = 0 and m not in (select m from s)
union all select 'issue', 'm' || m, 'queries[' || p || '].extra', 'unknown-field' from b where bad = 1 and item_id % 2 = 0
union all select 'issue', 'm' || m, 'queries[' || p || '].qrels[0].relevance', 'value' from b where bad = 2
union all select 'issue', 'm' || m, 'queries[' || p || '].answer', 'inconsistent' from b where bad = 2
union all select distinct 'issue', 'm' || m, 'frozen', 'missing' from b where bad = 3
union all select 'issue', 'm' || m, 'queries[' || p || '].text', 'value' from b where bad = 4
union all select 'issue', 'm' || m, 'queries', 'inconsistent' from s""")
def _(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.trim(F.regexp_replace("text", "[\\x00\r\n]+", " ")).alias("text"), F.floor(F.col("item_id") / 4).alias("m"))
    bad = F.col("m") % 5
    entry = F.struct(
        F.concat(F.lit("q"), "item_id").alias("id"), F.when(bad == 4, " ").otherwise(F.col("text")).alias("text"), F.lit("conceptual-recall").alias("class"), F.when(F.col("item_id") % 2 == 0, "development").otherwise("test").alias("split"), F.lit("answerable").alias("answer"),
        F.struct(F.col("text").alias("text")).alias("inputs"), F.array(F.struct(F.concat(F.lit("d"), "item_id").alias("documentId"), F.when(bad == 2, 5).otherwise(F.col("item_id") % 3 + 1).alias("relevance"))).alias("qrels"),
        F.array(F.lit("ann")).alias("assessorIds"), F.struct(F.lit("not-required").alias("status")).alias("adjudication"), F.when((bad == 1) & (F.col("item_id") % 2 == 0), True).alias("extra"),
    )
    frozen = F.when(F.col("m") % 5 != 3, F.struct(F.lit("a" * 40).alias("repositoryCommit"), F.lit("0" * 64).alias("vaultTree"), F.lit("notes").alias("vaultRoot")))
    whole = F.struct(F.lit(1).alias("schemaVersion"), F.concat(F.lit("m"), "m").alias("id"), F.lit("made of benchmark items").alias("description"), frozen.alias("frozen"), F.struct(F.lit("1").alias("rubricVersion"), F.array(F.struct(F.lit("ann").alias("id"))).alias("assessors")).alias("assessment"), F.transform("q", lambda x: x["e"]).alias("queries"))
    held = b.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("item_id", entry.alias("e")))).alias("q"))
    queries, judgments, issues = EC.parse_eval_corpus(held.select(F.concat(F.lit("m"), "m").alias("manifest"), F.to_json(whole).alias("json")))
    row = lambda t, kind, name, value: t.select(F.lit(kind).alias("kind"), "manifest", name.alias("name"), value.alias("value"))
    out = row(queries, "query", F.col("query_id"), F.col("text")).union(row(judgments, "judgment", F.col("query_id"), F.concat_ws(":", "doc_id", F.col("relevance").cast("string"))))
    return out.union(row(issues, "issue", F.col("label"), F.col("code")))


# --- pages, layout, streams ---------------------------------------------------------------------


def _sql_steps(text: str, steps) -> str:
    for pattern, replacement in steps:
        quoted = (pattern.replace("'", "''"), replacement.replace("$1", "\\1"))
        text = f"regexp_replace({text}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return text


def _sql_entities(text: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


_PAGE_TEXT = f"trim({_sql_steps(_sql_entities(_sql_steps('html', C.TEXT_STEPS)), C.TIDY_STEPS)})"
_PAGE_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("html_text", f"select page_id, sha256({_PAGE_TEXT}) as text from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(C.html_text(F.col("html")), 256).alias("text"))


# In the pages every tag ends, and attributes stand in double quotes.
_GONE, _STAYS = "|".join(sorted(MK.REMOVED)), "|".join(sorted(MK.KEPT))
_INERT_SQL = ["(?s)<!--.*?-->", *(f"(?is)<{t}\\b[^>]*>.*?</\\s*{t}\\b[^>]*>" for t in sorted(MK.REMOVED)), f"(?i)</?(?:{_GONE})\\b[^>]*>", "(?i)</?(?:html|head|body|meta|link|base|input|param|source|track)\\b[^>]*>", "<![^>]*>"]


@query("sanitize_html", "select page_id, sha256(regexp_replace(" + "".join("regexp_replace(" for _ in _INERT_SQL) + "html" + "".join(f", '{p}', '', 'g')" for p in _INERT_SQL) + ", '(?i) (href|src)=\"', ' data-captured-\\1=\"', 'g')) as html from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(MK.sanitize_html(F.col("html")), 256).alias("html"))


@query("page_title", f"select page_id, {_sql_entities('trim(regexp_extract(html, $$(?is)<title[^>]*>(.*?)</title>$$, 1))')} as title from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", C.title(F.col("html")).alias("title"))


# What pages say in place of, or beside, their text: by the page's number, with the status that it should get.
_GATES = [("", "", "case when length(trim(text)) < 40 then 'unsupported' else 'complete' end"), ("Just a moment...", "Wait.", "'blocked'"), ("", "429 Too Many Requests\nPlease try again later", "'blocked'"), ("", "+Sign in to continue", "case when length(text) + 20 < 1500 then 'auth-required' else 'partial' end"), ("", "Subscribe now to keep reading", "'auth-required'"), ("", "How to solve the captcha: this guide explains why access denied appears", "'complete'"), ("", "Please enable JavaScript to see this page", "'unsupported'"), ("", "Publishers write: subscribe to keep reading, and this is quoted", "'complete'")]
_STATUS = "case page_id % 8 " + " ".join(f"when {i} then {status}" for i, (_, _, status) in enumerate(_GATES)) + " end"
_SHOWN = "case page_id % 8 " + " ".join(f"when {i} then " + ("text" if not body else f"text || chr(10) || '{body[1:]}'" if body[0] == "+" else f"'{body}'") for i, (_, body, _) in enumerate(_GATES)) + " end"


def _extracted(spark, d) -> DataFrame:
    p = table(spark, d, "pages").withColumn("own", C.html_text(F.col("html"))).withColumn("name", F.lit("a page"))
    text, name = F.col("own"), F.col("name")
    for i, (gate, body, _) in enumerate(_GATES):
        here = F.col("page_id") % 8 == i
        if body:
            text = F.when(here, F.concat(F.col("own"), F.lit("\n" + body[1:])) if body[0] == "+" else F.lit(body)).otherwise(text)
        if gate:
            name = F.when(here, gate).otherwise(name)
    links = F.regexp_count("html", F.lit("(?i)<a[ >]")).cast("bigint")
    p = p.select("page_id", text.alias("text"), name.alias("name"), links.alias("links"))
    return p.select("page_id", "text", C.extract_status(F.col("text"), F.col("name")).alias("status"), "links")


@query("extract_status", f"select page_id, {_STATUS} as status from (select page_id, {_PAGE_TEXT} as text from pages)")
def _(spark, d):
    return _extracted(spark, d).select("page_id", "status")


_SCORED = f"sc as (select page_id, status, (case status when 'complete' then 5000 when 'partial' then 2000 when 'auth-required' then -2000 when 'blocked' then -4000 else -5000 end) + least(length(shown), 50000) + 5 * least({_PAGE_WORDS.replace('text', 'shown')}, 10000) + 5 * links as score from (select *, {_STATUS} as status, {_SHOWN} as shown from (select page_id, {_PAGE_TEXT} as text, len(regexp_extract_all(html, '(?i)<a[ >]')) as links from pages)))"


@query("score_extraction", f"with {_SCORED} select page_id, score from sc")
def _(spark, d):
    e = _extracted(spark, d)
    return e.select("page_id", C.score_extraction(F.col("status"), F.col("text"), F.lit(0), F.lit(0), F.col("links")).cast("bigint").alias("score"))


@query("choose_best_extraction", f"with {_SCORED}, c as (select page_id, 0 as \"at\", 'partial' as status, 600000 + page_id % 7 as score from pages union all select page_id, 1, status, score from sc union all select page_id, 2, status, score from sc) select page_id, \"at\", status, score from c qualify row_number() over (partition by page_id order by case status when 'complete' then 0 when 'partial' then 1 when 'auth-required' then 2 when 'blocked' then 3 else 4 end, score desc, \"at\") = 1")
def _(spark, d):
    e = _extracted(spark, d)
    scored = e.select("page_id", "status", C.score_extraction(F.col("status"), F.col("text"), F.lit(0), F.lit(0), F.col("links")).cast("bigint").alias("score"))
    plain = e.select("page_id", F.lit("partial").alias("status"), (F.lit(600_000) + F.col("page_id") % 7).alias("score"))
    at = lambda df, n: df.withColumn("at", F.lit(n))
    return C.choose_best(at(plain, 0).unionByName(at(scored, 1)).unionByName(at(scored, 2)))


_IDENTITY = f"lower(regexp_extract(url, '^((?i:https?))://', 1)) || '://' || {_HOST} || (case when starts_with(rest, '/') then rest else '/' || rest end)"
_IDENTITIES = f"i as (select page_id, url, {_IDENTITY} as identity from (select page_id, url, regexp_extract(regexp_replace(url, '#.*$', ''), '^(?i:https?)://[^/?#]*(.*)$', 1) as rest from pages) where regexp_matches(url, '^(?i:https?)://[^/?#]'))"


@query("rank_metadata_results", f"with {_IDENTITIES}, o as (select page_id % 20 as query_id, identity, min_by(page_id, (-(page_id % 13), page_id)) as n from i group by all) select query_id, identity, row_number() over (partition by query_id order by -(n % 13), n) as rank from o")
def _(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("query_id"), "url", (F.col("page_id") % 13).alias("score"), F.col("page_id").alias("at"))
    return C.rank_results(p, "https://none.example.org/").select("query_id", "identity", "rank")


@query("url_backfill", f"with {_IDENTITIES}, k as (select distinct identity from i where page_id % 3 = 0) select 'p' || lpad(page_id::varchar, 12, '0') as id, identity, case when identity in (select identity from k) then 'skip' when row_number() over (partition by identity order by page_id) > 1 then 'alias' else 'write' end as action from i")
def _(spark, d):
    p = table(spark, d, "pages").withColumn("identity", U.identity(F.col("url"))).filter("identity IS NOT NULL")
    saved = p.select(F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("id"), "identity")
    return C.backfill(saved, p.filter("page_id % 3 = 0").select("identity"))


@query("backfill_status_counts", f"with {_IDENTITIES}, k as (select distinct identity from i where page_id % 3 = 0), a as (select case when identity in (select identity from k) then 'skip' when row_number() over (partition by identity order by page_id) > 1 then 'alias' else 'write' end as action from i) select action, count(*) as n from a group by action")
def _(spark, d):
    return QUERIES["url_backfill"](spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("discover_saved_urls", f"with {_IDENTITIES} select 'n' || page_id as id, url, identity from i")
def _(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("id"), F.parse_json(F.to_json(F.struct(F.col("url").alias("source_url")))).alias("metadata"))
    return C.discover_saved_urls(p)


def _lines(spark, d) -> DataFrame:
    """Lines of orders as lines of pages."""
    t = table(spark, d, "lineitem")
    return t.select((F.col("l_suppkey") % 10).alias("document"), F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("top"), F.col("l_extendedprice").alias("left"), F.lit(1.0).alias("height"), (F.col("l_discount") * 100).alias("font_size"), F.lit(51.0).alias("page_height"), F.concat("l_returnflag", F.lit(" "), "l_linestatus").alias("text"))


_LINES = "li as (select l_suppkey % 10 as document, l_orderkey as page, l_quantity as top, l_extendedprice as lft, 1.0 as height, l_discount * 100 as font_size, 51.0 as page_height, l_returnflag || ' ' || l_linestatus as text from lineitem)"


@query("font_mode", f"with {_LINES}, s as (select document, round(font_size) as size, sum(length(text)) as weight from li group by all) select document, size as body from s qualify row_number() over (partition by document order by weight desc, size) = 1")
def _(spark, d):
    return P.font_mode(_lines(spark, d))


@query("margin_repeat", f"with {_LINES}, e as (select document, lower(text) as margin, count(distinct page) as n from li where top < 0.06 * page_height or top + height > 0.94 * page_height group by all), p as (select document, count(distinct page) as pages from li group by document) select document, margin from e join p using (document) where n >= greatest(3, ceil(0.02 * pages))")
def _(spark, d):
    return P.margin_repeat(_lines(spark, d), share=0.02)


@query("gap_before", f"with {_LINES} select document, page, top, lft, top - lag(top) over (partition by document, page order by top, lft) as gap from li")
def _(spark, d):
    w = W.partitionBy("document", "page").orderBy("top", "left")
    return _lines(spark, d).select("document", "page", "top", F.col("left").alias("lft"), (F.col("top") - F.lag("top").over(w)).alias("gap"))


@query("visual_line_groups", f"with {_LINES}, g as (select *, coalesce((top - lag(top) over w > 5 * height)::int, 1) as new from li window w as (partition by document, page order by top, lft)), r as (select *, sum(new) over (partition by document, page order by top, lft rows unbounded preceding) as row_ from g) select document, page, row_ as line, min(top) as top, count(*) as n from r group by all")
def _(spark, d):
    lines = P.visual_lines(_lines(spark, d).withColumn("width", F.lit(1e9)), tolerance=5.0)
    n = F.size(F.regexp_extract_all("text", F.lit("[A-Z] [A-Z]"), 0)).cast("bigint")
    return lines.select("document", "page", F.col("row").alias("line"), "top", n.alias("n"))


@query("ocr_confidence", "select l_orderkey as file, round(sum(l_quantity * length(l_returnflag || l_suppkey)) / sum(length(l_returnflag || l_suppkey)), 6) as confidence from lineitem group by 1")
def _(spark, d):
    cell = F.concat_ws("\t", F.lit("5\t1\t1\t1\t1\t1\t0\t0\t0\t0"), F.col("l_quantity").cast("string"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")))
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.array_join(F.collect_list(cell), "\n").alias("content"))
    return P.ocr_words(files).select("file", F.round("confidence", 6).alias("confidence"))


@query("stream_window_counts", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, d):
    return V.window_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("stream_sessions", "with g as (select *, coalesce((ts >= lag(ts) over (partition by user_id order by ts) + interval '30 minutes')::int, 1) as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select min(ts) as start, user_id, count(*) as n, round(sum(value), 4) as total from s group by user_id, k")
def _(spark, d):
    return V.session_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


# --- further operators --------------------------------------------------------------------------


@query("sanitize_url", "select page_id, regexp_extract(url, '^([^?#]*)', 1) || case when q <> '' then '?' || q else '' end || case when f <> '' and not contains(f, '=') then '#' || f else '' end as url from (select page_id, url, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as q, regexp_extract(url, '#(.*)$', 1) as f from pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.sanitize(F.col("url")).alias("url"))


@query("exact_url_query", f"with {_IDENTITIES} select page_id, '\"' || identity || '\"' as query from i")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.exact_query(F.col("url")).alias("query")).filter("query IS NOT NULL")


@query("canonical_metadata", "select p_partkey, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || ',\"type\":\"' || p_type || '\"}' as json from part")
def _(spark, d):
    v = F.parse_json(F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))))
    return table(spark, d, "part").select("p_partkey", X.canonical_metadata(v).alias("json"))


@query("metadata_scalar_literal", "select p_partkey, case p_partkey % 4 when 0 then p_size::varchar when 1 then 'true' when 2 then '\"' || p_brand || '\"' else '\"0' || p_size || '\"' end as json from part")
def _(spark, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, "true").when(k == 2, F.col("p_brand")).otherwise(F.concat(F.lit("0"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", F.to_json(X.scalar_literal(text)).alias("json"))


@query("exact_matches", with_views(""", f as (select id, [case when lower(title) = 'document 7' then 'identity:title' end, case when contains(lower(title), 'document 7') then 'phrase:title' end, case when contains(lower(coalesce(content, '')), 'document 7') then 'phrase:content' end] as m from notes)
select id, array_to_string(list_filter(m, lambda x: x is not null), ',') as matches from f where len(list_filter(m, lambda x: x is not null)) > 0""", "notes"))
def _(spark, d):
    found = S.exact_evidence(notes(spark, d), "document 7", [])
    return found.select("id", F.array_join(F.transform("matches", lambda m: F.concat(m["kind"], F.lit(":"), m["field"])), ",").alias("matches"))


@query("min_score", f"with {_COSINE}, a as (select *, doc_id % 2 = 0 as ok from vl) select query_id, count(*) as returned, count(*) filter (not ok) as discarded, count(*) filter (ok and score < 0.3) as rejected from a group by query_id")
def _(spark, d):
    allowed = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).filter("doc_id % 2 = 0")
    return S.accepted(_vectors(spark, d), allowed, 0.3, 5)[1]


@query("accepted_rank", f"with {_COSINE} select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank, score from vl where doc_id % 2 = 0 and score >= 0.1 qualify rank <= 5")
def _(spark, d):
    allowed = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).filter("doc_id % 2 = 0")
    return S.accepted(_vectors(spark, d), allowed, 0.1, 5)[0]


SQL["accepted_rank"] = f"with {_COSINE}, a as (select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank, score from vl where doc_id % 2 = 0 and score >= 0.1) select * from a where rank <= 5"
QUERIES["rank_in_lane"], SQL["rank_in_lane"] = QUERIES["semantic_search"], SQL["semantic_search"]
QUERIES["hybrid_inner"], SQL["hybrid_inner"] = QUERIES["hybrid_search"], SQL["hybrid_search"]
QUERIES["first_occurrence"], SQL["first_occurrence"] = QUERIES["contextual_links"], SQL["contextual_links"]


@query("recency", with_views(" select n.id, c.hash, round(1 / (100 + row_number() over (partition by n.id order by committed_at desc, c.hash) - 1), 8) as recency from commits c join commit_paths p on p.hash = c.hash join part_notes n on n.path = p.path", "commits", "commit_paths", "part_notes"))
def _(spark, d):
    j = H.commit_note_join(view(spark, d, "commits"), view(spark, d, "commit_paths"), view(spark, d, "part_notes"))
    w = W.partitionBy("id").orderBy(F.col("committed_at").desc(), "hash")
    return j.select("id", "hash", F.round(1 / (99 + F.row_number().over(w)), 8).alias("recency"))


@query("inspect_context", with_views(", s as (select distinct scope from scopes), m as (select target, scope, length(scope) - length(replace(scope, '/', '')) as depth from targets, s where scope = target or starts_with(target, scope || '/')) select target, 'guide' as role, scope, row_number() over (partition by target order by depth, scope) as rank from m union all select target, 'hub', scope, row_number() over (partition by target order by depth desc, scope) from m", "targets", "scopes"))
def _(spark, d):
    s = view(spark, d, "scopes")
    return M.inspect_context(view(spark, d, "targets").distinct(), s, s)


SQL["inspect_context"] = SQL["inspect_context"].replace("from targets, s where", "from (select distinct target from targets) targets, s where")


@query("create_note", "select doc_id, case when doc_id % 3 = 0 then 'created' when doc_id % 3 = 1 then 'unchanged' else 'conflict' end as outcome from documents where text is not null")
def _(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    have = t.filter("doc_id % 3 > 0").select("path", F.when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise("other").alias("text"))
    return A.create_notes(t.select("path", "text"), have).select(F.col("path").cast("bigint").alias("doc_id"), "outcome")


@query("add_relation", with_views(" select distinct source, predicate, target from relations where predicate <> 'supplies'", "relations"))
def _(spark, d):
    r = view(spark, d, "relations")
    added = r.select(F.lit(1).alias("seq"), F.lit("add").alias("op"), "source", "predicate", "target")
    removed = r.filter("predicate = 'supplies'").select(F.lit(2).alias("seq"), F.lit("remove").alias("op"), "source", "predicate", "target")
    return A.current_relations(added.unionByName(removed))


QUERIES["remove_relation"], SQL["remove_relation"] = QUERIES["add_relation"], SQL["add_relation"]


@query("rolling_caption_delta", "with l as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as last from conversations) select conv_id, sum(case when text = last then 0 else 1 end)::bigint as shown from l group by conv_id")
def _(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("last", F.lag("text").over(w))
    return c.groupBy("conv_id").agg(F.count_if(~F.coalesce(F.col("text") == F.col("last"), F.lit(False))).alias("shown"))


@query("scan_image_sources", "select page_id, array_to_string(list_transform(regexp_extract_all(html, '<img[^>]*src=\"([^\"]*)\"', 1), lambda x: x), ' ') as images from pages")
def _(spark, d):
    md = F.regexp_replace("html", r"<img[^>]*src=\"([^\"]*)\"", "![x]($1)")
    return table(spark, d, "pages").select("page_id", F.array_join(C.image_sources(md), " ").alias("images"))


@query("render_thread", "select conv_id, string_agg(repeat('  ', turn::int) || '- **' || role || '**: ' || regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), chr(10) order by turn) as text from conversations group by conv_id")
def _(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("document"), F.array("turn").alias("sort"), F.col("turn").cast("int").alias("depth"), F.col("role").alias("author"), F.col("text").alias("body"), F.lit("content").alias("kind"))
    return TH.outline(t).select(F.col("document").alias("conv_id"), "text")


@query("structured_status", "select conv_id, case when count(*) filter (role = 'user') = 0 then 'unsupported' else 'complete' end as status from conversations group by conv_id")
def _(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("depth"), F.when(F.col("role") == "user", "content").otherwise("other").alias("kind"))
    return TH.structured_status(TH.counts(t)).select(F.col("document").alias("conv_id"), "status")


# --- retrievers over parts as notes: each part name is a query ----------------------------------


def _bm25(docs: str, asked: str, k: int) -> str:
    """CTEs up to ``kw``: BM25 of (doc_id, text) for (query_id, text)."""
    return f"""w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') as words from ({docs})),
z as (select count(*) as n, avg(len(words)) as mean from w),
aw as (select distinct query_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) as term from ({asked})),
tf as (select doc_id, term, length, count(*) as tf from (select doc_id, len(words) as length, unnest(words) as term from w) where term in (select term from aw) group by all),
idf as (select term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf, any_value(mean) as mean from tf, z group by term),
sc as (select query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from tf join idf using (term) join aw using (term) group by all),
kw as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, score from sc qualify rank <= {k})"""


_PARTS = f""", asked as (select distinct p_name as query_id from part),
ex0 as (select query_id, id, path, lower(title) = query_id as identity, lower(title) as a, lower(path || chr(10) || id) as b, lower(concat_ws(chr(10), tag_brand, tag_type)) as c,
  list_distinct(regexp_extract_all(query_id, '{_WORDS}')) as terms from asked, part_notes),
ex1 as (select *, contains(a, query_id) or contains(b, query_id) or contains(c, query_id) as phrase, len(list_filter(terms, lambda t: contains(a, t) or contains(b, t) or contains(c, t))) as matched,
  (case when identity then 1000 else 0 end) + (case when contains(a, query_id) then 400 else 0 end) + (case when contains(b, query_id) then 300 else 0 end) + (case when contains(c, query_id) then 250 else 0 end)
  + list_sum(list_transform(terms, lambda t: (case when contains(a, t) then 40 else 0 end) + (case when contains(b, t) then 30 else 0 end) + (case when contains(c, t) then 30 else 0 end))) as points from ex0),
ex as (select query_id, id as doc_id, path, identity, (points + floor(matched * 100 / len(terms) + 0.5))::bigint as score from ex1 where points > 0 and (identity or phrase or matched >= case when len(terms) <= 1 then len(terms) else least(3, ceil(len(terms) / 2)) end)),
exact as (select query_id, doc_id, row_number() over (partition by query_id order by identity desc, score desc, path) as rank, score::double as score, identity from ex qualify rank <= 10),
st as (select query_id, rank as seed_rank, doc_id || '.md' as seed from exact where rank <= 3),
e as (select source as f, target as n, source as s, target as t from sparse_links union all select target, source, source, target from sparse_links),
c1 as (select query_id, seed_rank, any_value(seed) as seed, n, min((f, s, t)) as o from st join e on f = seed where n <> seed group by query_id, seed_rank, n),
l1 as (select query_id, seed_rank, seed, n from c1 qualify row_number() over (partition by query_id, seed_rank order by o, n) <= 11),
c2 as (select l1.query_id, l1.seed_rank, e.n, min((e.f, e.s, e.t)) as o from l1 join e on e.f = l1.n where e.n <> l1.seed and not exists (select 1 from l1 x where x.query_id = l1.query_id and x.seed_rank = l1.seed_rank and x.n = e.n) group by all),
l2 as (select c2.query_id, c2.seed_rank, c2.n from c2 join (select query_id, seed_rank, 11 - count(*) as room from l1 group by all) r using (query_id, seed_rank) qualify row_number() over (partition by c2.query_id, c2.seed_rank order by o, n) <= room),
nodes as (select query_id, seed_rank, seed as node, 0 as distance from st union all select query_id, seed_rank, n, 1 from l1 union all select query_id, seed_rank, n, 2 from l2),
best as (select query_id, node, min((seed_rank, distance, k)) as b from (select *, row_number() over (partition by query_id, seed_rank order by distance, node) as k from nodes) group by all),
graph as (select query_id, node as doc_id, row_number() over (partition by query_id order by b[2], b[1], b[3], node) as rank, 1 / (b[2] + 1) as score from best qualify rank <= 10)"""
_PART_KEYS = ", first_part as (select p_name as query_id, min(p_partkey) as p_partkey from part group by 1)"
_META = """meta as (select a.query_id, 'parts/p' || n.p_partkey as doc_id, row_number() over (partition by a.query_id order by lower('parts/p' || n.p_partkey || '.md')) as rank from first_part a join part p using (p_partkey) join part n on n.p_brand = p.p_brand and n.p_type = p.p_type qualify rank <= 10)"""
_NEAR = """vs as (select a.query_id, 'parts/p' || v.vec_id as doc_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 5) as score from first_part a join embeddings q on q.vec_id = a.p_partkey, embeddings v join part n on n.p_partkey = v.vec_id),
near as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, score from vs qualify rank <= 10)"""
_PART_KW = _bm25("select id as doc_id, concat_ws(' ', title, tag_brand, tag_type) as text from part_notes", "select distinct p_name as query_id, p_name as text from part", 10)
_PART_HYBRID = f"""lanes as (select 'exact' as lane, 1.0 as weight, query_id, doc_id, rank from exact union all select 'index', 1.0, query_id, doc_id, rank from kw), fu as ({_FUSED}),
hy as (select query_id, doc_id, row_number() over (partition by query_id order by coalesce(x.identity, false) desc, fu.score desc, doc_id) as rank, fu.score as score from fu left join (select query_id, doc_id, identity from exact) x using (query_id, doc_id) qualify rank <= 10)"""


class _Parts:
    """Parts as notes, and what each retriever finds for each part name."""

    def __init__(self, spark, d):
        self.links, part = view(spark, d, "sparse_links"), table(spark, d, "part")
        n = view(spark, d, "part_notes")
        self.notes = n.withColumns({"aliases": F.array().cast("array<string>"), "tags": F.array_compact(F.array("tag_brand", "tag_type")), "metadata_text": F.lit(""), "content": F.lit(None).cast("string")})
        self.asked = part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
        self.first = part.groupBy(F.col("p_name").alias("query_id")).agg(F.min("p_partkey").alias("p_partkey"))
        self.part, self.vectors = part, table(spark, d, "embeddings").join(part.select(F.col("p_partkey").alias("vec_id")), "vec_id").select(F.concat(F.lit("parts/p"), F.col("vec_id").cast("string")).alias("doc_id"), F.col("embedding").alias("vector"), "vec_id")

    def exact(self):
        return R.exact_scores(self.notes, self.asked)

    def graph(self, exact):
        starts = R.seeds_of(exact, 3).withColumn("seed", F.concat("seed", F.lit(".md")))
        return R.graph_hits(R.neighbourhoods(self.links, starts, 2, 12)[0], 10)

    def keyword(self):
        docs = self.notes.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "title", "tag_brand", "tag_type").alias("text"))
        return S.keyword_search(docs, self.asked, 10)

    def metadata(self):
        key = F.concat(F.lit("parts/p"), F.col("p_partkey").cast("string"))
        leaf = lambda f, k: self.part.select(key.alias("id"), F.lit(f).alias("field"), X.norm_text(F.col(k)).alias("value"))
        wanted = self.first.join(self.part, "p_partkey").select("query_id", F.explode(F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("field"), F.col("p_type").alias("value")))).alias("f")).select("query_id", "f.*")
        return R.metadata_hits(leaf("brand", "p_brand").unionByName(leaf("type", "p_type")), wanted, self.notes.select("id", "path"), 10)

    def semantic(self):
        wanted = self.first.join(self.vectors.withColumnRenamed("vec_id", "p_partkey"), "p_partkey").select("query_id", "vector")
        return S.semantic_search(self.vectors.select("doc_id", "vector"), wanted, 10)


@query("retriever_adapters", with_views(f"""{_PARTS}{_PART_KEYS}, {_META}, {_NEAR}, {_PART_KW}, {_PART_HYBRID}
select 'exact' as system, query_id, doc_id, rank, score from exact union all select 'graph', * from graph union all select 'metadata', query_id, doc_id, rank, null from meta
union all select 'semantic', * from near union all select 'keyword', query_id, doc_id, rank, score from kw union all select 'hybrid', query_id, doc_id, rank, score from hy""", "part_notes", "sparse_links"))
def _(spark, d):
    p = _Parts(spark, d)
    scores = Q.checkpointed(p.exact())
    exact, keyword = R.exact_hits(scores, 10), Q.checkpointed(p.keyword())
    pinned = exact.join(scores.select("query_id", "doc_id", "identity"), ["query_id", "doc_id"])
    lanes = {"exact": exact, "graph": p.graph(exact), "metadata": p.metadata(), "semantic": p.semantic(), "keyword": keyword, "hybrid": R.hybrid_hits(pinned, keyword, 10)}
    out = None
    for name, hits in lanes.items():
        part = hits.select(F.lit(name).alias("system"), "query_id", "doc_id", "rank", F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("graph_retriever_score", with_views(f"{_PARTS} select query_id, doc_id, rank, score from graph", "part_notes", "sparse_links"))
def _(spark, d):
    p = _Parts(spark, d)
    return p.graph(R.exact_hits(p.exact(), 10))


# --- discussions of four sites: conversations, 40 turns a page, as the JSON that each site would send ---------

_PAGES = """p as (select conv_id || '-' || (turn // 40) as document, turn % 40 as i, role, coalesce(text, '') as text, count(*) over (partition by conv_id, turn // 40) as n from conversations),
h as (select document, i, cast(0 as bigint) as depth, [i] as path from p where i = 0 union all select p.document, p.i, h.depth + 1, list_append(h.path, p.i) from p join h on p.document = h.document and p.i > 0 and (p.i - 1) // 2 = h.i),
heap as (select document, i, depth, row_number() over (partition by document order by path) - 1 as position from h)"""


def _captures(spark, d) -> DataFrame:
    """document, platform, json. Flat sites get a tree in which turn i replies to (i - 1) / 2; in nested ones odd turns reply to the first, and even ones to the turn before."""
    t = table(spark, d, "conversations").select(F.concat("conv_id", F.lit("-"), F.floor(F.col("turn") / 40)).alias("document"), (F.col("turn") % 40).alias("i"), "role", F.coalesce("text", F.lit("")).alias("text"))
    page = t.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text"))).alias("a"))
    item = "named_struct('id', {0}.i, 'by', {0}.role, 'text', {0}.text, 'deleted', {0}.role = 'system', 'kids', filter(array(2 * {0}.i + 1, 2 * {0}.i + 2), k -> exists(a, q -> q.i = k)))"
    body = "named_struct('id', concat('c', {0}.i), 'author', {0}.role, 'body', if({0}.role = 'system', '[deleted]', {0}.text)"
    inner = f"transform(filter(a, q -> q.i = p.i + 1), q -> named_struct('kind', 't1', 'data', {body.format('q')})))"
    comment = f"named_struct('kind', 't1', 'data', {body.format('p')}, 'replies', named_struct('kind', 'Listing', 'data', named_struct('children', {inner}))))"
    comments = f"transform(filter(a, p -> p.i % 2 = 1 OR p.i = 0 AND size(a) > 5), p -> if(p.i = 0, named_struct('kind', 'more', 'data', named_struct('id', 'more', 'author', cast(null AS string), 'body', cast(null AS string), 'replies', named_struct('kind', cast(null AS string), 'data', named_struct('children', slice({inner}, 1, 0))))), {comment}))"
    post = "named_struct('$type', if({0}.role = 'system', 'app.bsky.feed.defs#notFoundPost', null), 'uri', concat('u', {0}.i), 'post', if({0}.role = 'system', null, named_struct('uri', concat('u', {0}.i), 'record', named_struct('text', {0}.text), 'author', named_struct('handle', {0}.role)))"
    below = f"transform(filter(a, q -> q.i = p.i + 1), q -> {post.format('q')}))"
    shapes = {
        "x": "named_struct('tweets', transform(a, p -> named_struct('id', concat('t', p.i), 'text', p.text, 'author', named_struct('username', p.role), 'inReplyToStatusId', if(p.i = 0, null, concat('t', (p.i - 1) DIV 2)))))",
        "hacker-news": f"named_struct('root', {item.format('a[0]')}, 'descendants', transform(slice(a, 2, 100), p -> {item.format('p')}))",
        "reddit": f"named_struct('post', named_struct('kind', 't3', 'data', named_struct('id', 'p', 'title', 'T', 'selftext', a[0].text, 'author', a[0].role)), 'comments', named_struct('data', named_struct('children', {comments})))",
        "bluesky": f"named_struct('thread', {post.format('a[0]')}, 'replies', transform(filter(a, p -> p.i % 2 = 1), p -> {post.format('p')}, 'replies', {below}))))",
    }
    each = F.array(*(F.struct(F.lit(k).alias("platform"), F.expr(f"to_json({v})").alias("json")) for k, v in shapes.items()))
    return page.select("document", F.explode(each).alias("c")).select("document", "c.platform", "c.json")


@query("parse_platform_threads", f"""with recursive {_PAGES},
b as (select * from p where not exists (select 1 from p r where r.document = p.document and r.i = 0 and r.role = 'system' and p.i > 0) and not exists (select 1 from p r where p.i > 0 and p.i % 2 = 0 and r.document = p.document and r.i = p.i - 1 and r.role = 'system'))
select document, 'x' as platform, 't' || i as id, 'content' as kind, null as reason, role as author, md5(text) as body, depth::int as depth, position from heap join p using (document, i)
union all select document, 'hacker-news', i::varchar, case when role = 'system' then 'unavailable' else 'content' end, case when role = 'system' then 'deleted' end, case when role <> 'system' then role end, case when role <> 'system' then md5(text) end, depth::int, position from heap join p using (document, i)
union all select document, 'reddit', case when i = 0 then 'p' else 'c' || i end, case when role = 'system' and i > 0 then 'unavailable' else 'content' end, case when role = 'system' and i > 0 then 'deleted' end, case when role <> 'system' or i = 0 then role end, case when role <> 'system' or i = 0 then md5(text) end, case when i = 0 then 0 else 2 - i % 2 end, i + (case when i > 0 and n > 5 then 1 else 0 end) from p
union all select document, 'reddit', 'more', 'more', null, null, null, 1, 1 from p where i = 0 and n > 5
union all select document, 'bluesky', 'u' || i, case when role = 'system' then 'unavailable' else 'content' end, case when role = 'system' then 'not-found' end, case when role <> 'system' then role end, case when role <> 'system' then md5(text) end, case when i = 0 then 0 else 2 - i % 2 end, row_number() over (partition by document order by i) - 1 from b""")
def _(spark, d):
    out = PT.parse_platform_threads(_captures(spark, d))
    return out.select("document", "platform", "id", "kind", "reason", "author", F.md5("body").alias("body"), "depth", "position")


@query("thread_reading_order", """with recursive h as (select conv_id, turn, cast(0 as bigint) as depth, [turn] as path from conversations where turn = 0 union all select c.conv_id, c.turn, h.depth + 1, list_append(h.path, c.turn) from conversations c join h on c.conv_id = h.conv_id and c.turn > 0 and (c.turn - 1) // 3 = h.turn)
select conv_id, turn, depth::int as depth, row_number() over (partition by conv_id order by path) - 1 as position from h""")
def _(spark, d):
    """Whole conversations as trees in which turn t replies to (t - 1) / 3."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("key"), F.when(F.col("turn") > 0, F.expr("cast((turn - 1) DIV 3 AS int)")).cast("bigint").alias("parent"), F.col("turn").cast("bigint").alias("place"))
    t = t.withColumn("key", F.col("key").cast("bigint"))
    return PT.reading_order(t).select(F.col("document").alias("conv_id"), F.col("key").alias("turn"), "depth", "position")


# --- where a text matches -------------------------------------------------------------------------

_FOUND = """f as (select doc_id, text, case when contains(lower(text), 'de la') then instr(lower(text), 'de la') when contains(lower(text), 'ththe') then instr(lower(text), 'ththe') when contains(lower(text), 'sch') then instr(lower(text), 'sch') end as pos from documents)"""


def _match(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", SN.exact_match(F.col("text"), "de la", ["ththe", "sch"], F.lit("none")).alias("m"))


@query("first_match_line", f"with {_FOUND} select doc_id, (1 + length(left(text, pos - 1)) - length(replace(left(text, pos - 1), chr(10), '')))::int as line, (pos - 1)::int as \"offset\" from f")
def _(spark, d):
    return _match(spark, d).select("doc_id", "m.line", "m.offset")


@query("exact_snippet", f"""with {_FOUND} select doc_id, case when pos is null then 'none' else (case when pos > 181 then '…' else '' end) || trim(regexp_replace(substr(text, greatest(pos - 180, 1), 600), '\\s+', ' ', 'g')) || (case when greatest(pos - 180, 1) + 599 < length(text) then '…' else '' end) end as snippet from f""")
def _(spark, d):
    return _match(spark, d).select("doc_id", "m.snippet")


# --- geometry of texts in XML: orders as documents, line items as texts ------------------------------


def _layout_files(spark, d) -> DataFrame:
    """document, xml: a page an order; lines with an odd number are bold, and two fonts are declared, the second of them twice. Orders that end in 9 lack their page's end."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_partkey", "l_returnflag", "l_linestatus")
    line = F.concat(F.lit('<text top="'), "q", F.lit('" left="'), F.col("l_partkey") % 500, F.lit('" width="30" height="12" font="'), F.col("l_linenumber") % 3, F.lit('">'), F.when(F.col("l_linenumber") % 2 == 1, F.lit("<b>")).otherwise(""), "l_returnflag", F.lit(" &amp;&#x20;&#"), F.ascii("l_linestatus"), F.lit(";"), F.when(F.col("l_linenumber") % 2 == 1, F.lit("</b>")).otherwise(""), F.lit("</text>"))
    lines = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["x"]), "\n")
    end = F.when(F.col("l_orderkey") % 10 == 9, "").otherwise("</page>")
    return lines.select(F.col("l_orderkey").alias("document"), F.concat(F.lit('<pdf2xml><page number="'), F.col("l_orderkey") % 7 + 1, F.lit('" height="60" width="500"><fontspec id="0" size="10"/><fontspec id="1" size="7"/><fontspec id="1" size="8"/>'), body, end, F.lit("</pdf2xml>")).alias("xml"))


@query("parse_poppler_xml", """select l_orderkey as document, (l_orderkey % 7 + 1)::int as page, l_quantity::int::double as top, (l_partkey % 500)::double as "left", case l_linenumber % 3 when 0 then 10.0 when 1 then 8.0 else 12.0 end::double as font_size, l_linenumber % 2 = 1 as bold, l_returnflag || ' & ' || l_linestatus as text from lineitem where l_orderkey % 10 <> 9
union all select distinct l_orderkey, -1, null, null, null, null, 'open-page' from lineitem where l_orderkey % 10 = 9""")
def _(spark, d):
    rows = P.layout_rows(_layout_files(spark, d)).filter("code IS NOT NULL OR kind = 'text'")
    fragment = lambda c: F.when(F.col("code").isNull(), F.col(c)).alias(c)
    return rows.select("document", F.when(F.col("code").isNull(), F.col("page")).otherwise(-1).alias("page"), *map(fragment, ("top", "left", "font_size", "bold")), F.coalesce("code", "text").alias("text"))
