"""URL functions as columns, for http and https URLs."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query keys of trackers, and names that mark a query key as a credential.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "mibextid")
CREDENTIAL = r"(?i)(?:^|[-_])(?:access[-_]?token|refresh[-_]?token|auth(?:orization)?|api[-_]?key|credential|csrf|xsrf|jwt|pass(?:word|wd)?|secret|session[-_]?id|signature|sig|code|ticket|otp|nonce|key|magic[-_]?link|one[-_]?time)(?:$|[-_])"
#: Hosts of each platform, the host itself and all below it.
PLATFORMS = {
    "x": ("x.com", "twitter.com"),
    "hacker-news": ("news.ycombinator.com",),
    "reddit": ("reddit.com",),
    "bluesky": ("bsky.app",),
    "substack": ("substack.com",),
    "instagram": ("instagram.com",),
    "linkedin": ("linkedin.com",),
    "facebook": ("facebook.com",),
    "tiktok": ("tiktok.com",),
    "threads": ("threads.net", "threads.com"),
    "youtube": ("youtube.com", "youtu.be"),
    "github": ("github.com",),
}
#: IPv4 blocks that are not public.
PRIVATE_BLOCKS = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")
#: IPv6 blocks that are not public.
PRIVATE_BLOCKS_6 = ("fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8", "64::/16", "100::/16", "2001::/23", "2001:db8::/32", "2002::/16", "3ffe::/16", "3fff::/20", "5f00::/16")
#: Host (itself and, with a dot before it, all below; ``*``: any), whether hosts below count, platform, and the pattern of ``host/path?query`` with the names of its groups.
ROUTES = (
    (".x.com", "x", r"^[^/]*/(?<handle>[a-zA-Z0-9_]{1,32})/status/(?<postId>\d+)(?:[/?]|$)"),
    (".twitter.com", "x", r"^[^/]*/(?<handle>[a-zA-Z0-9_]{1,32})/status/(?<postId>\d+)(?:[/?]|$)"),
    ("news.ycombinator.com", "hacker-news", r"^[^/]*/item\?(?:[^&]*&)*?id=(?<itemId>\d+)(?:&|$)"),
    (".reddit.com", "reddit", r"^[^/]*/r/(?<subreddit>[^/?]+)/comments/(?<postId>[a-zA-Z0-9]+)(?:/[^/?]+/(?<commentId>[a-zA-Z0-9]+)(?=[/?]|$))?(?:[/?]|$)"),
    (".reddit.com", "reddit", r"^[^/]*(?:/[^/?]+)*?/comments/(?<postId>[a-zA-Z0-9]+)(?:/[^/?]+/(?<commentId>[a-zA-Z0-9]+)(?=[/?]|$))?(?:[/?]|$)"),
    ("redd.it", "reddit", r"^[^/]*/(?<postId>[a-zA-Z0-9]+)(?:[/?]|$)"),
    ("bsky.app", "bluesky", r"^[^/]*/profile/(?<actor>[^/?]+)/post/(?<postId>[^/?]+)"),
    (".substack.com", "substack", r"^(?:(?<publication>[^/]*)\.)?substack\.com(?:/|$)"),
    (".instagram.com", "instagram", r"^[^/]*/(?:p|reel|tv)/(?<contentId>[^/?]+)"),
    (".instagram.com", "instagram", r"^"),
    (".linkedin.com", "linkedin", r"^[^/]*(?:/[^/?]*)*?/(?<contentId>[^/?]*(?:activity|ugcPost|share)[:-]?\d+[^/?]*)"),
    (".linkedin.com", "linkedin", r"^[^/]*(?:/[^/?]+/(?<contentId>[^/?]+))?"),
    (".facebook.com", "facebook", r"\?(?:[^&]*&)*?story_fbid=(?<contentId>[^&]*)"),
    (".facebook.com", "facebook", r"\?(?:[^&]*&)*?v=(?<contentId>[^&]*)"),
    (".facebook.com", "facebook", r"^[^/]*(?:(?:/[^/?]+)*/(?<contentId>[^/?]+))?/?(?:\?|$)"),
    ("fb.com", "facebook", r"^[^/]*(?:(?:/[^/?]+)*/(?<contentId>[^/?]+))?/?(?:\?|$)"),
    ("fb.watch", "facebook", r"^[^/]*(?:(?:/[^/?]+)*/(?<contentId>[^/?]+))?/?(?:\?|$)"),
    (".tiktok.com", "tiktok", r"^[^/]*(?:/[^/?]+)*?/video/(?<contentId>[^/?]+)"),
    (".tiktok.com", "tiktok", r"^[^/]*(?:/(?!video(?:[/?]|$))(?<contentId>[^/?]+))?"),
    (".threads.com", "threads", r"^[^/]*(?:/[^/?]+)*?/post/(?<contentId>[^/?]+)"),
    (".threads.com", "threads", r"^"),
    (".threads.net", "threads", r"^[^/]*(?:/[^/?]+)*?/post/(?<contentId>[^/?]+)"),
    (".threads.net", "threads", r"^"),
    ("web.whatsapp.com", "whatsapp", r"^"),
    (".youtube.com", "youtube", r"\?(?:[^&]*&)*?v=(?<contentId>[^&]*)"),
    (".youtube.com", "youtube", r"^[^/]*/(?:shorts|live)/(?<contentId>[^/?]+)"),
    (".youtube.com", "youtube", r"^"),
    ("youtu.be", "youtube", r"^[^/]*(?:/(?<contentId>[^/?]+))?"),
    ("github.com", "github", r"^[^/]*/(?<owner>[A-Za-z0-9_.-]+)/(?<repository>[A-Za-z0-9_.-]+)/(?<route>issues|pull|discussions)/(?<contentId>\d+)(?:[/?]|$)"),
    ("*", "discourse", r"^(?:[^/]*\.)?(?:discourse|discuss|forum|community)(?:\.[^/]*)?/t/(?:(?!\d+(?:[/?]|$))[^/?]+/)?(?<topicId>\d+)(?:[/?]|$)"),
    ("*", "generic", r"^(?<host>[^/]*)"),
)
PRIVATE_SUFFIXES = (".localhost", ".local", ".internal", ".lan", ".home", ".home.arpa")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))


def platform(url: Column) -> Column:
    """Platform by host, never by lookalikes; null if the URL isn't http."""
    name = host(url)
    out = F.when(~url.rlike("^(?i:https?)://[^/?#]"), None)
    for key, domains in PLATFORMS.items():
        for d in domains:
            out = out.when((name == d) | name.endswith("." + d), key)
    return out.otherwise("generic")


def classify(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``vellum_platform`` and ``vellum_ids`` (a map of the ids that the route names): both null for what isn't an http URL.

    Routes are a small table. A URL meets those of its host and of the hosts above it by an equi-join; the first whose pattern fits its host, path and query
    decides. Lookalike hosts meet none. Path segments are percent-decoded; empty ones don't count. Each row stands for itself.
    """
    spark = urls.sparkSession
    names = sorted({n for *_, p in ROUTES for n in re.findall(r"\(\?<(\w+)>", p)})
    rows = []
    for order, (at, platform_, pattern) in enumerate(ROUTES):
        groups = re.findall(r"\((?:\?<(\w+)>|(?!\?))", pattern)
        rows.append((order, at, platform_, pattern, [groups.index(n) + 1 if n in groups else 0 for n in names]))
    routes = F.broadcast(spark.createDataFrame(rows, "order int, at string, platform string, pattern string, groups array<int>"))
    name = host(F.col(url))
    rest = F.regexp_extract(F.regexp_replace(F.col(url), "#.*$", ""), r"^(?i:https?)://[^/?]*(.*)$", 1)
    path = F.array_join(F.filter(F.transform(F.split(F.regexp_extract(rest, r"^([^?]*)", 1), "/"), lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)), lambda p: p != ""), "/")
    subject = F.concat(name, F.when(path != "", F.concat(F.lit("/"), path)).otherwise(""), F.regexp_extract(rest, r"(\?.*)$", 1))
    labels = F.split(name, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keyed = urls.select("*", F.monotonically_increasing_id().alias("vellum_row"), F.when(F.col(url).rlike("^(?i:https?)://[^/?#]"), subject).alias("vellum_subject"), F.concat(F.array(name, F.lit("*")), above).alias("vellum_at"))
    met = keyed.select("vellum_row", "vellum_subject", F.explode("vellum_at").alias("at")).filter("vellum_subject IS NOT NULL").join(routes, "at").filter(F.expr("vellum_subject RLIKE pattern"))
    first = met.groupBy("vellum_row").agg(F.min(F.struct("order", "platform", "pattern", "groups", "vellum_subject")).alias("r"))
    got = F.array(*(F.struct(F.lit(n).alias("key"), F.when(F.col("r.groups")[i] > 0, F.expr(f"regexp_extract(r.vellum_subject, r.pattern, r.groups[{i}])")).alias("value")) for i, n in enumerate(names)))
    ids = F.map_from_entries(F.filter(got, lambda e: e["value"] != ""))
    return keyed.join(first.select("vellum_row", F.col("r.platform").alias("vellum_platform"), ids.alias("vellum_ids")), "vellum_row", "left").drop("vellum_row", "vellum_subject", "vellum_at")


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once; else each use would repeat its whole expression."""
    return F.transform(F.array(value), of)[0]


def _in_blocks(high: Column, blocks: tuple[str, ...]) -> Column:
    """Whether an address, 32 bits or the upper 64 of 128, lies in one of the blocks."""
    inside = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        shift = (32 if net.version == 4 else 64) - net.prefixlen
        base = int(net.network_address) >> (64 if net.version == 6 else 0)
        inside = inside | (F.shiftrightunsigned(high, shift) == F.lit(base >> shift).cast("bigint"))
    return inside


def _four(text: Column) -> Column:
    """The number of a dotted IPv4 address, or null."""
    number = lambda parts: F.when(~F.exists(parts, lambda p: p > 255), F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p))
    return F.when(text.rlike(r"^(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}$"), _let(F.transform(F.split(text, r"\."), lambda p: p.try_cast("bigint")), number))


def _six(text: Column) -> Column:
    """The upper and lower half of an IPv6 address as 64-bit numbers, in a struct; null if it isn't one."""
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    half = lambda whole, at: F.aggregate(F.slice(whole, at, 4), F.lit(0).cast("bigint"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint")))

    def without_four(t: Column) -> Column:
        tail = F.regexp_extract(t, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        front = F.substr(t, F.lit(1), F.length(t) - F.length(tail))
        return F.when(tail == "", t).otherwise(_let(_four(tail), lambda n: F.concat(front, F.lower(F.hex(F.shiftrightunsigned(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535))))))

    def filled(sides: Column) -> Column:
        n = F.size(sides["left"]) + F.size(sides["right"])
        whole = F.concat(sides["left"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), sides["right"])
        return F.when(F.when(sides["gap"], n < 8).otherwise(n == 8), whole)

    def halves(bare: Column) -> Column:
        gap = F.contains(bare, F.lit("::"))
        sides = F.struct(gap.alias("gap"), groups(F.substring_index(bare, "::", 1)).alias("left"), F.when(gap, groups(F.substring_index(bare, "::", -1))).otherwise(F.array().cast("array<string>")).alias("right"))
        valid = bare.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")
        return F.when(valid, _let(_let(sides, filled), lambda w: F.when(w.isNotNull(), F.struct(half(w, 1).alias("high"), half(w, 5).alias("low")))))

    return _let(without_four(text), halves)


def is_private_host(name: Column) -> Column:
    """Whether a host is local, has a private suffix, or is an IPv4 or IPv6 address out of the public blocks.

    IPv6 addresses may stand in brackets and have a zone; IPv4 addresses in them are judged as such. What is neither address is judged by name.
    """

    def six(address: Column) -> Column:
        high, low = address["high"], address["low"]
        inner = low.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
        return F.when((high == 0) & F.shiftrightunsigned(low, 32).isin(0, 0xFFFF), _in_blocks(inner, PRIVATE_BLOCKS)).otherwise(_in_blocks(high, PRIVATE_BLOCKS_6))

    def judged(bare: Column) -> Column:
        named = bare.isin("localhost", "localhost.localdomain")
        for s in PRIVATE_SUFFIXES:
            named = named | bare.endswith(s)
        by_four = _let(_four(bare), lambda n: F.when(n.isNotNull(), _in_blocks(n, PRIVATE_BLOCKS)))
        by_six = F.when(F.contains(bare, F.lit(":")), _let(_six(bare), lambda a: F.when(a.isNotNull(), six(a))))
        return F.coalesce(by_four, by_six, named)

    clean = F.regexp_replace(F.regexp_replace(name, r"^\[|\]$|\.$", ""), r"^([0-9a-fA-F:.]*:[0-9a-fA-F:.]*)%.*$", "$1")
    return _let(F.lower(clean), judged)


def canonicalize(url: Column) -> Column:
    """Without fragment, tracking keys and credential keys; other keys in order. URLs of x.com, under any of its hosts, get that host and lose the keys ``s`` and ``t``."""
    bare = F.regexp_replace(url, "#.*$", "")
    of_x = platform(url) == "x"
    base, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    base = F.when(of_x, F.regexp_replace(base, r"^((?i:https?)://(?:[^/@]*@)?)[^/:]*", "$1x.com")).otherwise(base)
    name = lambda pair: F.lower(F.substring_index(pair, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING) & ~name(p).rlike(CREDENTIAL) & ~(of_x & F.substring_index(p, "=", 1).isin("s", "t")))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def identity(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment; null for URLs that aren't public http."""
    scheme = F.lower(F.regexp_extract(url, r"^((?i:https?))://", 1))
    port = F.regexp_extract(url, r"^(?i:https?)://(?:\[[^\]/?#]*\]|[^/?#:\[]*)(:\d+)", 1)
    rest = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"^(?i:https?)://[^/?#]*(.*)$", 1)
    default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    whole = F.concat(scheme, F.lit("://"), host(url), F.when(default, "").otherwise(port), path)
    public = (scheme != "") & (host(url) != "") & ~url.rlike(r"^(?i:https?)://[^/?#]*@") & ~is_private_host(host(url)) & (F.trim(url) == url) & ~url.rlike(r"[\x{0000}-\x{0020}\x{007F}]") & (F.octet_length(url) <= 8192)
    return F.when(public, whole)


def sanitize(url: Column) -> Column:
    """Without user info, credential and signature keys, and fragments that hold a credential."""
    bare = F.regexp_replace(url, r"^((?i:https?)://)[^/?#@]*@", "$1")
    fragment = F.regexp_extract(bare, "#(.*)$", 1)
    kept = F.when((fragment == "") | fragment.rlike(CREDENTIAL) | F.contains(fragment, F.lit("=")), "").otherwise(F.concat(F.lit("#"), fragment))
    front, query = F.regexp_extract(bare, r"^([^?#]*)", 1), F.regexp_extract(bare, r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).rlike(CREDENTIAL) & ~name(p).rlike(r"^x-(?:amz|goog)-|^(?:se|sp|sr|sv|spr|skoid|sktid)$"))
    return F.concat(front, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""), kept)


def exact_query(url: Column) -> Column:
    """The URL in quotes as a search phrase; null if it isn't public or a key of it looks like a credential."""
    known = identity(url)
    keys = F.transform(F.split(F.regexp_extract(known, r"\?(.*)$", 1), "&"), lambda p: F.substring_index(p, "=", 1))
    return F.when(known.isNotNull() & ~F.exists(keys, lambda k: k.rlike(CREDENTIAL)) & ~F.contains(known, F.lit('"')), F.concat(F.lit('"'), known, F.lit('"')))
