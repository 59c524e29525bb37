import re

import pytest

from vellum.llm import url_filter as U

URLS = ["http://example.com/en/1", "https://WWW.Example.com/en/2?x#y", "http://a.www.example.com/en/", "http://example.com/fr/", "http://example.com", "http://com/", "com/en/", None, "", "://", "x://net/es/a/b", "ftp://b.net/fr/?q", "http://net.evil.org/fr/", "http://notexample.com/en/", "http://example.com:80/en/", "http://example.com/EN/", "http://example.com?/en/", "http://example.com#/en/", "a://b://example.com/en/", "http://" + "a." * 300 + "net/es/" + "p" * 100_000, "http://exämple.net/fr/é", "http://example.com/en\n/x"]


def plain(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest).group()
        path = re.match(r"(?s)[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]+", lambda m: m.group().lower(), host)
    best = max(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("small_list", [10_000, 0])
@pytest.mark.parametrize("more", [0, 3000])
def test_against_plain(spark, more, small_list):
    """With one block of bits the filter passes nearly everything; the join keeps it exact."""
    rules = U.RULES + [(f"h{i}.org", f"/{i}/", "block") for i in range(more)]
    urls = URLS + [f"http://x.h{i}.org/{i}/y" for i in range(0, more, 500)]
    pages = spark.createDataFrame([(i % 7, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], None)], "page_id bigint, url string, host string")
    out = U.filter_urls(pages, U.rules_table(spark, rules), blocks=1 if more else 64, small_list=small_list).collect()
    got = sorted(str((r.page_id, r.vellum_host, r.vellum_path, r.vellum_rule, r.vellum_verdict)) for r in out)
    assert got == sorted(str((p, *plain(u, rules))) for p, u in [(i % 7, u) for i, u in enumerate(urls)] + [(None, urls[0])])


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert U.filter_urls(pages, U.rules_table(spark)).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert U.filter_urls(some, U.rules_table(spark, [])).first().vellum_verdict == "allow"
