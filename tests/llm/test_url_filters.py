import pytest

from bidweave.llm import url_filters
from bidweave.llm.url_filters import QUERY_RULES, judge_urls, rule_table

URLS = [
    "http://a.example.net/en/1?x#y", "http://example.net/de/1", "http://net", "http://net/", "https://WWW.Example.COM/de/x", "http://example.com/de", "http://x.org/fr/", "http://notexample.net/en/", "http://a.b.c.d.e.net/en/",
    None, "", "no scheme", "http://", "://host.net/x", "http://h?u=http://b.net/", "http://example.com.evil/de/", "http://" + "a." * 3000 + "net/" + "p/" * 5000,
]


def _brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [100_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", limit)
    rules = [*QUERY_RULES, ("example.com", "/de", "allow"), ("e.net", "/", "allow"), ("example.net", "/en/", "block"), ("", "", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, rule string, prefix string")
    rows = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rule_table(spark, rules)).collect()}
    assert rows == {i: _brute(u, rules) for i, u in enumerate([*URLS, URLS[0]])}


def test_host_and_path_are_told_apart(spark):
    """A rule whose host and path only together read like a URL's does not fit it."""
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.ne/t/x")], "page_id long, url string")
    rules = rule_table(spark, [("a.ne", "t/", "block"), ("a.n", "et/x", "block")])
    assert {r["verdict"] for r in judge_urls(pages, rules).collect()} == {"allow"}


def test_many_shapes_of_rules(spark):
    rules = [("x" + "." + "y." * (i % 9) + "net", "/" + "p" * i, "block" if i % 2 else "allow") for i in range(400)]
    urls = ["http://" + "z." * (i % 3) + "x." + "y." * (i % 9) + "net/" + "p" * (i * 7 % 450) for i in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rule_table(spark, rules)).collect()}
    assert rows == {i: _brute(u, rules) for i, u in enumerate(urls)}


def test_no_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")] * 2, "page_id long, url string")
    empty = rule_table(spark, [("a.net", "/", "block")]).limit(0)
    assert [tuple(r) for r in judge_urls(pages, empty).collect()] == [(1, "a.net", "/x", None, "allow")] * 2
    assert judge_urls(pages.limit(0), rule_table(spark, QUERY_RULES)).count() == 0
    assert len(judge_urls(pages, rule_table(spark, QUERY_RULES)).collect()) == 2
