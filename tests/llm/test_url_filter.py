import random
import time

import pytest

from corpusmill.llm import url_filter
from corpusmill.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:at], rest[at:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h.split(".")), len(p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "HTTP://A.Org/x?y#z", "http://example.org/es/", "http://example.org/es", "https://x.EXAMPLE.org/en/17/b",
    "http://notexample.org/en/1", "http://a.com/fr/x", "http://a.com/de/", "http://a.com/de?x=/de/", "http://com/de/é", "http://a.com:80/de/", "x://y://z.org/", "http://é.org/\nline", "http://a.net/" + "seg/" * 5000,
]


@pytest.mark.parametrize("largest", [url_filter.MAX_TRIE_BYTES, 0])
def test_equal_to_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(url_filter, "MAX_TRIE_BYTES", largest)
    rng = random.Random(1)
    urls = URLS + URLS[:3] + ["http://" + ".".join(rng.choices(["a", "example", "org", "com"], k=3)) + "/" + "/".join(rng.choices(["es", "en", "1", "12", "fr", "de", ""], k=3)) for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(urls)}


def test_a_very_long_segment():
    rules = [("block", "a.org", "/" + "x" * n) for n in (1, 40, 5000)] + [("allow", "a.org", "/q/")]
    trie, start = url_filter.Trie(rules), time.monotonic()
    assert [trie.find("b.a.org", "/" + "x" * n) for n in (39, 40, 4999, 1_000_000)] == [0, 1, 1, 2]
    assert trie.find("a.org", "/" + "y" * 1_000_000) == -1
    assert time.monotonic() - start < 1


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string")
    assert [tuple(r)[2:] for r in url_filter.filter_urls(pages, [], "block").collect()] == [("a.org", "/", None, "block")]
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).collect() == []
