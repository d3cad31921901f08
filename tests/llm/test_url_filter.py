"""URL rules and lists against a plain loop, and the Bloom filter's own promises."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inciflow.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "https://example.org", "https://example.org/", "https://EXAMPLE.org/es/x", "http://a.b.example.org/en/12?x=1#y", "http://notexample.org/es/",
    "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://example.org./es/", "http://x.com?de/", "http://x.net#a", "ftp://u@h.org:80/a://b", "http://é.org/ü",
    "http://www.x.net:80/a/?b=2&a=1&utm_source=q#f", "https://x.net/a?a=1&b=2", "http://x.com/fr/" + "z" * 50_000, ".".join(["http://a"] + ["b"] * 500) + ".org/",
    "http://x.com/fr/1", "http://x.com/fr\n/1", "://org/", "http://org/?x", "://", "http://www.x.net/a",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:at], rest[at:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def plain(url, rules, listed, own):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if own is not None and own in listed else "allow"


@pytest.mark.parametrize("most_blocks", [1, 1 << 19])
def test_same_as_a_loop_over_the_rules(spark, monkeypatch, most_blocks):
    # a filter of one block lets nearly all keys pass: the exact join removes them
    monkeypatch.setattr(url_filter.BlockedBloom.build.__func__, "__defaults__", (url_filter.BITS, most_blocks))
    ids = [None if i == 3 else 7 if i in (4, 5) else i for i in range(len(URLS))]
    rows = [(i, u, "x", "y", 1, "z", "w", 0) for i, u in zip(ids, URLS, strict=True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, row long, key string, verdict string, met int")
    rules = url_filter.RULES + [("block", "org", "/ü"), ("allow", "x.net", "/b")]
    listed = {"x.net/a?a=1&b=2", "x.net/a", "unseen"}
    table = spark.createDataFrame([(u,) for u in [*listed, "unseen", None]], "url string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), table)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    own = [r[0] for r in pages.select(url_filter.canonical(F.col("url"))).collect()]
    want = [(i, *plain(u, rules, listed, c)) for i, u, c in zip(ids, URLS, own, strict=True)]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert sum(w[-1] == "block" and w[-2] is None for w in want) == 3


def test_no_rules_no_list_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules, none = url_filter.contract_rules(spark), spark.createDataFrame([], "url string")
    assert [tuple(r) for r in url_filter.judge(pages, rules.limit(0), none).collect()] == [(1, "a.org", "/", None, "allow")]
    assert url_filter.judge(pages.limit(0), rules, none).count() == 0


def test_canonical_and_unstable_urls(spark):
    forms = ["http://www.A.com:80/x/?utm_a=1&b=2&a=1#f", "https://a.com/x?a=1&b=2", "a.com/x", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in forms], "url string").select(url_filter.canonical(F.col("url"))).collect()]
    assert got == ["a.com/x?a=1&b=2"] * 2 + [None] * 2
    pages = [(1, "http://a.com/x", "one"), (2, "https://a.com/x/", "two"), (3, "http://b.com", "one"), (4, "http://b.com/", "one"), (5, None, "q"), (6, "http://c.com", None), (None, "http://c.com", "r")]
    assert [r[0] for r in url_filter.unstable_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()] == ["a.com/x"]


def test_bloom_holds_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    hashes = lambda a, b: np.array([r[0] for r in spark.range(a, b).select(F.xxhash64(F.concat(F.lit("k"), "id"))).collect()])
    bloom = url_filter.BlockedBloom.build(keys)
    assert bloom.words.nbytes == 20_000 * 16 // 256 * 32 and bloom.may_hold(hashes(0, 20_000)).all()
    assert bloom.may_hold(hashes(20_000, 60_000)).mean() < 0.01
    small = url_filter.BlockedBloom.build(keys, most_blocks=8)
    assert small.words.shape == (8, 8) and small.may_hold(hashes(0, 20_000)).all()
    assert not url_filter.BlockedBloom.build(keys.limit(0)).may_hold(hashes(0, 10)).any()


def test_a_hot_url_is_dealt_out(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.net/a").otherwise(F.concat(F.lit("http://x.org/"), "id")).alias("url"))
    got = url_filter.judge(pages, url_filter.contract_rules(spark), spark.createDataFrame([("hot.net/a",)], "url string"))
    assert {tuple(r) for r in got.groupBy("rule", "verdict").count().collect()} == {(None, "block", 1000), ("org/", "allow", 2000)}


def test_too_many_shapes_are_refused(spark):
    rules = spark.range(300).select(F.lit("block").alias("verdict"), F.lit("a").alias("host"), F.repeat(F.lit("/"), F.col("id").cast("int") + 1).alias("path"))
    with pytest.raises(ValueError, match="shapes"):
        url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules, spark.createDataFrame([], "url string"))


def test_the_contracts_rules_word_for_word(spark):
    """The contract's list: allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/."""
    word = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {r["host"] + r["path"]: r["verdict"] for r in url_filter.contract_rules(spark).collect()} == word
    urls = ["http://example.org/en/12", "http://a.example.org/en/1", "http://example.org/en/2", "http://example.org/es/", "http://x.com/fr/", "http://x.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, url_filter.contract_rules(spark), spark.createDataFrame([], "url string"))
    want = ["example.org/en/1", "example.org/en/1", "org/", "example.org/es/", "com/fr/", "com/de/"]
    assert [(r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()] == [(w, word[w]) for w in want]
