"""URL rules against comparing every rule, with colliding digests and many volumes."""

import re

import numpy as np
import pytest

from trackspark.llm import urls

PAGES = "page_id long, url string, host long, path int, rule string, verdict string"
AWKWARD = [
    None, "", "no scheme/net/", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net?x=/", "http://a.net#/",
    "http://www.example.net/en/1?q", "http://example.net/EN/1", "http://example.com/de/2", "http://notexample.com/de/", "http://x.org/fr/",
    "http://x.org/fr", "http://u@b.net:80/", "http://net:80/", "http://..net/", "http://net./", "http://é.net/日本/x", "a://b://net/", "x://\nnet/\n",
    "http://" + "a." * 3000 + "net/" + "p" * 100_000, "http://ÀB.Net/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if h and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (len(rule.encode()), len(h.encode()), verdict)  # of equal rules the one that blocks
            best = max(best or key, key) if best is None or key > best[:3] else best
            best = (*key, rule) if best[:3] == key else best
    return host, path, best[3] if best else None, best[2] if best else default


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(7)
    parts = ["a", "b", "c", "net", "org", "com"]
    made = [
        "http://" + ".".join(rng.choice(parts, rng.integers(1, 5))) + "/" + "/".join(rng.choice(parts, rng.integers(0, 4))) for _ in range(400)
    ]
    rows = [(i, u) for i, u in enumerate(AWKWARD + made)] + [(None, "http://a.net/"), (7, "http://a.net/")]
    return spark.createDataFrame([(*r, 1, 2, "r", "v") for r in rows], PAGES)


def check(spark, pages, rules, **settings):
    table = spark.createDataFrame(rules, "rule string, verdict string")
    got = sorted(map(tuple, urls.judge(pages, table, **settings).collect()), key=str)
    known = [r for r in rules if r[0] and r[1] in ("allow", "block")]
    assert got == sorted(((r.page_id, *brute(r.url, known)) for r in pages.collect()), key=str)


def test_fixed_rules_equal_brute_force(spark, pages):
    check(spark, pages, [(r, v) for v, r in (line.split() for line in urls.RULES.split("\n") if line)])


@pytest.mark.parametrize("settings", [{}, {"volume": 7}, {"digest": lambda text: len(text) % 5 - 2, "volume": 20}])
def test_many_rules_volumes_and_collisions(spark, pages, settings):
    rng = np.random.default_rng(8)
    parts = ["a", "b", "c", "net", "org"]
    rules = {}
    for _ in range(150):
        host = ".".join(rng.choice(parts, rng.integers(1, 4)))
        path = str(rng.choice(["", "/", "/a", "/a/b", "/net/", "/日本"]))
        rules[host + path] = str(rng.choice(["allow", "block"]))
    both = "a.b" + "/c"
    rules.pop(both, None)
    check(spark, pages, [*rules.items(), (both, "allow"), (both, "block"), (None, "block"), ("/x", "block"), ("", "block"), ("c/", "odd")], **settings)


def test_empty_tables(spark, pages):
    rules = urls.rules_of(spark, urls.RULES)
    assert urls.judge(pages.where("false"), rules).count() == 0
    got = urls.judge(pages, rules.where("false"), default="block").collect()
    assert len(got) == pages.count() and {(r.rule, r.verdict) for r in got} == {(None, "block")}
