"""op8: odd urls and random nested rules against trying every rule."""

import random

import pytest

from cellsight.llm import url_filters as U


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate(str.maketrans(U.UPPER, U.LOWER))
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [r for r in rules if host and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else default


ODD = [None, "", "x", "http://", "http:///a", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/en/", "http://badexample.com/de/1", "http://example.com/de/", "http://.net/", "http://net/", "http://net./",
       "http://a.b.org/fr/é?://x/", "ftp://org/fr/", "http://org/de/", "http://x.net?q=/", "http://x.net#/en/", "http://a..net/", "http://u:p@x.net:80/", "http://x.net:80/", "http://ÄÖ.net/a\nb"]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    return sorted((r.url is not None, r.url or "", r.host, r.path, r.rule, r.verdict) for r in U.apply_rules(pages, U.rules_table(spark, rules)).collect())


def test_odd_urls(spark):
    want = sorted((u is not None, u or "", *plain(u, U.RULES)) for u in ODD + ODD)
    assert [tuple(map(str, r)) for r in judged(spark, ODD + ODD, U.RULES)] == [tuple(map(str, r)) for r in want]


@pytest.mark.parametrize("seed", range(2))
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(25))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(300)]
    # of rules equally long the operator takes the greatest text; so does the plain version
    want = sorted((True, u, *plain(u, rules)) for u in urls)
    assert [tuple(map(str, r)) for r in judged(spark, urls, rules)] == [tuple(map(str, r)) for r in want]


def test_empty_tables(spark):
    assert judged(spark, [], U.RULES) == []
    assert {r[5] for r in judged(spark, ODD, [])} == {"allow"}
