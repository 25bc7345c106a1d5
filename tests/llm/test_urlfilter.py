import random

from authwatch.llm import urlfilter

RULES = "host string, path string, action string"


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])
        host, slash, path = rest[:end].partition("/")
        path = slash + path
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a, h + p) for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id bigint, url string, won string")
    out = urlfilter.classify(pages, spark.createDataFrame(rules, RULES))
    assert set(out.columns) == {"page_id", "url", "won", "host", "path", "rule", "verdict"}
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_odd_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    urls = [None, "", "no scheme.com/", "http://", "http://com", "http://com/", "http://COM/x", "http://a.com/en/?q://z/", "http://example.com/en",
            "http://example.com/en/", "https://www.EXAMPLE.com/en/1#f/g", "http://m.www.example.com/en/", "http://xexample.com/en/",
            "http://net/es/a", "http://a-b.net/es/", "http://a..net/es/", "http://.net/es/", "http://net./es/", "http://example.com:80/en/",
            "http://u@example.com/en/", "http://ÉX.com/é", "x://y://example.com/en/", "http://example.com/en/\nnext", "http://example.com?/en/"] * 2
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_random_nested_rules(spark):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "a-b", "ab", "é"])
    host = lambda k: ".".join(label() for _ in range(rng.randint(1, k)))
    path = lambda k: "".join("/" + label() for _ in range(rng.randint(0, k)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(3), path(3)) for _ in range(80))}.values())
    urls = [f"http://{host(5)}{path(5)}" for _ in range(600)]
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_rules_missing_repeated_and_null(spark):
    assert judged(spark, ["http://a/b"], []) == {0: ("a", "/b", None, "allow")}
    rules = [("a", "/", "allow"), ("a", "/", "block"), ("a", None, "allow"), (None, "/", "allow"), ("A", "", "allow")]
    assert judged(spark, ["http://a/b", "http://a"], rules)[0][3] == "block"
    assert judged(spark, [], rules) == {}
