import random

from tablewash.llm.url_filters import filter_urls

RULES = "host string, path string, verdict string"


def _run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    out = filter_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    assert len(out) == len(urls)
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(out, key=lambda r: r["page_id"])]


def _expected(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if ("." + host).endswith("." + h) and path.startswith(p) and host
    ]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


def test_against_every_rule_tried(spark):
    pick = random.Random(3)
    rules = [
        (".".join(pick.choices(["a", "b", "net"], k=pick.randint(1, 3))), "/" + pick.choice(["", "x/", "x", "x/y/", "xy"]), pick.choice(["allow", "block"]))
        for _ in range(25)
    ]
    urls = [
        "https://" + ".".join(pick.choices(["a", "b", "net", "NET"], k=pick.randint(1, 4)))
        + pick.choice(["", "/", "/x", "/x/", "/x/y/z", "/xy/", "?x/", "/x?y", "#/x/"])
        for _ in range(400)
    ]
    assert _run(spark, urls, rules) == [_expected(u, rules) for u in urls]


def test_edges(spark):
    rules = [("net", "/", "block"), ("net", "/", "allow"), ("x.net", "/a", "allow")]
    urls = [None, "", "net/", "://", "http://É.NET/", "http://x.net/abc", "http://x.net", "http://evilnet/", "h://a://net/", "\n://n.net/", "u://" + "a." * 3000 + "net/" + "b/" * 3000]
    out = _run(spark, urls, rules)
    assert out[:4] == [("", "", None, "allow")] * 4
    assert out[4] == ("É.net", "/", "net/", "block")
    assert out[5][2:] == ("x.net/a", "allow") and out[6][2:] == (None, "allow") and out[7][2:] == (None, "allow")
    assert out[8] == ("a:", "//net/", None, "allow")
    assert out[9][2:] == ("net/", "block") and out[10][2:] == ("net/", "block")
    assert {r[3] for r in _run(spark, urls, [])} == {"allow"}
    assert _run(spark, [], rules) == []
