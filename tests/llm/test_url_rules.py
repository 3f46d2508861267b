import random

from ledgerweave.llm import url_rules as U

SCHEMA = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[:cut]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), r[2] == "allow"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_random_urls_match_brute_force(spark):
    rnd = random.Random(2)
    labels = ["a", "b", "net", "c-d", "é", "x1"]
    def host():
        return ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))

    def path():
        return "".join("/" + rnd.choice(["en", "de", "e"]) for _ in range(rnd.randint(0, 3)))

    rules = list({(h, p): (h, p or "/", rnd.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(40))}.values())
    rules = list({r[:2]: r for r in rules}.values())
    urls = [rnd.choice(["http://", "HTTPS://", "", "x"]) + host().upper() + path() + rnd.choice(["", "/", "?q=/a://b", "#f"]) for _ in range(600)]
    urls += ["http://net/hot"] * 300 + [None, "", "://", "http://", "no scheme/", "http://a?b/c", "a://b://c/d", "http://n\nl/x\ny"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r.page_id: tuple(r)[1:] for r in U.judge(df, spark.createDataFrame(rules, SCHEMA)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == brute(u, rules), u


def test_empty_and_ties(spark):
    df = spark.createDataFrame([(1, "http://a.net/en/x"), (1, "http://a.net/en/x"), (None, "http://b/")], "page_id long, url string")
    none = spark.createDataFrame([], SCHEMA)
    assert [r.verdict for r in U.judge(df, none).collect()] == ["allow"] * 3
    assert U.judge(df.limit(0), none).count() == 0
    same = spark.createDataFrame([("net", "/", "block"), ("net", "/", "allow"), (None, "/", "block"), ("b", None, "block")], SCHEMA)
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in U.judge(df, same, "block").collect()) == [("1", "net/", "allow"), ("1", "net/", "allow"), ("None", None, "block")]
