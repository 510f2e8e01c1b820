import random

from reelloom.llm import url_filters as uf


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = max(
        ((len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)),
        default=None,
    )
    return host, path, best and best[3], best[4] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages, frame).collect()}


def test_against_brute_force_with_nested_rules(spark):
    rng = random.Random(1)
    labels = ["a", "b-c", "net", "org", "x!", "é", "a0"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))
    path = lambda: "/" * rng.randint(0, 1) + rng.choice(["", "en", "en/", "en/x", "d"])
    rules = list({(host(), path()): (rng.choice(["allow", "block"])) for _ in range(40)}.items())
    rules = [(h, p, a) for (h, p), a in rules]
    urls = [f"http{'s' * rng.randint(0, 1)}://{host().upper() if rng.random() < 0.3 else host()}{path()}{rng.choice(['', '?q=1', '#t', '/?a://b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c", "http://NET", "http://.net/", "http://net./"] + ["http://www.net/en/"] * 50
    found = judged(spark, urls, rules)
    assert found == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_tables_and_bad_rules(spark):
    assert judged(spark, [], [("net", "/", "block")]) == {}
    assert judged(spark, ["http://net/"], []) == {0: ("net", "/", None, "allow")}
    assert judged(spark, ["http://net/"], [(None, "/", "block"), ("", "/", "block"), ("net", None, "block")]) == {0: ("net", "/", "net", "block")}


def test_result_does_not_depend_on_partitions(spark):
    urls = [f"http://h{i % 7}.example.net/en/{i}" for i in range(300)]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("h3.example.net", "/en/1", "block")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        many = judged(spark, urls, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert many == judged(spark, urls, rules)
