"""The filter cascade: exact on its universe, and the rules against plain
Python."""

import random

from pyspark.sql import functions as F

from labelsift.llm import urlfilter


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_cascade_is_exact_on_the_universe(spark):
    rng = random.Random(3)
    universe = [f"host{i}.example" for i in range(4000)]
    listed = rng.sample(universe, 700) + ["outside.example"]
    c = urlfilter.Cascade(keys(spark, universe), keys(spark, listed))
    assert len(c.levels) > 1
    got = keys(spark, universe + ["outside.example"]).withColumn("m", c.contains(F.col("key"))).collect()
    assert {r["key"] for r in got if r.m} == set(listed)


def test_empty_list_null_keys_and_large_lists(spark, monkeypatch):
    some = keys(spark, ["a", "b", None, "c", "c"])
    c = urlfilter.Cascade(some, keys(spark, []))
    assert some.filter(c.contains(F.col("key"))).count() == 0
    c = urlfilter.Cascade(some, keys(spark, ["b", None]))
    assert [r["key"] for r in c.mark(some, "m", F.col("key")).filter("m").collect()] == ["b"]
    monkeypatch.setattr(urlfilter, "MAX_WORDS", 0)
    big = urlfilter.Cascade(some, keys(spark, ["c"]))
    assert big.too_large
    assert [r["key"] for r in big.mark(some, "m", F.col("key")).filter("m").collect()] == ["c", "c"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return (host, path, *(best or (None, None)))


def test_rules_against_plain_python(spark):
    urls = ["http://EXAMPLE.net/en/x", "http://a.example.net/de/", "https://net/", "https://x.net",
            "https://x.net?q=/", "ftp://example.com/de/a#b", "http://www.example.com/en/",
            "http://www.example.com/de", "http://notexample.com/de/", "http://b.org/fr/x?y", "http://b.org/en/",
            "no scheme", None, "", "://", "http://", "http:///de/", "http://a..net/x", "x://y://net/z",
            "http://ÄB.Net/é/", "http://example.com/de/a", "http://example.com/de/a", "http://h" + "a." * 3000 + "net/"]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://q.net/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")
    got = urlfilter.judge_urls(pages).collect()
    assert len(got) == len(rows)
    caught = {plain(u)[0] for _, u, _, _ in rows if plain(u)[3] == "block"}
    want = sorted((str(i), *plain(u)[:3], plain(u)[3] or ("block" if plain(u)[0] in caught else "allow"))
                  for i, u, _, _ in rows)
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == \
        sorted(want, key=lambda x: (x[0], x[1], x[2], str(x[3]))) or \
        sorted(map(str, [(str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, want))


def test_empty_table_and_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
    plan = urlfilter.judge_urls(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
