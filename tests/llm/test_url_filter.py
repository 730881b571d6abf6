"""URL filter: parts and rules by hand, the smoothed model against plain Python."""

import math
from collections import Counter

from pyspark.sql import functions as F

from rowmill.llm import url_filter

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_parts_and_rules(spark):
    cases = [
        (None, "", "", None), ("no scheme.com/x", "", "", None), ("http://A.Com", "a.com", "", None),
        ("http://A.Com/", "a.com", "/", "com/"), ("x://com/a?b#c", "com", "/a", "com/"), ("x://notcom/a", "notcom", "/a", None),
        ("https://m.example.com/en/1#t", "m.example.com", "/en/1", "example.com/en/"),
        ("https://WWW.example.com/en/1?q=/", "www.example.com", "/en/1", "www.example.com/en/"),
        ("https://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/"),
        ("https://example.com/En/", "example.com", "/En/", "com/"), ("a://x.net/es/é ü", "x.net", "/es/é ü", "net/es/"),
        ("://?x", "", "", None), ("http://x.net?a=/es/", "x.net", "", None), ("http://é.org/a\nb", "é.org", "/a\nb", None),
        ("http://y.net/" + "long/" * 4000, "y.net", "/" + "long/" * 4000, None),
    ]
    rows = [(k, c[0], "h", "p") for k, c in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    found = url_filter.filter_urls(pages, RULES).collect()
    assert len(found) == 2 * len(cases)
    for r in found:
        assert (r.host, r.path, r.rule) == cases[r.page_id][1:]
        assert r.verdict == {rule: v for v, rule in RULES}.get(r.rule, r.verdict)
        assert r.verdict in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0), RULES).collect() == []


def test_model(spark):
    good, bad = ["a.com/xy", "a.com/xyz"], ["b.net/es/12", "b.net/es/34"]

    def runs(url):
        s = "^^^" + "".join("0" if c.isdigit() else c for c in url) + "^"
        return [s[i : i + 4] for i in range(len(s) - 3)]

    def model(urls):
        seen = [Counter(r[4 - k :] for u in urls for r in runs(u)) for k in range(5)]

        def p(run, k=4):
            if k == 0:
                return 1 / 32
            context = run[4 - k : 3]
            own = {g: n for g, n in seen[k].items() if g[:-1] == context}
            lower, total = p(run, k - 1), sum(own.values())
            return (own.get(run[4 - k :], 0) + len(own) * lower) / (total + len(own)) if total else lower

        return p

    rows = [(u, 1, 0) for u in good] + [(u, 0, 1) for u in bad]
    df = spark.createDataFrame(rows, "url string, good long, bad long")
    counts = df.select("good", "bad", F.explode(url_filter.runs_of(F.col("url"), F.lit(""))).alias("code"))
    counts = counts.groupBy("code").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ratios = {r.code: r.ratio for r in url_filter.log_ratios(counts).collect()}
    assert len(ratios) == 32**4
    p_good, p_bad = model(good), model(bad)
    for run in [r for u in [*good, *bad, "q-_/.org", "a.net/xy1"] for r in runs(u)]:
        code = 0
        for c in run:
            code = code * 32 + url_filter.CLASSES.index(c)
        assert math.isclose(ratios[code], math.log(p_good(run)) - math.log(p_bad(run)), abs_tol=1e-9)


def test_very_long_urls(spark):
    """Time grows with the length, not with its square; long URLs are scored like short ones."""
    long = [(k, "http://" + h + "." + t + "/" + "ab/c9" * 40_000) for k, (h, t) in enumerate((("a", "com"), ("b", "org"), ("c", "net/es"), ("d", "org")))]
    short = [(100 + k, f"http://{'xy'[k % 2]}{k}.{'com' if k % 2 else 'net/es'}/{k * k}") for k in range(60)]
    pages = spark.createDataFrame(long + short, "page_id long, url string")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, RULES).collect()}
    assert len(found) == 64 and found[0].verdict == "allow" and found[2].verdict == "block"
    assert found[1].score is not None and found[1].verdict in ("allow", "block")
