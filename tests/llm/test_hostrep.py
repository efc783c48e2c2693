import math
from collections import defaultdict

import pytest

from tablesense.llm import hostrep as H

RULES = [H.Rule("block", "net", "/"), H.Rule("allow", "example.net", "/en/"), H.Rule("block", "example.com", "/de/"), H.Rule("allow", "org", "/fr/")]


def url_table(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "id long, good boolean")


@pytest.mark.parametrize("url,host,path,rule", [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"),
    ("https://example.net/de/x", "example.net", "/de/x", "net/"), ("https://myexample.net/en/x", "myexample.net", "/en/x", "net/"),
    ("x://net", "net", "", None), ("x://a.net?/en/", "a.net", "", None), ("http://a.org/fr/", "a.org", "/fr/", "org/fr/"),
    ("http://a.org/fr", "a.org", "/fr", None), ("ftp://b.example.com/de/1://c", "b.example.com", "/de/1://c", "example.com/de/"),
    ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("http:///path", "", "/path", None),
    ("http://ÄB.NET/x", "Äb.net", "/x", "net/"), ("http://h\nost.net/a\nb?c", "h\nost.net", "/a\nb", "net/"),
])
def test_host_path_and_longest_rule(spark, url, host, path, rule):
    r = H.url_filter(url_table(spark, [url]), labels(spark), RULES).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == ({"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}[rule] if rule else "allow")


def brute(hosts, p):
    """hosts: host -> (n, good)."""
    def weight(kids):
        kids = [k for k in kids if k[0] > 0]
        if not kids:
            return p.least_weight
        s = sum(n * (g / n - m) ** 2 for n, g, m in kids)
        v = sum(m * (1 - m) for _, _, m in kids)
        d = sum(m * (1 - m) * (n - 1) for n, _, m in kids)
        return min(max(d / (s - v) - 1 if d > 0 and s > v else p.most_weight, p.least_weight), p.most_weight)

    def suffix(h):
        return ".".join(h.split(".")[-2:]) if ".".join(h.split(".")[-2:]) in H.LONG_SUFFIXES else h.split(".")[-1]

    def domain(h):
        return ".".join(h.split(".")[-len(suffix(h).split(".")) - 1:])

    sums = {}
    for key in (suffix, domain):
        t = defaultdict(lambda: [0, 0])
        for h, (n, g) in hosts.items():
            t[key(h)][0] += n
            t[key(h)][1] += g
        sums[key] = t
    n, g = (sum(x[i] for x in hosts.values()) for i in (0, 1))
    root = (g + p.root_good) / (n + p.root_good + p.root_bad)
    mean = lambda n, g, m, w: (g + w * m) / (n + w)
    w = weight([(n, g, root) for n, g in sums[suffix].values()])
    sm = {k: mean(n, g, root, w) for k, (n, g) in sums[suffix].items()}
    up = {domain(h): sm[suffix(h)] for h in hosts}
    w = weight([(n, g, up[k]) for k, (n, g) in sums[domain].items()])
    dm = {k: mean(n, g, up[k], w) for k, (n, g) in sums[domain].items()}
    w = weight([(n, g, dm[domain(h)]) for h, (n, g) in hosts.items()])
    out = {}
    for h, (n, g) in hosts.items():
        a, b = g + w * dm[domain(h)], n - g + w * (1 - dm[domain(h)])
        out[h] = 1 / (1 + math.exp(-(math.log(a / b) + p.z * math.sqrt(1 / a + 1 / b))))
    return out


def test_bounds_equal_a_brute_force_version_and_filter(spark):
    urls, lab = [], []
    for h, n, bad in [("a.good.com", 30, 1), ("b.good.com", 1, 0), ("x.bad.com", 40, 38), ("y.bad.com", 1, 1), ("z.bad.com", 0, 0),
                      ("s.shop.co.uk", 10, 5), ("t.shop.co.uk", 3, 3), ("solo", 4, 0), ("", 2, 1)]:
        for i in range(max(n, 1)):
            urls.append(f"http://{h}/p{i}")
            if i < n:
                lab.append((len(urls) - 1, i >= bad))
    lab += [(0, None), (None, True), (10**9, True)]
    p = H.Reputation(min_rate=0.5)
    got = {r.host: r for r in H.url_filter(url_table(spark, urls), labels(spark, lab), [], p).collect()}
    counts = defaultdict(lambda: [0, 0])
    good = {i: g for i, g in lab if i is not None and g is not None}
    for i, u in enumerate(urls):
        h = u.split("/")[2]
        counts[h][0] += i in good
        counts[h][1] += good.get(i, False)
    want = brute(dict(counts), p)
    assert got.keys() == want.keys()
    for h, b in want.items():
        assert got[h].bound == pytest.approx(b, abs=1e-9)
        assert got[h].verdict == ("allow" if b >= 0.5 else "block")
    assert got["x.bad.com"].verdict == "block" and got["z.bad.com"].bound < got["b.good.com"].bound
    assert got["a.good.com"].verdict == "allow"


def test_repeats_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "c"), (1, "http://a.com/", "c"), (None, None, None)], "page_id long, url string, host string")
    got = H.url_filter(df, labels(spark, [(1, True), (1, False)]), RULES).collect()
    assert len(got) == 3 and {r.n for r in got if r.host == "a.com"} == {4}
    assert H.url_filter(df.limit(0), labels(spark), RULES).count() == 0
