import pytest

from loanscope.llm import hosts

URLS = [("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
        ("https://example.com/en", "example.com", "/en", "com/", "allow"),
        ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("x://b.net/es/#z", "b.net", "/es/", "net/es/", "block"),
        ("x://b.net/esx/", "b.net", "/esx/", None, "allow"),
        ("x://telecom/a", "telecom", "/a", None, "allow"),
        ("x://com", "com", "", None, "allow"),
        ("x://com?/", "com", "", None, "allow"),
        ("x://u@É.org:80/a://b/", "u@É.org:80", "/a://b/", None, "allow"),
        ("no scheme.com/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("a\n://q.net/fr/\n?", "q.net", "/fr/\n", "net/fr/", "block")]


def test_hosts_paths_and_longest_rule(spark):
    rows = [(i, u, 1, "k") for i, (u, *_) in enumerate(URLS)]
    got = hosts.judged(spark.createDataFrame(rows, "page_id long, url string, host int, rule string"), "page_id", "url").collect()
    assert sorted(tuple(r) for r in got) == [(i, *want) for i, (_, *want) in enumerate(URLS)]


def posterior(rows):
    """The same prior, group by group, in plain Python.  rows: (name, domain, suffix, n, x)."""
    mean = (sum(r[4] for r in rows) + 0.5) / (sum(r[3] for r in rows) + 1)
    above = {r[2]: mean for r in rows}
    spread = {r[2]: mean * (1 - mean) / (sum(r[3] for r in rows) + 2) for r in rows}
    for key, parent in ((2, 2), (1, 2), (0, 1)):
        groups = {}
        for r in rows:
            g = groups.setdefault(r[key], [0, 0, above[r[parent]], spread[r[parent]]])
            g[0] += r[3]
            g[1] += r[4]
        over = sum((x - n * m) ** 2 / n - m * (1 - m) for n, x, m, _ in groups.values() if n)
        room = sum(m * (1 - m) * (n - 1) for n, x, m, _ in groups.values() if n)
        rho = min(max(over / room if room else hosts.RHO_DEFAULT, hosts.RHO_LEAST), hosts.RHO_MOST)
        s = 1 / rho - 1
        above = {k: (x + s * m) / (n + s) for k, (n, x, m, _) in groups.items()}
        spread = {k: above[k] * (1 - above[k]) / (n + s + 1) + (s / (n + s)) ** 2 * w for k, (n, x, m, w) in groups.items()}
    return {k: (m, m - hosts.Z * spread[k] ** 0.5) for k, m in above.items()}


def test_reputation_equals_plain_python(spark):
    counts = {"bad.spam.org": (40, 39), "new.spam.org": (0, 0), "x.spam.org": (12, 11), "good.org": (300, 2), "www.good.org": (20, 1),
              "a.co.uk": (5, 5), "b.co.uk": (9, 0), "10.0.0.1": (3, 0), "": (2, 1), "lone.xyz": (1, 1)}
    rows = [(h, i < x) for h, (n, x) in counts.items() for i in range(n)] + [(h, None) for h in counts]
    got = {r.name: r for r in hosts.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    want = posterior([(r.name, r.domain, r.suffix, *counts[r.name]) for r in got.values()])
    for name, (rate, bound) in want.items():
        assert (got[name].n, got[name].x) == counts[name]
        assert got[name].rate == pytest.approx(rate, rel=1e-9) and got[name].bound == pytest.approx(bound, rel=1e-9)
    assert got["a.co.uk"].domain == "a.co.uk" and got["a.co.uk"].suffix == "co.uk" and got["10.0.0.1"].suffix == "10.0.0.1"
    assert got["bad.spam.org"].blocked and not got["lone.xyz"].blocked and not got["good.org"].blocked
    assert got["new.spam.org"].rate > got["lone.xyz"].rate - 0.5  # leans on its domain


def test_a_bad_host_is_blocked_and_labels_count_once(spark):
    pages = spark.createDataFrame([(i, f"http://evil.org/{i}") for i in range(60)] + [(i, f"http://fine.org/{i}") for i in range(100, 300)]
                                  + [(7, "http://evil.org/again"), (400, "https://www.example.com/en/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, True) for i in range(0, 60, 2)] * 2 + [(i, False) for i in range(100, 300, 3)] + [(1, None), (None, True)],
                                   "id long, bad boolean")
    got = hosts.judged(pages, "page_id", "url", labels=labels).collect()
    assert len(got) == 262
    assert {r.host for r in got if r.verdict == "block"} == {"evil.org"} and sum(r.verdict == "block" for r in got) == 61


def test_no_pages_and_no_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([], "id long, bad boolean")
    assert hosts.judged(pages.limit(0), "page_id", "url", labels=labels).collect() == []
    assert {r.verdict for r in hosts.judged(pages, "page_id", "url", labels=labels).collect()} == {"allow"}


def test_no_python_runs(spark):
    from conftest import SF001
    plan = hosts.op12_url_filter(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
