import random
import re

from pyspark.sql import functions as F

from voxelith.llm import queries, urls

RULES = queries.URL_RULES


def brute_parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_rules_and_odd_urls(spark):
    found = [
        "http://Example.COM/en/7", "https://a.example.com/en/70?x=://", "http://example.com/en/8", "http://com/en/", "http://notcom/en/x",
        "http://x.net/de/1", "http://example.net/de/85", "http://a.b.example.net/de/8#x", "http://example.net/de/9", "ftp://q.org/es/", "http://q.org/es",
        "http://q.org?/es/", "http://q.org#/es/", None, "", "no scheme", "://", "://com/en/1", "http://ÄX.org/es/ü", "http://u@x.com:80/en/", "a://b://com/en/",
        "x" * 5000 + "://y.org/es/" + "z" * 5000, "http://a\nb.org/es/",
    ]
    df = spark.createDataFrame([(i, u, "<html>", 1) for i, u in enumerate(found)] + [(2, found[2], "<html>", 1)], "page_id long, url string, html string, Verdict int")
    got = urls.judge(df, RULES).collect()
    assert len(got) == len(found) + 1
    for r in got:
        host, path = brute_parts(r["url"])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule.name, rule.verdict if rule else "allow"), r["url"]
    assert urls.judge(df.limit(0), RULES).count() == 0


def page(i, url, canonical=None, refresh=None):
    head = f"<LINK href='{canonical}' rel=canonical>" if canonical else ""
    head += f'<meta http-equiv="Refresh" content="0; URL={refresh}">' if refresh else ""
    return (i, url, f"<head>{head}</head><p>canonical, they say")


def test_decisions_spread(spark):
    rows = [
        page(1, "http://a.xyz/1", refresh="http://www.com/en/spam"),  # blocked by where it leads
        page(2, "http://a.xyz/2", canonical="/1"),  # and what leads there
        page(3, "http://b.xyz/x/3", canonical="4"),
        page(4, "http://b.xyz/x/4", refresh="//n.net/de/1"),  # allowed by an alias that a rule allows
        page(5, "http://c.com/en/5", canonical="http://b.xyz/x/3"),  # its own rule comes first, and does not outweigh the allowing one
        page(6, "http://d.xyz/6"),
        page(7, "HTTP://D.xyz/7#top", refresh="http://d.xyz/6"),
        page(8, "http://a.xyz/2#again"),
        page(9, None, canonical="http://www.com/en/spam"),
        (10, "http://a.xyz/2", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, RULES).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("com/en/", "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "block")}
    kinds = {(r["a"], r["b"], r["kind"]) for r in urls.links(df).collect()}
    assert ("http://b.xyz/x/3", "http://b.xyz/x/4", "canonical") in kinds and ("http://b.xyz/x/4", "http://n.net/de/1", "redirect") in kinds and ("http://d.xyz/7", "http://d.xyz/6", "redirect") in kinds


def test_long_chains(spark):
    chain = [page(i, f"http://h{i}.xyz/", refresh=f"http://h{i + 1}.xyz/") for i in range(40)] + [page(40, "http://h40.xyz/", canonical="http://x.org/es/1")]
    df = spark.createDataFrame(chain, "page_id long, url string, html string").withColumn("key", F.lit(1))
    assert {r["verdict"] for r in urls.judge(df, RULES).collect()} == {"block"}


def test_every_tag_of_a_page_counts(spark):
    tags = "<link rel=canonical href=/2><link rel=canonical href=http://www.com/en/spam><meta http-equiv=refresh content='0; url=/3'><meta http-equiv=refresh content='0; url=/4'>"
    rows = [(1, "http://a.xyz/1", tags), *[(i, f"http://a.xyz/{i}", "<p>") for i in (2, 3, 4, 5)]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert urls.links(df).count() == 4
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, RULES).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_random_link_graphs_are_union_find(spark):
    """Chains, cycles, hubs and mixes of rules; verdicts by a plain union-find over all tags."""
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        names = [f"http://h{i}.xyz/p" for i in range(120)] + [f"http://{h}{p}" for h, p in (("x.com", "/en/1"), ("example.com", "/en/7"), ("q.net", "/de/1"), ("example.net", "/de/8"), ("r.org", "/es/2"), ("r.org", "/fr/2"))]
        rows, edges = [], []
        for i, u in enumerate(names + names[:5]):
            tags = ""
            for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
                v = rng.choice(names[-8:] if rng.random() < 0.08 else names[max(0, i % len(names) - 6) : i % len(names) + 3])
                edges.append((u, v))
                tags += rng.choice([f"<link rel='canonical' href='{v}'>", f'<meta http-equiv=refresh content="3;url={v}">'])
            rows.append((i, u, f"<head>{tags}</head>"))
        root = {u: u for u in names}

        def find(u):
            while root[u] != u:
                u = root[u]
            return u

        for a, b in edges:
            root[find(a)] = find(b)
        held = {}
        for u in names:
            if rule := brute_rule(*brute_parts(u)):
                held.setdefault(find(u), set()).add(rule.verdict)
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, RULES).collect()}
        assert len(got) == len(rows)
        for i, u, _ in rows:
            own, group = brute_rule(*brute_parts(u)), held.get(find(u), set())
            want = own.verdict if own else "allow" if "allow" in group or not group else "block"
            assert got[i] == (own and own.name, want), u
        assert {"allow", "block"} <= {v for _, v in got.values()}
