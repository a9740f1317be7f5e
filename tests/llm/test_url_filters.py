import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import url_filters as U

SCHEMA = "page_id long, url string, html string, host string, template string, ruled int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:n], rest[n:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for rule, verdict in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def brute(rows):
    """The template tree with dictionaries."""
    pages = []
    for i, url in rows:
        host, path = parts(url)
        rule, verdict = rule_of(host, path)
        plain = path[1:] if path.startswith("/") else path
        plain = plain.rstrip("/").replace("*", "%2A")
        pages.append({"id": i, "host": host, "path": path, "rule": rule, "ruled": verdict, "seg": plain.split("/") if plain else [], "t": ""})
    level = 0
    while sum(len(p["seg"]) > level for p in pages) >= U.SUPPORT or level == 0 and len(pages) >= U.SUPPORT:
        n = Counter((p["host"], p["t"], p["seg"][level]) for p in pages if len(p["seg"]) > level)
        wide = Counter()
        for (h, t, s), c in n.items():
            wide[s] += c
        for p in pages:
            p["next"] = p["t"]
            if len(p["seg"]) > level:
                s = p["seg"][level]
                keep = n[p["host"], p["t"], s] >= U.SUPPORT or wide[s] >= max(U.SUPPORT, U.WIDE_SHARE * len(pages))
                p["next"] += "/" + (s if keep else "*")
        for p in pages:
            p["t"] = p["next"]
        level += 1
    for p in pages:
        p["t"] += "/*" * max(0, len(p["seg"]) - level)
    n, b = Counter(), Counter()
    for p in pages:
        n[p["host"], p["t"]] += p["ruled"] is not None
        b[p["host"], p["t"]] += p["ruled"] == "block"
    branch = {k: k[1] for k in n}
    deepest = max(len(re.sub(r"(/\*)+$", "", k[1]).split("/")) - 1 for k in n)
    for level in reversed(range(deepest)):
        wild = {}
        for k, x in branch.items():
            s = x.split("/")
            wild[k] = "/".join([*s[: level + 1], "*", *s[level + 2 :]]) if len(s) > level + 1 else x
        own, every = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for k in branch:
            for group, key in ((own, (k[0], wild[k], branch[k])), (every, (k[0], wild[k]))):
                group[key][0] += n[k]
                group[key][1] += b[k]
        merged = {}
        for k in branch:
            (m, c), (ma, ca) = own[k[0], wild[k], branch[k]], every[k[0], wild[k]]
            rate, merged[k] = (ca + 1) / (ma + 2), branch[k]
            if not m and ma:
                merged[k] = wild[k]
            if m and ma - m:
                if abs(c / m - (ca - c) / (ma - m)) <= U.SIMILAR_Z * (rate * (1 - rate) * (1 / m + 1 / (ma - m))) ** 0.5:
                    merged[k] = wild[k]
        branch = merged
    all_rate = (sum(b.values()) + 1) / (sum(n.values()) + 2)
    sn, sb = Counter(), Counter()
    for h, t in n:
        sn[t] += n[h, t]
        sb[t] += b[h, t]
    shape = {t: (sb[t] + U.STRENGTH * all_rate) / (sn[t] + U.STRENGTH) for t in sn}
    groups = defaultdict(list)
    for k in n:
        groups[k[0], branch[k]].append(k)
    purity = {}
    for g, ks in groups.items():
        prior = sum(shape[k[1]] for k in ks) / len(ks)
        purity[g] = 1 - (sum(b[k] for k in ks) + U.STRENGTH * prior) / (sum(n[k] for k in ks) + U.STRENGTH)
    out = []
    for p in pages:
        g = (p["host"], branch[p["host"], p["t"]])
        out.append((p["id"], p["host"], p["path"], p["rule"], p["ruled"] or ("block" if purity[g] < U.MIN_PURITY else "allow"), g[1], round(purity[g], 9)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.example.org", "b.example.org", "x.example.com", "y.example.com", "n.example.net", "M.Example.NET"]
    rows = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.choice(['', 'list/', 'a/b/c/d/'])}{rng.randrange(2000)}{rng.choice(['', '/', '.html', '?p=1', '#top'])}") for i in range(500)]
    rows += [(600, None), (601, "no scheme"), (602, "http://example.org"), (603, "http://EXAMPLE.org?x"), (604, "a://b://org/c"), (605, "http://org/"), (606, "http://notorg/x"), (607, "://com/de/*"), (None, "http://n.example.net/de/1"), (1, rows[1][1]), (608, "")]
    df = spark.createDataFrame([(*r, "h", "x", "t", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in U.filter_urls(df).collect()), key=str)
    assert got == brute(rows)
    net = {r[5]: r[6] for r in got if r[1] == "n.example.net"}
    assert net["/de/*"] < net["/fr/*"]


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("url", [None, "", "x"])
def test_no_labels(spark, url):
    got = U.filter_urls(spark.createDataFrame([(1, url, "", "", "", 0)], SCHEMA)).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("", "", None, "allow")]
