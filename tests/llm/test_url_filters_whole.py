from tessera.llm import url_filters as U


def test_small_sections_and_deep_paths(spark):
    urls = [f"http://hot.org/s{n:02}/{kind}{i}" for n in range(60) for kind, most in (("b", 12), ("c", 4)) for i in range(most)]
    urls += [f"http://deep.org/a/b/c/d/{part}/{kind}{i}" for part in ("good", "bad") for kind, most in (("l", 12), ("u", 4)) for i in range(most)]
    urls += [f"http://far.net/{i}" for i in range(2000)]
    rules = tuple((f"hot.org/s{n:02}/b", "block" if n == 7 else "allow") for n in range(60)) + (("deep.org/a/b/c/d/good/l", "allow"), ("deep.org/a/b/c/d/bad/l", "block"))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.filter_urls(df, rules=rules).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    judged = {r.path: r for r in got if r.rule is None and r.host != "far.net"}
    assert {p for p, r in judged.items() if r.verdict == "block"} == {f"/s07/c{i}" for i in range(4)} | {f"/a/b/c/d/bad/u{i}" for i in range(4)}
    assert judged["/s07/c1"].template == "/s07/*" and judged["/a/b/c/d/bad/u1"].template == "/a/b/c/d/bad/*"


def test_deepest_path_alone(spark):
    df = spark.createDataFrame([(1, "http://a.org/" + "x/" * 300), (2, "http://a.org/")], "page_id long, url string")
    assert {r.page_id: r.template for r in U.filter_urls(df, rules=()).collect()} == {1: "/*" * 300, 2: ""}
