from pyspark.sql import functions as F

from emberlog.llm.url_filter import Rule, domain_and_suffix, host_reputation, judge_urls, label_outcomes

URLS = {
    "https://WWW.Example.COM/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
    "http://a.net": ("a.net", "", None, "allow"),
    "http://com?x://y/": ("com", "", None, "allow"),
    "x://y.com//en/": ("y.com", "//en/", "com/", "allow"),
    "mailto:a@b.net/fr/": ("", "", None, "allow"),
    "://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "a\nb://X.net/f\nr": ("x.net", "/f\nr", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    pages = pages.select("*", *(F.lit(1).alias(c) for c in ("host", "url_domain", "url_suffix", "mean", "a0")))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = judge_urls(pages, label_outcomes(pages, labels))
    rows = out.collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["url"]], r["url"]


def test_hosts_are_judged_by_their_kin(spark):
    rows, labels, k = [], [], 0
    for host, n, bad in (("a.bad.example.com", 60, 57), ("b.bad.example.com", 40, 39), ("x.good.example.com", 90, 1),
                         ("y.good.example.com", 70, 2), ("z.good.example.org", 50, 1)):
        for i in range(n):
            rows.append((k, f"http://{host}/{i}"))
            labels.append((k, int(i >= bad), 0))
            k += 1
    new = {k: "http://new.bad.example.com/", k + 1: "http://new.good.example.com/", k + 2: "http://elsewhere.xyz/"}
    pages = spark.createDataFrame(rows + list(new.items()), "page_id long, url string")
    labels = spark.createDataFrame(labels + [(None, 0, 1), (k + 2, None, None)], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: r for r in judge_urls(pages, label_outcomes(pages, labels), [Rule("allow", "a.bad.example.com", "/7")],
                                               ).collect()}
    assert out[0]["verdict"] == "block" and out[7]["verdict"] == "allow" and out[7]["rule"] == "a.bad.example.com/7"
    assert out[100]["verdict"] == "allow" and out[k + 1]["verdict"] == "allow"
    assert out[k]["bad_rate"] > out[k + 1]["bad_rate"]
    assert 0 < out[k + 2]["bad_rate"] < 1


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([(1, "http://a.b/"), (1, "http://a.b/"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert judge_urls(pages, label_outcomes(pages, labels)).count() == 3
    assert judge_urls(pages.limit(0), label_outcomes(pages.limit(0), labels)).count() == 0
    assert host_reputation(label_outcomes(pages, labels)).hosts.count() == 1


def test_domains_and_suffixes(spark):
    hosts = {
        "blog.shop.co.uk": ("shop.co.uk", "co.uk"), "shop.co.uk:80": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "www.news.fr": ("news.fr", "fr"), "m.site.example.com": ("site.example.com", "example.com"), "example.com": ("example.com", "example.com"),
        "me@a.b.org": ("b.org", "org"), "10.0.0.1:9": ("10.0.0.1", ""), "local": ("local", "local"), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = domain_and_suffix(F.col("host"))
    assert {r[0]: (r[1], r[2]) for r in df.select("host", domain, suffix).collect()} == hosts


def test_the_query_and_its_sql_where_the_bound_blocks(spark, tmp_path):
    """Tables of the query's own form, with hosts bad enough to be blocked and kin that follow them."""
    import duckdb

    from emberlog.llm.registry import ORACLES, QUERIES

    rows, labels, k = [], [], 0
    for host, n, bad in (("a.bad.co.uk", 60, 58), ("b.bad.co.uk:8080", 50, 50), ("c.bad.co.uk", 40, 39), ("x.good.fr", 90, 2),
                         ("10.0.0.7", 30, 30), ("y.good.fr", 40, 1), ("www.site.example.com", 50, 30), ("m.site.example.com", 9, 1)):
        for i in range(n):
            rows.append((k, f"http://{host}/{'en' if i % 7 == 0 else 'x'}/{i}"))
            labels.append((k, int(i >= bad), 0))
            k += 1
    rows += [(k + i, u) for i, u in enumerate(("http://new.bad.co.uk/", "http://new.good.fr", "http://z.co.uk/", "http://q.xyz/", "mail", None))]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES["op8_url_filter"](spark, str(tmp_path))
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ", ".join(out.columns)
    want = db.execute(f"select {columns} from ({ORACLES['op8_url_filter']})").fetchall()
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    verdict = {r[0]: (r[3], r[4]) for r in got}
    assert verdict[1] == (None, "block") and verdict[k] == (None, "block") and verdict[k + 1] == (None, "allow")
