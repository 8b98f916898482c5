"""URL filter: host, path and rules against a plain version; the model on held-out URLs."""

import re

import duckdb

from tallyspark.llm import queries, urls


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


URLS = [None, "", "no scheme/here", "http://", "HTTP://A.NET/x", "http://net/", "http://net", "http://x.net?y", "https://example.net/en/1", "https://a.example.net/en", "https://badexample.com/de/1", "https://EXAMPLE.com/de/1?u=http://q.org/fr/", "http://b.org/fr/2#t", "http://org/fr/", "http://ÄB.org/fr", "x://y://z/de", "http://h\n.net/\n?q", "http://" + "a" * 5000 + ".com/" + "b" * 5000]


def test_host_path_and_rules(spark):
    model = urls.train_filter(urls.labelled_table(spark))
    rows = [(i, u, "h", 1) for i, u in enumerate(URLS)] + [(5, URLS[5], "h", 1), (None, URLS[9], "h", 1)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict int"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = plain(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]), r["url"]
        assert r["verdict"] == (rule[1] if rule else "block" if r["block_score"] > urls.BLOCK_ABOVE else "allow")
    assert {r["verdict"] for r in got if not r["host"] and not r["path"]} == {"allow"}
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_query_judges_every_page(spark, data_dir):
    got = queries.op5_url_filter(spark, data_dir).collect()
    pages = dict(duckdb.sql(f"select page_id, url from '{data_dir}/pages.parquet'").fetchall())
    assert len(got) == len(pages)
    for r in got:
        host, path, rule = plain(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        bad = re.search("pills|casino|bets|adult|spam|ads-track", host)
        assert r["verdict"] == (rule[1] if rule else "block" if bad else "allow"), host


def test_model_on_urls_it_has_not_seen(spark):
    bad = ["http://super-pills.test/x", "http://mega-casino.test/en/3", "http://www.adult-show.test/", "http://farm-spam.test/1", "http://big-bets.test/en/2.html", "http://ads-track2.test/p"]
    good = ["http://river.example.test/en/4", "http://www.thorin.test/de/17", "http://news.example.test/fr/9?page=2", "http://blog.anding.test/es/81.html", "http://library.test/en/2"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = {r["url"]: r["verdict"] for r in urls.judge_urls(df, urls.train_filter(urls.labelled_table(spark))).collect()}
    assert sum(got[u] == "block" for u in bad) + sum(got[u] == "allow" for u in good) >= 10
