import random

import duckdb
import pytest

from slantspark.llm import queries, url_filter

RULES = "host string, path string, verdict string"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + "/" + p), len(h), v == "block", h + p) for h, p, v in rules
           if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], "allow" if not best or not best[2] else "block"


@pytest.mark.parametrize("rows", [500_000, 0])
def test_rules_equal_brute_force(spark, rows):
    rng = random.Random(4)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "net", "q.net", "A.Com", "", "ba.com", "ünï.org"]
    paths = ["", "/", "/en/", "/en/x", "/e", "/EN/", "/en//", "/%2f?q=/en/", "#/en/", "?x"]
    urls = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http://", "x://y://", "://", "", "HTTP://") for _ in range(60)] + [None, ""]
    rules = [("a.com", "/", "allow"), ("b.a.com", "/en/", "block"), ("a.com", "/en/", "allow"), ("net", "/", "block"), ("net", "/e", "allow"),
             ("a.com", "/en/", "block"), ("", "/", "block"), (None, "/", "block"), ("com", None, "block")]
    rules += [(f"listed{k}.org", f"/{k}", "block") for k in range(3000)]
    urls += [f"http://www.listed{k}.org/{k % 7}{k}" for k in range(200)] + [f"http://listed{k}.org/{k}0" for k in range(200)]
    pages = spark.createDataFrame([(k, u, "h", "z") for k, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES), broadcast_rows=rows).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: brute(u, rules) for k, u in enumerate(urls)}
    assert len(got) == len(urls)


def test_empty_list_and_table(spark):
    none, pages = spark.createDataFrame([], RULES), spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, none, default="block").collect()] == [(1, "a.b", "/c", None, "block")]
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


def test_oracle_agrees(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = duckdb.sql(queries.ORACLES["op8_url_filter"]).fetchall()
    got = queries.REGISTRY["op8_url_filter"](spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_python_in_the_plan(spark, capsys):
    queries.REGISTRY["op8_url_filter"](spark, "/root/testdata/sf0.001").explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Pandas", "Arrow"))
