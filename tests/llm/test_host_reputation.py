"""Host reputation: URL parts, rules, shrinkage, odd rows; the SQL twin on a fixture."""

import duckdb
from pyspark.sql import functions as F

from corpusbank.llm import host_reputation as hr

URLS = ["http://A.Example.NET/en/x?q#f", "https://sub.example.com/de/1", "http://x.org/fr/", "http://x.org",
        "no scheme", None, "", "http://net/", "ftp://notnet/a", "http://a.net?x=/en/", "x://y://z.net/p",
        "http://example.net/en", "http://example.net/en/", "HTTP://ÄB.org/FR/é#x", "http://", "a://h.net/"]


def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    rows += [(100 + i, f"http://bad.spam.com/{i}") for i in range(60)]
    rows += [(200 + i, f"http://good{i % 7}.fine.com/{i}") for i in range(140)]
    rows += [(400 + i, f"http://new{i}.spam.com/") for i in range(5)]
    rows += [(3, URLS[3]), (None, URLS[0])]
    return spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))


def labels(spark):
    rows = [(100 + i, int(i < 2), 0) for i in range(50)] + [(200 + i, int(i % 9 > 0), 0) for i in range(130)]
    return spark.createDataFrame(rows + [(100, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in hr.judge_urls(pages(spark), spark.createDataFrame(
        [], "page_id long, bad int")).collect() if r.page_id is not None}
    parts = {i: (got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(URLS))}
    assert parts[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert parts[1] == ("sub.example.com", "/de/1", "example.com/de/", "block")
    assert parts[2] == ("x.org", "/fr/", "org/fr/", "allow") and parts[3] == ("x.org", "", None, "allow")
    assert all(parts[i] == ("", "", None, "allow") for i in (4, 5, 6, 14))
    assert parts[7] == ("net", "/", "net/", "block") and parts[8] == ("notnet", "/a", None, "allow")
    assert parts[9] == ("a.net", "", None, "allow") and parts[10][:2] == ("y:", "//z.net/p")
    assert parts[11][2:] == ("net/", "block") and parts[12][2:] == ("example.net/en/", "allow")
    assert parts[13] == ("Äb.org", "/FR/é", None, "allow")


def test_shrinkage(spark):
    outcomes = labels(spark).filter("quality IS NOT NULL").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    rows = hr.judge_urls(pages(spark), outcomes).collect()
    assert len(rows) == len(URLS) + 207
    got = {r.page_id: r for r in rows}
    assert got[100].verdict == "block" and got[100].bound > 0.8
    assert got[201].verdict == "allow" and 0.05 < got[201].rate < 0.2
    # A new host is judged by its domain, an unknown domain by its suffix.
    assert got[400].rate > got[3].rate and got[400].verdict in ("allow", "block")
    assert got[400].bound < got[100].bound


def test_sql_twin(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(map(tuple, con.sql(hr.SQL).fetchall()), key=key)
    got = sorted(map(tuple, hr.op4_host_reputation(spark, str(tmp_path)).collect()), key=key)
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    assert hr.judge_urls(pages(spark).limit(0), none).count() == 0
