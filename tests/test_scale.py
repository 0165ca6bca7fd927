"""Scale properties: hot keys are pre-aggregated before any shuffle, dense
numbering needs no single-partition window, results stay whole."""

from pyspark.sql import functions as F

from cuelake.operators import census as CS
from cuelake.operators import url_scan as US
from cuelake.plans.indexing import dense_index


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_signature_is_preaggregated(spark):
    n = 3000
    rows = spark.range(n).select(
        F.concat(F.lit("d/f"), (F.col("id") % 7).cast("string"), F.lit(".csv")).alias("file"),
        F.lit("f.csv").alias("file_name"),
        F.col("id").alias("row_idx"),
        # a third of all rows share one signature
        F.when(F.col("id") % 3 == 0, F.lit("SAME subject")).otherwise(F.concat(F.lit("s"), F.col("id").cast("string")))
        .alias("subject"),
        F.lit("x.com").alias("from_domain"),
        F.lit("Mon, 3 Mar 2010").alias("date"),
        F.when(F.col("id") % 3 == 0, F.lit("same body text")).otherwise(F.concat(F.lit("body "), F.col("id").cast("string")))
        .alias("body_snippet"),
    ).repartition(6)
    signed = CS.signed_rows(rows)
    sigs = CS.signatures(signed)
    top = CS.top_duplicates(signed, sigs).collect()
    assert top[0]["count"] == n // 3 and len(top) == 1
    assert top[0]["examples"].count(" | ") == 2
    plan = _plan(sigs)
    assert "partial_count" in plan and plan.index("partial_count") > plan.index("Exchange hashpartitioning")
    ov = CS.overall(signed).first()
    assert ov["unique_emails"] == n - n // 3 + 1 and ov["estimated_duplicates"] == n // 3 - 1


def test_hot_apex_dedupe(spark):
    urls = spark.range(2000).select(
        F.col("id").alias("row_idx"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://a"), F.col("id").cast("string"), F.lit(".hot.com/x")))
        .otherwise(F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".org"))).alias("url"),
    ).repartition(5)
    d = US.dedupe_by_apex(urls)
    got = {r["row_idx"] for r in d.collect()}
    assert 0 in got and not any(i % 3 == 0 and i > 0 for i in got)
    assert "partial_min" in _plan(d)


def test_dense_index_many_partitions(spark):
    df = spark.range(0, 5000, 3).select(F.col("id").alias("row_idx")).repartition(9)
    out = dense_index(df, "row_idx", "n")
    rows = sorted((r["row_idx"], r["n"]) for r in out.collect())
    assert [n for _, n in rows] == list(range(1, len(rows) + 1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_html_is_in_no_aggregate(spark):
    """Pages are picked by a window limit on both sides of one shuffle; HTML moves once."""
    from cuelake.plans import derived as D

    pages = D.site_pages(spark, "/root/testdata/sf0.001")
    urls = US.url_table(D.url_list(spark, "/root/testdata/sf0.001"), "url", "url_id")
    plan = _plan(US.attach_pages(urls, pages.select("url", "html"), "get"))
    final = plan.split("== Initial Plan ==")[0]
    assert "WindowGroupLimit" in final and not [
        line for line in final.split("\n") if "Aggregate" in line and "html" in line]


def test_page_ties_and_large_samples(spark):
    crawl = spark.createDataFrame([("http://a.com", "<title>b</title>", "http://z.com"), ("http://a.com", "<title>a</title>", "http://y.com"),
                                   ("http://a.com", "<title>a</title>", "http://y.com"), ("http://other.com", None, "x")],
                                  "url string, html string, final_url string")
    urls = spark.createDataFrame([(1, "http://a.com"), (2, "http://none.com"), (3, "http://a.com")], "row_idx bigint, url string")
    for limit in (None, 5, US.SMALL_SAMPLE + 1):
        got = US.attach_pages(urls, crawl, "get", limit).orderBy("row_idx").collect()
        assert [r["final_url"] for r in got] == ["http://y.com", "", "http://y.com"]
        assert got[0]["page_text"].startswith("a") and "not in stored crawl" in got[1]["fetch_error"]
    many = spark.range(20_000).select(F.col("id").alias("row_idx"), F.concat(F.lit("u"), "id").alias("url"))
    rows = US.sample_urls(many, 15_000).collect()
    assert sorted(r["n"] for r in rows) == list(range(1, 15_001))
    few = US.sample_urls(many, 100).collect()
    assert {(r["n"], r["url"]) for r in few} <= {(r["n"], r["url"]) for r in rows}


def test_registered_reports_hash_by_a_numeric_order(spark):
    """The signature aggregate of the two example reports neither sorts rows nor carries a struct."""
    from cuelake.plans.catalog import QUERIES

    for name in ("census_top_duplicates", "census_unique_examples"):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        lines = [p for p in plan.splitlines() if "min(order_key" in p]
        assert lines and all("HashAggregate" in p for p in lines), name
        assert not any("SortAggregate" in p and "first_seen" in p and "min(" in p for p in plan.splitlines()), name
