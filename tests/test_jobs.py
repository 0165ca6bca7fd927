"""R1 end to end on small files written by the test, plus the census job."""

import os
import tempfile

from pyspark.sql import functions as F

from cuelake.plans import jobs as J
from test_csv_corpus import write_tree


def test_run_all_and_census(spark):
    root = tempfile.mkdtemp(prefix="cuelake-run-")
    emails = write_tree()
    shots = os.path.join(root, "shots.parquet")
    spark.createDataFrame(
        [("s1.png", "URGENT: verify now!!", None), ("s2.png", None, "OSError('bad image')")],
        "path string, ocr_text string, error string").write.parquet(shots)
    urls_csv = os.path.join(root, "phish.csv")
    with open(urls_csv, "w") as f:
        f.write(" URL ,id\nhttp://secure-login.paypal.com/verify?x=1,1\nwww.foo.com/login,2\n"
                "http://a.paypal.com/x,3\n  ,4\nhttp://[bad/x,5\n")
    crawl = os.path.join(root, "crawl.parquet")
    spark.createDataFrame(
        [("http://secure-login.paypal.com/verify?x=1", "<title>Sign in</title><a href=x>Verify <b>now</b></a>")],
        "url string, html string").write.parquet(crawl)
    out = os.path.join(root, "out")
    cfg = J.RunConfig(out_root=out, emails_root=emails, screenshots=shots, urls_csv=urls_csv, crawl=crawl,
                      run_id="20250101_000000", url_limit=50)
    done = J.run_all(spark, cfg)
    assert done == {"emails": True, "images": True, "urls": True, "summary": True}
    s = {r["source"]: r for r in spark.read.option("header", "true").csv(os.path.join(out, "summary_csv")).collect()}
    assert set(s) == {"images", "emails", "urls", "TOTAL"}
    assert int(s["images"]["n_items"]) == 2 and int(s["images"]["errors"]) == 1
    assert int(s["urls"]["n_items"]) == 3          # apex dedupe drops a.paypal.com; blank dropped
    assert int(s["TOTAL"]["n_items"]) == sum(int(s[k]["n_items"]) for k in ("images", "emails", "urls"))
    assert s["TOTAL"]["timestamp"] == "—"
    assert list(s) == ["images", "emails", "urls", "TOTAL"]          # the order of the file
    nested = spark.read.json(os.path.join(out, "summary_json")).first()
    assert [x["source"] for x in nested["sources"]] == ["images", "emails", "urls"]
    assert nested["overall"]["n_items"] == int(s["TOTAL"]["n_items"])
    assert nested["overall"]["totals"]["urgency"] == int(s["TOTAL"]["sum_urgency"])
    assert "to" not in spark.read.option("header", "true").csv(os.path.join(out, "emails_csv")).columns
    js = spark.read.json(os.path.join(out, "emails_json"))
    assert set(js.schema["cues_total"].dataType.names) == {
        "authority", "urgency", "scarcity", "fear_loss", "consistency_commitment", "similarity_socialproof",
        "reward_reciprocity", "brand_trust"}
    assert set(js.schema["meta"].dataType.names) == {"subject", "from", "to", "date"}
    assert set(js.schema["extras"].dataType.names) == {"all_caps_words", "exclamations", "money_symbols", "links"}
    used = spark.read.text(os.path.join(out, "urls_urls_used")).collect()
    assert len(used) == 3
    u = spark.read.option("header", "true").csv(os.path.join(out, "urls_csv")).collect()
    first = [r for r in u if r["url_masked"] == "paypal.com:/verify"][0]
    assert first["final_url_masked"] == "paypal.com:/verify" and first["error"] in (None, "")
    assert int(first["sum_consistency_commitment"]) >= 2
    rep = J.census_job(spark, emails, out, "20250101_000000")
    ov = rep.overall.first()
    assert ov["files_scanned"] == 5 and ov["rows_total"] == 5   # a zero-byte file counts; the census glob is case-sensitive
    assert ov["date_valid"] + ov["fallback_file"] + ov["unknown"] == ov["email_like_rows"]
    assert ov["unique_emails"] <= ov["email_like_rows"]
    pf = {os.path.basename(r["file"]): r for r in rep.per_file.collect()}
    assert pf["header_only.csv"]["rows_total"] == 0 and pf["empty.csv"]["rows_total"] == 0
    record = spark.read.json(os.path.join(out, "census_overall")).first()
    assert record["input_dir"] == emails and record["output_dir"] == out
    assert all(x["file"].endswith(f"{x['source']}_csv/run_id=20250101_000000") for x in nested["sources"])
    assert cfg.metrics["images"] == {"rows": 2, "errors": 1} and cfg.metrics["emails"]["rows"] == int(s["emails"]["n_items"])


def test_only_the_latest_run_is_read(spark, tmp_path):
    from cuelake.sources import sinks as K

    for run, n in (("20250101_000000", 3), ("20250102_000000", 2), ("20241231_235959", 9)):
        K.flat_csv(spark.range(n).selectExpr("id AS sum_urgency", "'' AS error"), K.run_path(str(tmp_path), "emails", run))
    latest = K.read_latest(spark, str(tmp_path), "emails")
    assert latest.count() == 2 and {r["run_id"] for r in latest.collect()} == {"20250102_000000"}
    assert all("run_id=20250102_000000" in f for f in latest.inputFiles())
    assert K.read_latest(spark, str(tmp_path), "urls") is None


def test_image_listing_marks_missing_text(spark):
    from cuelake.sources.tables import list_images, screenshot_text

    root = tempfile.mkdtemp(prefix="cuelake-img-")
    for name in ["a.png", "b.JPG", "c.webp", "d.txt", "sub/e.TiFf"]:
        p = os.path.join(root, "imgs", name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(b"\x89PNG")
    listed = sorted(os.path.basename(r["path"]) for r in list_images(spark, os.path.join(root, "imgs")).collect())
    assert listed == ["a.png", "b.JPG", "c.webp", "e.TiFf"]
    texts = os.path.join(root, "ocr.parquet")
    first = list_images(spark, os.path.join(root, "imgs")).where("path LIKE '%a.png'").select("path")
    first.selectExpr("path", "'Verify now' AS ocr_text", "CAST(NULL AS STRING) AS error").write.parquet(texts)
    df = screenshot_text(spark, texts, os.path.join(root, "imgs"))
    rows = {os.path.basename(r["path"]): r for r in df.collect()}
    assert rows["a.png"]["ocr_text"] == "Verify now" and rows["a.png"]["error"] is None
    assert rows["e.TiFf"]["error"] == "no extracted text" and len(rows) == 4


def test_overall_record_has_year_maps(spark):
    from cuelake.operators import census as CS
    from test_census import ROWS

    df = spark.createDataFrame(
        [(f, f.split("/")[-1], i, s, fd, d, b, h) for f, i, s, fd, d, b, h in ROWS],
        "file string, file_name string, row_idx long, subject string, from_domain string, date string, "
        "body_snippet string, sanitized_body string")
    rep = CS.census(df)
    rec = CS.overall_record(rep.overall, rep.per_year).first()
    assert rec["years"] == sorted(rec["per_year_raw"].keys() | rec["per_year_unique"].keys())
    assert rec["year_window"]["min"] == 2005 and rec["year_window"]["max"] == 2024
    assert sum(rec["year_audit"][k] for k in ("date_valid", "fallback_file", "unknown")) == rec["email_like_rows"]


def test_missing_inputs_skip_their_jobs(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="cuelake-skip-"), "out")
    cfg = J.RunConfig(out_root=out, emails_root=write_tree(), screenshots="/nonexistent/shots.parquet",
                      urls_csv=None, crawl=None, run_id="20250202_000000")
    done = J.run_all(spark, cfg)
    assert done == {"emails": True, "images": False, "urls": False, "summary": True}
    s = {r["source"] for r in spark.read.option("header", "true").csv(os.path.join(out, "summary_csv")).collect()}
    assert s == {"emails", "TOTAL"}
    assert J.census_job(spark, "/nonexistent/mail", out) is None
