"""S1-S4, S14, S15 on CSV files written by the test (FIXTURES.md cases)."""

import csv
import io
import os
import tempfile

from pyspark.sql import functions as F

from cuelake.operators.mail import finish_scan
from cuelake.sources import csv_corpus as C

FILES = {
    "a/mail-2019.csv": b'subject,from,date,body_snippet,sanitized_body\r\n'
                       b'"Verify ""now""",x@y.com,"Mon, 3 Mar 2008","line1\r\nline2 account",<p>PayPal</p>\r\n'
                       b'\r\n'
                       b'short row\r\n'
                       b'RE: hi,a@b.co,,body,,extra,cells\r\n',
    "b/Other.CSV": '﻿ Subject ,Text\nSECURITY ALERT,login now\n'.encode(),
    "b/bytes.csv": b'subj,payload\nbad \xff\xfe bytes,verify \xff account\n',
    "c/header_only.csv": b'subject,body\n',
    "c/fallback.csv": b'id,date,notes,extra\n1,2010,admin notice,urgent\n',
    "c/empty.csv": b'',
    "c/skip.txt": b'subject\nignored\n',
}


def write_tree():
    root = tempfile.mkdtemp(prefix="cuelake-csv-")
    for rel, data in FILES.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)
    return root


def python_rows(root):
    """Rows as Python's csv.DictReader gives them (utf-8, errors ignored)."""
    out = {}
    for rel, data in FILES.items():
        if not rel.lower().endswith(".csv"):
            continue
        rdr = csv.DictReader(io.StringIO(data.decode("utf-8", errors="ignore").lstrip("﻿"), newline=""))
        out[rel] = [dict(r) for r in rdr]
    return out


def test_corpus_rows_and_roles(spark):
    root = write_tree()
    rows, headers = C.read_corpus(spark, root)
    got = rows.select(F.regexp_extract("file", r"[^/]+/[^/]+$", 0).alias("rel"), "row_idx", "header", "vals").collect()
    by = {}
    for r in got:
        by.setdefault(r["rel"], []).append(r)
    expect = python_rows(root)
    for rel, prow in expect.items():
        srows = sorted(by.get(rel, []), key=lambda r: r["row_idx"])
        assert [r["row_idx"] for r in srows] == list(range(1, len(prow) + 1)), rel
        for s, p in zip(srows, prow):
            hdr = [h for h in s["header"]]
            assert hdr == [k for k in p if k is not None], rel
            for i, k in enumerate(hdr):
                pv = p.get(k) or ""
                sv = s["vals"][i] or ""
                assert sv.replace("\r\n", "\n") == pv.replace("\r\n", "\n"), (rel, k)
    frame = C.scan_frame(rows)
    scan = {r["path"].split(root)[-1]: r for r in finish_scan(frame).collect()}
    r = scan["/a/mail-2019.csv#row=1"]
    assert r["subject"] == 'Verify "now"' and r["date"] == "Mon, 3 Mar 2008"
    assert r["sum_brand_trust"] == 1 and r["sum_consistency_commitment"] == 1
    assert scan["/a/mail-2019.csv#row=2"]["subject"] == "short row"
    o = scan["/b/Other.CSV#row=1"]           # " Subject " is the subject role (BOM removed)
    assert o["subject"] == "SECURITY ALERT" and o["sum_fear_loss"] == 0   # subject is metadata only
    assert o["sum_urgency"] == 1 and o["sum_consistency_commitment"] == 1
    assert scan["/b/bytes.csv#row=1"]["subject"] == "bad  bytes"
    fb = scan["/c/fallback.csv#row=1"]           # no body/html column: notes+extra are body
    assert fb["sum_authority"] == 2 and fb["sum_urgency"] == 1
    assert not any("skip.txt" in k or "header_only" in k for k in scan)
    listing = C.list_files(spark, root).collect()
    assert sorted(os.path.basename(x["file"]) for x in listing) == sorted(
        ["mail-2019.csv", "Other.CSV", "bytes.csv", "header_only.csv", "fallback.csv", "empty.csv"])
    assert C.unreadable_files(spark, root, headers).count() == 0
    census_listing = C.list_files(spark, root, C.CENSUS_GLOB).collect()
    assert "Other.CSV" not in [os.path.basename(x["file"]) for x in census_listing]


def test_missing_root(spark):
    rows = C.corpus_rows(spark, "/nonexistent/cuelake/root")
    assert rows.count() == 0
    assert finish_scan(C.scan_frame(rows)).count() == 0
    assert C.list_files(spark, "/nonexistent/cuelake/root").count() == 0


def test_wide_headers_lose_no_column(spark, tmp_path):
    """A 400-column header, and one that goes on over three lines."""
    names = [f"c{i}" for i in range(398)] + ["subject", "body"]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + "," * 398 + "hello,verify account\n")
    r = C.scan_frame(C.corpus_rows(spark, str(tmp_path))).collect()
    assert [(x["subject_raw"], x["raw_text"]) for x in r] == [("hello", "verify account")]
    (tmp_path / "lines.csv").write_text('"a\nb","c\nd",' + ",".join(names[:50]) + ",subject,body\n" + "," * 52 + "hi,login now\n")
    assert C.header_width(spark, str(tmp_path), C.SCAN_GLOB) >= 400
    (tmp_path / "wide.csv").unlink()
    r = C.scan_frame(C.corpus_rows(spark, str(tmp_path))).collect()
    assert [(x["subject_raw"], x["raw_text"]) for x in r] == [("hi", "login now")]


def test_repeated_headers_take_the_last_value(spark, tmp_path):
    """As a dict per record: of equal names the last column, a short row leaves it empty."""
    (tmp_path / "m.csv").write_text("subject,body,subject,Body\nfirst,one,last,two\nfirst,one\n")
    r = C.scan_frame(C.corpus_rows(spark, str(tmp_path))).orderBy("path").collect()
    assert [(x["subject_raw"], x["raw_text"]) for x in r] == [("last", "one\ntwo"), ("", "one")]


def test_url_list_with_repeated_headers(spark, tmp_path):
    from cuelake.plans.jobs import read_url_list

    for header, want in (("url,URL", "http://a.com"), ("url,url", "http://b.com"), ("x, Url ", "http://b.com"), ("x,y", None)):
        path = tmp_path / f"{abs(hash(header))}.csv"
        path.write_text(f"{header}\na.com,b.com\n")
        got = read_url_list(spark, str(path))
        assert (got and [r["url"] for r in got.collect()]) == (want and [want])


def test_a_bad_record_is_an_error_row_and_the_rest_goes_on(spark, tmp_path):
    """A field over the limit, read by a role or not, marks its record only; exactly the limit is no error."""
    from cuelake.plans import jobs as J

    box = tmp_path / "in"
    box.mkdir()
    (box / "a.csv").write_text("subject,body,note\none,verify now," + "n" * 41 + "\ntwo," + "v" * 41 + ",n\nthree," + "v" * 40 + ",n\n")
    (box / "b.csv").write_text("subject,body\nfour,verify now\n")
    rows = C.corpus_rows(spark, str(box))
    got = {r["path"].split("/")[-1]: r for r in finish_scan(C.scan_frame(rows, 40)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "a.csv#row=1": "error", "a.csv#row=2": "error", "a.csv#row=3": "ok", "b.csv#row=1": "ok"}
    bad = got["a.csv#row=1"]
    assert bad["error"] == "field larger than field limit (40)" and bad["subject"] is None and bad["sum_urgency"] is None
    assert got["a.csv#row=3"]["text_len"] == 40 and got["b.csv#row=1"]["error"] == ""
    cfg = J.RunConfig(out_root=str(tmp_path / "out"), emails_root=str(box), run_id="20250101_000000", field_limit=40)
    J.email_job(spark, cfg)
    J.summary_job(spark, cfg)
    assert cfg.metrics["emails"] == {"rows": 4, "errors": 2}
    flat = spark.read.option("header", "true").csv(str(tmp_path / "out" / "emails_csv")).collect()
    assert sorted((r["subject"] or "", r["error"] or "") for r in flat) == [
        ("", bad["error"]), ("", bad["error"]), ("four", ""), ("three", "")]
    total = [r for r in spark.read.option("header", "true").csv(str(tmp_path / "out" / "summary_csv")).collect() if r["source"] == "emails"]
    assert (total[0]["n_items"], total[0]["errors"], total[0]["sum_urgency"]) == ("4", "2", "1")
    cfg = J.RunConfig(out_root=str(tmp_path / "all"), emails_root=str(box), run_id="20250101_000000", field_limit=None)
    assert {r["status"] for r in J.email_job(spark, cfg).collect()} == {"ok"}
