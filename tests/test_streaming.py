"""C6 on a streaming DataFrame: the scan is pure Column expressions, so the
same operator runs incrementally (parquet file source -> memory sink)."""

import os
import tempfile

from conftest import SF_SMALL
from cuelake.operators.mail import mail_scan
from cuelake.plans import derived as D


def test_mail_scan_streams(spark):
    src = os.path.join(tempfile.mkdtemp(prefix="cuelake-stream-"), "in")
    emails = D.emails(spark, SF_SMALL)
    cols = ["subject", "from", "from_domain", "to", "date", "body_snippet", "sanitized_body"]
    batch_in = emails.selectExpr("concat(file, '#row=', cast(row_idx as string)) AS path", *[f"`{c}`" for c in cols])
    batch_in.write.parquet(src)
    stream_in = spark.readStream.schema(batch_in.schema).parquet(src)
    q = (mail_scan(stream_in).writeStream.format("memory").queryName("mail_scan_stream")
         .outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT * FROM mail_scan_stream")
    want = mail_scan(spark.read.parquet(src))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_screenshot_stream_helper(spark):
    import tempfile

    from cuelake.streaming.scan import read_stream, start_scan

    base = tempfile.mkdtemp(prefix="cuelake-shots-")
    shots = D.screenshots(spark, SF_SMALL)
    shots.write.parquet(f"{base}/in")
    src = read_stream(spark, f"{base}/in", shots.schema, max_files_per_trigger=1)
    q = start_scan(spark, src, "screenshots", f"{base}/out", "shots_stream_test")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(f"{base}/out")
    assert got.count() == shots.count()
    assert got.where("status = 'error'").count() == shots.where("error IS NOT NULL").count()


def test_a_restarted_stream_repeats_no_row(spark, tmp_path):
    from cuelake.streaming.scan import read_stream, run_available

    shots = D.screenshots(spark, SF_SMALL)
    for part in range(3):
        shots.where(f"length(path) % 3 = {part}").write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):      # the second run finds nothing new
            run_available(spark, read_stream(spark, f"{tmp_path}/in", shots.schema), "screenshots", f"{tmp_path}/out", f"{tmp_path}/ckpt")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == shots.count() and got.select("path").distinct().count() == shots.count()
