"""Golden rows for the text Column functions (FIXTURES.md)."""

import hashlib

from pyspark.sql import functions as F

from conftest import one_col
from cuelake.functions import text as T
from cuelake.operators.mail import decode_mime


def run(spark, fn, values):
    return [r[0] for r in one_col(spark, values).select(fn(F.col("t"))).collect()]


def test_normalize_subject(spark):
    got = run(spark, T.normalize_subject, ["  RE: Fwd: Verify   now ", "FWD :x", "reply: a", None])
    assert got == ["fwd: verify now", "x", "reply: a", ""]


def test_html_to_text(spark):
    got = run(spark, T.html_to_text, [
        "<p>Verify<br>your&nbsp;account</p><script>var t='</p>';</script><STYLE>a</style >x",
        "a < b and c > d",
        "<!-- a > b --><i>z",
        "<script>never closed",
        None,
    ])
    assert got == ["Verify your&nbsp;account x", "a d", "b --> z", "never closed", ""]


def test_deobfuscate_and_heuristics(spark):
    df = one_col(spark, ["PAY NOW!!! £5 $6 https://www.x.com A1B AB_C", "hxxps://evil[.]com www.a.b HXXP://q"])
    h = T.heuristics(F.col("t"))
    raw = [tuple(r) for r in df.select(*[h[k] for k in ("all_caps_words", "exclamations", "money_symbols", "links")]).collect()]
    assert raw == [(2, 1, 2, 2), (1, 0, 0, 1)]
    assert run(spark, T.deobfuscate, ["hxxps://evil[.]com x HXXP://a[:]b ahxxp://c"]) == [
        "https://evil.com x http://a[:]b ahxxp://c"
    ]


def test_redact(spark):
    assert run(spark, T.redact_emails, ["Bob <bob.x+1@mail.example.co.uk>, a@b", None]) == [
        "Bob <[redacted-email]>, a@b", ""
    ]


def test_years(spark):
    vals = ["Mon, 3 Mar 2008 10:00", "1999-01-01 then 2010", "phishing-2019.csv", "phishing_2019.csv",
            "20051114.csv", "2031"]
    assert run(spark, T.first_year, vals) == ["2008", "1999", "2019", "", "", "2031"]
    assert run(spark, T.extract_year, vals) == ["2008", "", "2019", "", "", ""]


def test_guess_year_audit(spark):
    df = spark.createDataFrame(
        [("Mon, 3 Mar 2008", "a.csv"), ("1999-01-01", "x-2012.csv"), ("", "y_2012.csv"), ("2031", "z.csv")],
        "date string, f string",
    )
    y = T.guess_year(F.col("date"), F.col("f"))
    rows = [tuple(r) for r in df.select(y["year"], y["year_source"], y["date_out_of_range"]).collect()]
    assert rows == [("2008", "date_valid", False), ("2012", "fallback_file", True),
                    ("", "unknown", False), ("", "unknown", True)]


def test_signature_hash(spark):
    got = run(spark, lambda c: F.sha1(T.normalize_text(c).cast("binary")), ["Verify your account!"])
    assert got[0].startswith("2b7f94999f")
    assert got[0] == hashlib.sha1(b"verify your account").hexdigest()


def test_mime_subject(spark):
    got = run(spark, decode_mime, ["=?ISO-8859-1?b?VmVyaWZ5IOk=?= now", "plain  subject", "=?bad"])
    assert got == ["Verify é now", "plain  subject", "=?bad"]


def test_tolerant_int(spark):
    vals = ["3", "3.0", " 3.99 ", "-2.5", "1_000", "1e3", "abc", "", None, "nan", "inf", "1__0", "1d", ".5"]
    assert run(spark, T.tolerant_int, vals) == [3, 3, 3, -2, 1000, 1000, 0, 0, 0, 0, 0, 0, 0, 0]


def test_first_present(spark):
    df = spark.createDataFrame([("  ", None, "b"), ("a", "x", "y"), (None, "\t", None)], "c1 string, c2 string, c3 string")
    got = [r[0] for r in df.select(T.first_present(["c1", "c2", "c3"])).collect()]
    assert got == ["b", "a", ""]
