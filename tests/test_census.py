"""Census reports against results worked by hand on a small fixture."""

from cuelake.operators import census as CS

ROWS = [  # file, row_idx, subject, from_domain, date, body_snippet, sanitized_body
    ("d/a-2010.csv", 1, "RE: Win now", " X.com ", "Mon, 3 Mar 2008", "Claim your prize", None),
    ("d/a-2010.csv", 2, "win now", "x.com", "", "claim your PRIZE!", ""),
    ("d/a-2010.csv", 3, "", "", "1999", "   ", "<br/>"),
    ("d/a-2010.csv", 4, "  ", "", "", " ", None),
    ("d/b_2012.csv", 1, "Fwd: win now", "x.com", "2031", "claim your prize", None),
    ("d/b_2012.csv", 2, "hello", "y.org", "2015-01-01", "", "<p>Reset your password</p><script>x</script>"),
    ("d/b_2012.csv", 3, "hello", "y.org", "2016", "ignored body", "<p>reset your password</p>"),
    ("d/c.csv", 1, "abc", "", "", "tiny", None),
]


# Worked by hand from ROWS. Four signatures: "win now" of x.com (rows 1, 2 and 5; first
# seen 2008), the page without text (row 3; 2010 by its file name), "hello" of y.org
# (rows 6 and 7; 2015) and "abc", whose body is too short for a hash (row 8; no year).
# Row 4 is blank throughout.
PER_YEAR = {"2008": (1, 1), "2010": (2, 1), "2015": (1, 1), "2016": (1, 0)}     # year: rows, signatures
OVERALL = {"rows_total": 8, "email_like_rows": 7, "unique_emails": 4, "estimated_duplicates": 3, "date_valid": 3,
           "fallback_file": 2, "unknown": 2, "date_out_of_range": 2}


def test_census_matches_hand_worked_reports(spark):
    df = spark.createDataFrame(
        [(f, f.split("/")[-1], i, s, fd, d, b, h) for f, i, s, fd, d, b, h in ROWS],
        "file string, file_name string, row_idx long, subject string, from_domain string, date string, "
        "body_snippet string, sanitized_body string")
    rep = CS.census(df)
    ov = rep.overall.first()
    assert {k: ov[k] for k in OVERALL} == OVERALL
    assert {r["year"]: (r["email_like_rows"], r["unique_emails"]) for r in rep.per_year.collect()} == PER_YEAR
    top = rep.top_duplicates.collect()
    assert [(r["count"], r["normalized_subject"]) for r in top] == [(3, "win now"), (2, "hello")]
    assert top[0]["examples"] == "a-2010.csv :: RE: Win now | a-2010.csv :: win now | b_2012.csv :: Fwd: win now"
    assert rep.unique_examples.count() == 4
    pf = {r["file"]: r for r in rep.per_file.collect()}
    assert pf["d/a-2010.csv"]["rows_total"] == 4 and pf["d/a-2010.csv"]["email_like_rows"] == 3
    assert pf["d/a-2010.csv"]["unique_signatures_in_file"] == 2


def test_examples_plan_uses_group_limit(spark):
    df = spark.createDataFrame([(f, f, i, s, fd, d, b, h) for f, i, s, fd, d, b, h in ROWS],
                               "file string, file_name string, row_idx long, subject string, from_domain string, "
                               "date string, body_snippet string, sanitized_body string")
    rep = CS.census(df)
    rep.top_duplicates.collect()
    plan = rep.top_duplicates._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_numeric_scan_order_gives_same_reports(spark):
    df = spark.createDataFrame([(f, f.split("/")[-1], i, s, fd, d, b, h) for f, i, s, fd, d, b, h in ROWS],
                               "file string, file_name string, row_idx long, subject string, from_domain string, "
                               "date string, body_snippet string, sanitized_body string")
    a = CS.census(df)
    b = CS.census(df, numeric_order=True)
    for name in ("top_duplicates", "unique_examples", "per_year", "per_file", "overall"):
        x, y = getattr(a, name), getattr(b, name)
        assert x.collect() == y.collect() if name in ("top_duplicates", "unique_examples") else \
            sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())), name
    sigs = CS.signatures(CS.with_scan_order(CS.signed_rows(df)))
    sigs.collect()
    plan = sigs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortAggregate" not in plan and "HashAggregate" in plan
