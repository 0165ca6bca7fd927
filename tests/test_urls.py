"""U1-U7 golden rows (FIXTURES.md) and U2 against Python's urlparse."""

from urllib.parse import urlparse

from pyspark.sql import functions as F

from conftest import one_col
from cuelake.functions import urls as U
from cuelake.operators import url_scan as US

FEATURES = [
    ("http://secure-login.paypal.com/verify?x=1",
     ("secure-login.paypal.com", "paypal.com", 0, 0, 0, 0, 1, 1, 0.0, 41, 7, 3, 2, 1), "paypal.com:/verify"),
    ("www.foo.com/login", ("", "", 0, 0, 0, 0, 0, 0, 0.0, 17, 17, 0, 0, 1), ":/login"),
    ("http://1.2.3.4/Login/x;p?q=verify", ("1.2.3.4", "3.4", 0, 1, 0, 0, 2, 0, 1.0, 33, 8, 8, 0, 1), "3.4:/Login"),
    ("https://xn--pypal-4ve.example.co.uk:8080/",
     ("xn--pypal-4ve.example.co.uk", "co.uk", 1, 0, 1, 0, 2, 3, 0.048, 41, 1, 0, 0, 0), "co.uk:/"),
    ("http://a@b.example.com", ("b.example.com", "example.com", 0, 0, 0, 1, 1, 0, 0.0, 22, 0, 0, 0, 0), "example.com:/"),
]


def test_feature_golden_rows(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(FEATURES)], "row_idx long, url string")
    got = US.with_features(df, mask=True).orderBy("row_idx").collect()
    for (u, want, mask), r in zip(FEATURES, got):
        assert tuple(r[k] for k in US.FEATURES) == want, u
        assert r["url_masked"] == mask and r["parse_error"] is None


def test_normalize_url(spark):
    vals = ["  example.com/a ", "HTTPS://X.Y", "www.q.com", "", None, "ftp://x"]
    got = [r[0] for r in one_col(spark, vals).select(U.normalize_url(F.col("t"))).collect()]
    assert got == ["http://example.com/a", "HTTPS://X.Y", "www.q.com", "", "", "http://ftp://x"]


AWKWARD = ["http://ftp://x", "http://a_b.example.com:80/p;x=1?q#f", "http://u:p@h@h2.com/", "http://[::1]:8/a",
           "http://EXAMPLE.com./", "http://h.com/a|b c?x=1;y#z", "http://h.com?x#y?z", "http://h.com/a;b/c;d?e",
           "HTTPS://X.Y", "http://", "http:///p", "http://h:/p", "www.a.com/x;y", "http://h.com/\tx\ny",
           "http://[fe80::1]/", "https://a.b/c%20d?e=%3F", "http://x[::1]/", "http://[v1.x]/"]


def test_parts_match_urlparse(spark):
    df = one_col(spark, AWKWARD)
    p = U.url_parts(F.col("t"))
    rows = df.select("t", *[p[k].alias(k) for k in ("scheme", "path", "query", "host", "error")]).collect()
    for r in rows:
        py = urlparse(r["t"])
        assert r["error"] is None, r["t"]
        assert (r["scheme"], r["path"], r["query"], r["host"]) == (py.scheme, py.path, py.query, py.hostname or ""), r["t"]


def test_bad_brackets_are_error_rows(spark):
    bad = ["http://[bad/x", "http://a]b/", "http://[zz]/", "http://[1.2.3.4]/"]
    df = one_col(spark, bad)
    p = U.url_parts(F.col("t"))
    assert all(r[0] is not None for r in df.select(p["error"]).collect())
    for u in bad:
        try:
            urlparse(u).hostname
        except ValueError:
            continue
        raise AssertionError(f"Python accepted {u}")


def test_dedupe_and_sample(spark):
    rows = [(i, u) for i, u in enumerate(["http://a.x.com/1", "http://b.x.com/2", "www.q.com", "www.r.com",
                                          "http://c.y.org", "http://[bad"])]
    df = spark.createDataFrame(rows, "row_idx long, url string")
    d = {r["row_idx"] for r in US.dedupe_by_apex(df).collect()}
    assert d == {0, 2, 4, 5}       # one per apex; host-less www. share apex ''; bad URL kept alone
    first = US.sample_urls(US.dedupe_by_apex(df), 2, random_pick=False).collect()
    assert [(r["n"], r["row_idx"]) for r in first] == [(1, 0), (2, 2)]
    allr = US.sample_urls(US.dedupe_by_apex(df), 10).orderBy("n").collect()   # limit >= size: all, in order
    assert [(r["n"], r["row_idx"]) for r in allr] == [(1, 0), (2, 2), (3, 4), (4, 5)]
    nolimit = US.sample_urls(US.dedupe_by_apex(df), None).orderBy("n").collect()
    assert [(r["n"], r["row_idx"]) for r in nolimit] == [(1, 0), (2, 2), (3, 4), (4, 5)]
    rnd = US.sample_urls(US.dedupe_by_apex(df), 3, random_pick=True, seed=7).collect()
    assert sorted(r["n"] for r in rnd) == [1, 2, 3] and len({r["row_idx"] for r in rnd}) == 3


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

PIECES = ["http", "https", "HTTP", "ftp", ":", "//", "/", "?", "#", "@", ";", ".", "-", "_", "%", "a", "B",
          "xn--p", "0", "12", "www", "com", "login", "=", "&", " ", "\t", "é", "::1", ":8080"]


@st.composite
def url_like(draw):
    return "".join(draw(st.lists(st.sampled_from(PIECES), min_size=1, max_size=14)))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(url_like(), min_size=1, max_size=40))
def test_property_parts_match_urlparse(spark, batch):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(batch)], "i long, t string")
    p = U.url_parts(F.col("t"))
    rows = df.select("i", *[p[k].alias(k) for k in ("scheme", "path", "query", "host", "error")]).orderBy("i").collect()
    for u, r in zip(batch, rows):
        try:
            py = urlparse(u)
            want = (py.scheme, py.path, py.query, py.hostname or "")
        except ValueError:
            assert r["error"] is not None, u
            continue
        assert r["error"] is None, u
        assert (r["scheme"], r["path"], r["query"], r["host"]) == want, u


def test_page_text_reads_every_anchor_unless_told_otherwise(spark):
    from cuelake.functions.pages import anchor_texts

    html = "".join(f"<a href=x>link {i} {'y' * 300}</a>" for i in range(250))
    df = spark.createDataFrame([(html,)], "h string")
    every, some = df.select(anchor_texts("h"), anchor_texts("h", max_links=200, max_chars=200)).first()
    assert len(every) == 250 and all(len(t) > 300 for t in every)
    assert len(some) == 200 and {len(t) for t in some} == {200}
