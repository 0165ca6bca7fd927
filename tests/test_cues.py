"""Golden rows and a property test against Python ``re``."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from cuelake.functions.cues import add_category_totals, phrase_counts_long
from cuelake.functions.lexicon import CUE_LEXICON, DEFAULT_LEXICON


def long_counts(spark, texts, merged=False):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rows = phrase_counts_long(df, ["id"], "t", merged=merged).collect()
    out = [dict() for _ in texts]
    for r in rows:
        out[r["id"]][(r["category"], r["phrase"])] = r["n"]
    return out


def test_golden_phrase_counts(spark):
    texts = [
        "SECURITY ALERT!! Your account is locked!",
        "verify within 24 hours",
        "Sign\nin to PayPal now",
        "http://secure-login.paypal.com/verify",
        "nowé now_ énow NOW",
        "updates accounts",
    ]
    got = long_counts(spark, texts)
    assert got[0] == {("authority", "security"): 1, ("fear_loss", "security alert"): 1, ("fear_loss", "alert"): 1,
                      ("fear_loss", "your account is locked"): 1, ("fear_loss", "locked"): 1,
                      ("consistency_commitment", "account"): 1}
    assert got[1] == {("urgency", "verify within 24 hours"): 1, ("urgency", "24 hours"): 1, ("urgency", "hours"): 1,
                      ("consistency_commitment", "verify"): 1}
    assert got[2] == {("urgency", "now"): 1, ("brand_trust", "paypal"): 1}
    assert got[3] == {("consistency_commitment", "login"): 1, ("consistency_commitment", "verify"): 1,
                      ("brand_trust", "paypal"): 1}
    assert got[4] == {("urgency", "now"): 1}
    assert got[5] == {}
    merged = long_counts(spark, texts[2:5], merged=True)
    assert merged[0][("consistency_commitment", "sign in")] == 1
    assert merged[2][("urgency", "now")] == 1 + 4


WORDS = [p for ps in CUE_LEXICON.values() for p in ps] + ["x", "é", "_", "ſecurity", "Key", "İdentity"]
SEPS = [" ", "  ", "\n", "_", "-", "é", "́", ".", "!", "", "‍", "²"]


@st.composite
def texts(draw):
    parts = draw(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(SEPS), st.booleans()), max_size=12))
    return "".join((w.upper() if up else w) + s for w, s, up in parts)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts(), min_size=1, max_size=20))
def test_property_totals_match_python_re(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "id long, t string")
    raw = add_category_totals(df, "t", merged=False).orderBy("id").collect()
    mer = add_category_totals(df, "t", merged=True).orderBy("id").collect()
    for text, r, m in zip(batch, raw, mer):
        assert {c: r[f"sum_{c}"] for c in CUE_LEXICON} == brute.totals(text), text
        assert {c: m[f"sum_{c}"] for c in CUE_LEXICON} == brute.totals(text, merged=True), text


def test_lexicon_is_a_parameter(spark):
    from cuelake.functions.lexicon import Lexicon

    lex = Lexicon.from_dict({"money": ["$5", "wire transfer"], "x": ["a.b"]})
    df = spark.createDataFrame([(0, "send $5 by Wire Transfer; a.b a.bc x$5")], "id long, t string")
    r = add_category_totals(df, "t", lex).first()
    assert (r["sum_money"], r["sum_x"]) == (2, 1)


def test_plan_has_no_python_and_folds_once(spark):
    df = spark.createDataFrame([(0, "x")], "id long, t string")
    out = add_category_totals(df, "t", DEFAULT_LEXICON, merged=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    opt = out._jdf.queryExecution().optimizedPlan().toString()
    assert opt.count("translate(") == 1
    assert "CartesianProduct" not in plan
