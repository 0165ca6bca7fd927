"""Properties on random strings. Golden rows are in
``test_text.py``."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.functions import text as T

PIECES = ["<", ">", "/", "script", "STYLE", "p", "<br>", "</script >", "< style x>", "a", "Verify", " ", "  ",
          "\n", "\t", " ", " ", "　", "RE", "re", "fwd", "Fw", ":", " : ", "2008", "1999", "2031",
          "_", "-", "é", "hxxp://", "HXXPS://", "[.]", "!!", "$", "€", "www.", "HTTPS://", "AB", "CD1", "0", "httpſ://", "WwW.", "ÀB", "Ab"]


@st.composite
def texts(draw):
    return "".join(draw(st.lists(st.sampled_from(PIECES), max_size=16)))


HEURISTICS = ("all_caps_words", "exclamations", "money_symbols", "links")


def has_tag(s):
    """Some '<' is followed by a '>' with at least one character between."""
    return any(s.find(">", i + 1) > i + 1 for i, ch in enumerate(s) if ch == "<")


def counts(text):
    h = T.heuristics(text)
    return F.array(*[h[k].cast("long") for k in HEURISTICS])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(texts(), texts()), min_size=1, max_size=30))
def test_property_text_functions(spark, batch):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(batch)], "i long, a string, b string")
    a, b = F.col("a"), F.col("b")
    both = F.concat_ws("\n", a, b)
    no_digits = F.translate(a, "0123456789", "")
    rows = df.select(
        "i", T.html_to_text(a).alias("html"), T.html_to_text(T.html_to_text(a)).alias("html2"),
        T.normalize_subject(F.concat(F.lit(" Fw : "), a)).alias("subject"),
        T.first_year(no_digits).alias("no_year"),
        T.first_year(F.concat(no_digits, F.lit(" 2008 "), b)).alias("year"),
        T.deobfuscate(a).alias("plain"), T.deobfuscate(T.deobfuscate(a)).alias("plain2"),
        T.deobfuscate(both).alias("plain_both"), F.concat_ws("\n", T.deobfuscate(a), T.deobfuscate(b)).alias("plain_parts"),
        counts(a).alias("n_a"), counts(b).alias("n_b"), counts(both).alias("n_both"),
    ).orderBy("i").collect()
    for (x, y), r in zip(batch, rows):
        assert not has_tag(r["html"]) and r["html"] == r["html2"] == " ".join(r["html"].split()), x
        assert r["subject"] == " ".join(x.lower().split()), x       # one prefix goes, a second stays
        assert r["no_year"] == "" and r["year"] == "2008", (x, y)
        assert "[.]" not in r["plain"] and r["plain"] == r["plain2"], x
        assert r["plain_both"] == r["plain_parts"], (x, y)
        assert r["n_both"] == [p + q for p, q in zip(r["n_a"], r["n_b"])], (x, y)     # a line break parts everything
        assert r["n_a"][2] == sum(x.count(ch) for ch in "\u00a3$\u20ac"), x
        assert r["n_a"][1] == sum(ch == "!" and x[i - 1:i] != "!" for i, ch in enumerate(x)), x
