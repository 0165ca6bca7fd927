"""SQL-callable functions equal their Column twins."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from cuelake.functions.cues import add_category_totals
from cuelake.functions.sql import register_sql_functions
from cuelake.plans import derived as D


def test_sql_functions_match_columns(spark):
    names = register_sql_functions(spark)
    assert "cue_totals" in names and "cue_mask_url" in names
    got = spark.sql(
        "SELECT cue_normalize_text('Hi, There!') a, cue_html_to_text('<p>x</p><script>y</script>z') b, "
        "cue_deobfuscate('hxxps://a[.]b') c, cue_extract_year('Mon 2008') d, cue_mask_url('http://a.b.c/x/y') e, "
        "cue_normalize_url(' q.com ') f, cue_tolerant_int(' 3.9 ') g, cue_url_apex('http://x.y.co.uk/') h, "
        "cue_heuristics('PAY NOW!!! $5 www.x').links i"
    ).first()
    assert tuple(got) == ("hi there", "x z", "https://a.b", "2008", "b.c:/x", "http://q.com", 3, "co.uk", 1)
    docs = D.salted_documents(spark, SF_SMALL).select("doc_id", "text")
    docs.createOrReplaceTempView("salted_docs")
    via_sql = spark.sql("SELECT doc_id, t.* FROM (SELECT doc_id, cue_totals_merged(text) AS t FROM salted_docs)")
    via_col = add_category_totals(docs, "text", merged=True).drop("text")
    assert via_sql.exceptAll(via_col).count() == 0 and via_sql.count() == via_col.count()
    plan = via_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
