"""Queries through files at scale: a box of the corpus goes on in further
files, headers are parsed for once, stored runs are summed in one pass."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuelake.functions import cues as CU
from cuelake.functions import text as T
from cuelake.functions.lexicon import DEFAULT_LEXICON
from cuelake.operators import summary as SM
from cuelake.plans import derived as D
from cuelake.plans import stored as S
from cuelake.sources import csv_corpus as C


@pytest.fixture
def documents(spark, tmp_path):
    """90 documents; one has no source, one id comes twice."""
    i = F.col("doc_id")
    spark.range(90).select(
        F.when(F.col("id") == 80, F.lit(8)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 9 != 4, F.concat(F.lit('line "one"\nof, '), F.col("id").cast("string"), F.repeat(F.lit(" x"), 400))).alias("text"),
        F.when(F.col("id") % 2 == 0, F.lit("en")).otherwise(F.lit("de")).alias("lang"),
        F.when(F.col("id") != 33, F.lit("web")).alias("source"),
    ).select(i, "text", "lang", "source").write.parquet(f"{tmp_path}/in/documents.parquet")
    return f"{tmp_path}/in"


def test_oversized_corpus_goes_on_in_further_files(spark, documents, tmp_path):
    root = f"{tmp_path}/corpus"
    D.write_oversized_corpus(spark, documents, root, 2000, file_bytes=8000)
    files = list(Path(root).rglob("*.csv"))
    assert len(files) > 8 and max(f.stat().st_size for f in files) < 16_000
    assert all(f.read_text().startswith("subject,body,note\n") for f in files)
    got = {(r["kind"], r["row_idx"]): r["subject_raw"] for r in S._place(C.scan_frame(C.corpus_rows(spark, root))).collect()}
    ids = sorted(8 if i == 80 else i for i in range(90))
    own = {k: [d for d in ids if d % 8 == k] for k in range(8)}
    assert got == {(k, n): str(d) for k in own for n, d in enumerate(own[k], 1)}


def test_boxes_of_several_files_are_numbered_and_counted_whole(spark, documents, tmp_path, monkeypatch):
    root = f"{tmp_path}/corpus"
    D.write_mail_corpus(spark, documents, root, file_bytes=16_000)
    rows = S._place(C.scan_frame(C.corpus_rows(spark, root)))
    boxes = rows.groupBy("kind", "box").agg(F.count("*").alias("n"), F.max("row_idx").alias("last"), F.countDistinct("row_idx").alias("d")).collect()
    assert len(list(Path(root).rglob("*.csv"))) > len(boxes) and all(b["n"] == b["last"] == b["d"] for b in boxes)
    assert sum(b["n"] for b in boxes) == 90
    monkeypatch.setattr(S, "_mail_corpus", lambda *_: root)
    listed = {(r["kind"], r["box"]): r["rows_total"] for r in S.csv_corpus_files(spark, documents).collect()}
    assert listed == {(b["kind"], b["box"]): b["n"] for b in boxes} | {(7, "empty"): 0}


def test_headers_are_kept(spark, documents, tmp_path):
    root = f"{tmp_path}/corpus"
    D.write_mail_corpus(spark, documents, root)
    _, headers = C.read_corpus(spark, root)
    plan = headers._jdf.queryExecution().executedPlan().toString()
    assert headers.count() and "csv" not in plan.lower()


def test_runs_are_summed_in_one_pass(spark):
    rows = spark.createDataFrame([("a", "1", "", "5", "f1"), ("a", "2", "", "7", "f2"), ("a", "2", "x", " 8.9 ", "f2"), ("b", "1", None, "nan", "f3"),
                                  ("b", None, "", "3", "f4")], "source string, run_id string, error string, links string, run_file string")
    out = SM.rollup_sources(rows)
    got = {r["source"]: (r["file"], r["timestamp"], r["n_items"], r["errors"], r["links"]) for r in out.collect()}
    assert got == {"a": ("f2", "2", 2, 1, 15), "b": ("f3", "1", 1, 0, 0), "TOTAL": ("—", "—", 3, 1, 15)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1


def test_rare_letters_first():
    for p in DEFAULT_LEXICON.phrases():
        key = CU.search_key(p.lower())
        assert p.lower().endswith(key) and len(key) >= min(4, len(p))
    assert CU.search_key("act now") == "ct now"


def test_text_steps_without_lookups(spark):
    ws = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    texts = [None, "", " ", ws, ws + "a" + ws + "b c  d\t e \n" + ws, "​a​", "ſKİı ACT", "a@b.com_x@y.org @ x@y", "no mail", "a.b@c.d.ee@f.gg",
             "hxxp://a HXXPſ://b xhxxp://c hxxpS://d _hxxp://e[.]f hhxxp://g"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    email = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
    for r in df.select("t", T.py_strip("t").alias("s"), T.collapse_ws("t").alias("c"), T.redact_emails("t").alias("r"), T.deobfuscate("t").alias("d"),
                       T.fold_case("t").alias("f")).collect():
        t = r["t"] or ""
        assert (r["s"], r["c"]) == ((None, None) if r["t"] is None else (t.strip(), re.sub(r"\s+", " ", t)))
        assert r["r"] == re.sub(email, "[redacted-email]", t)
        d = re.sub(r"(?i)\bhxxp://", "http://", re.sub(r"(?i)\bhxxps://", "https://", t)).replace("[.]", ".")
        assert r["d"] == d and r["f"] == t.translate(str.maketrans("ſKİı", "skii")).lower()
    plan = df.select(T.fold_case("t"), T.py_strip("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ELSE" in plan and "regexp_replace(" not in plan      # translate only where it finds something
