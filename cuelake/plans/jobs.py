"""Runner (R1): e-mails -> screenshots -> URLs -> summary, and the census.

Each job reads its inputs, runs one Spark plan and writes its outputs under
``<out_root>/<source>_<kind>/run_id=<run_id>``; a missing input skips that job. A
scan is staged once and all its sinks read that. The summary reads the jobs' flat CSV outputs back (files are the contract between
jobs) and keeps the latest run of each source.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON, DEFAULT_URL_SEED, Lexicon
from ..operators import census as CS
from ..operators import images as IM
from ..operators import mail as ML
from ..operators import summary as SM
from ..operators import url_scan as US
from ..session import ensure_checkpoint_dir, new_folder
from ..sources import csv_corpus as C
from ..sources import sinks as K


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


@dataclass
class RunConfig:
    out_root: str
    emails_root: str | None = None
    screenshots: str | None = None       # parquet: path, ocr_text, error
    urls_csv: str | None = None          # CSV with a 'url' column
    crawl: str | None = None             # parquet: url, html [, status, redirects, final_url, content_type, error]
    run_id: str = field(default_factory=new_run_id)
    url_limit: int | None = None         # None: every URL; a number: a sample of so many
    url_random: bool = True
    url_seed: int = DEFAULT_URL_SEED
    url_dedupe: str = "apex"
    url_fetch: str = "get"
    lexicon: Lexicon = DEFAULT_LEXICON
    field_limit: int | None = C.FIELD_LIMIT   # e-mail records with a longer field are error rows; None: no limit
    #: Rows and errors of each scan, filled in by the jobs.
    metrics: dict[str, dict[str, int]] = field(default_factory=dict)


def _exists(spark: SparkSession, path: str | None) -> bool:
    return bool(path) and C._exists(spark, path)


def email_job(spark: SparkSession, cfg: RunConfig) -> DataFrame | None:
    if not _exists(spark, cfg.emails_root):
        return None
    rows, headers = C.read_corpus(spark, cfg.emails_root)
    scan = ML.finish_scan(C.scan_frame(rows, cfg.field_limit), cfg.lexicon)
    bad = C.unreadable_files(spark, cfg.emails_root, headers)
    scan, cfg.metrics["emails"] = K.staged(scan.unionByName(bad, allowMissingColumns=True), new_folder(spark, "emails"))
    K.nested_json(K.scan_records(scan, cfg.lexicon), K.run_path(cfg.out_root, "emails", cfg.run_id, "json"))
    K.flat_csv(scan.drop("status", "to"), K.run_path(cfg.out_root, "emails", cfg.run_id))
    return scan


def screenshot_job(spark: SparkSession, cfg: RunConfig) -> DataFrame | None:
    if not _exists(spark, cfg.screenshots):
        return None
    scan, cfg.metrics["images"] = K.staged(
        IM.screenshot_scan(spark.read.parquet(cfg.screenshots), cfg.lexicon), new_folder(spark, "images"))
    K.nested_json(K.scan_records(scan, cfg.lexicon, meta=False), K.run_path(cfg.out_root, "images", cfg.run_id, "json"))
    K.flat_csv(scan.drop("status"), K.run_path(cfg.out_root, "images", cfg.run_id))
    return scan


def read_url_list(spark: SparkSession, path: str) -> DataFrame | None:
    """The first column named 'url' (any case/padding; of repeated headers
    the last one's values), U1, empties dropped. None without such a column."""
    rows, headers = C.read_corpus(spark, path, "*", balance=False, columns=("header",))
    if headers.filter(C.first_like("url").isNotNull()).isEmpty():
        return None
    url = F.coalesce(F.try_element_at(F.col("vals"), C.first_like("url")), F.lit(""))
    return US.url_table(rows.select(url.alias("url"), "row_idx"), "url", "row_idx")


def url_job(spark: SparkSession, cfg: RunConfig) -> DataFrame | None:
    if not _exists(spark, cfg.urls_csv):
        return None
    urls = read_url_list(spark, cfg.urls_csv)
    if urls is None:
        return None
    crawl = spark.read.parquet(cfg.crawl) if _exists(spark, cfg.crawl) else None
    fetch = cfg.url_fetch if crawl is not None else "off"
    picked = US.sample_urls(US.dedupe_by_apex(urls, cfg.url_dedupe), cfg.url_limit, cfg.url_random, cfg.url_seed)
    picked = picked.checkpoint(eager=True)   # the sample is reused by two writers
    K.text_lines(picked.orderBy("n"), "url", K.run_path(cfg.out_root, "urls", cfg.run_id, "urls_used"))
    rows, cfg.metrics["urls"] = K.staged(
        US.score_urls(US.attach_pages(picked, crawl, fetch, limit=cfg.url_limit), cfg.lexicon), new_folder(spark, "urls"))
    K.flat_csv(rows.drop("row_idx"), K.run_path(cfg.out_root, "urls", cfg.run_id), clean_newlines=False)
    K.nested_json(rows.drop("row_idx"), K.run_path(cfg.out_root, "urls", cfg.run_id, "json"))
    return rows


def summary_job(spark: SparkSession, cfg: RunConfig) -> DataFrame | None:
    frames = []
    for source in SM.SOURCES:
        df = K.read_latest(spark, cfg.out_root, source)
        if df is not None:
            frames.append(df.withColumn("source", F.lit(source)))
    if not frames:
        return None
    # One row per source and TOTAL: computed once for both outputs and the caller.
    ensure_checkpoint_dir(spark)
    summary = SM.rollup_sources(SM.union_sources(frames), cfg.lexicon).checkpoint(eager=True)
    K.flat_csv(SM.ordered(summary), K.run_path(cfg.out_root, "summary", cfg.run_id))
    K.nested_json(SM.summary_record(summary, cfg.lexicon), K.run_path(cfg.out_root, "summary", cfg.run_id, "json"))
    return summary


def run_all(spark: SparkSession, cfg: RunConfig) -> dict[str, bool]:
    """The four jobs in order; a missing input skips its job."""
    done = {}
    for name, job in (("emails", email_job), ("images", screenshot_job), ("urls", url_job),
                      ("summary", summary_job)):
        done[name] = job(spark, cfg) is not None
    return done


def census_job(spark: SparkSession, emails_root: str, out_root: str, run_id: str | None = None) -> CS.CensusReport | None:
    """The duplicate census of a CSV corpus (not part of ``run_all``)."""
    if not _exists(spark, emails_root):
        return None
    rows = C.corpus_rows(spark, emails_root, C.CENSUS_GLOB)
    names = sorted(set(
        ["from_domain", "date"] + CS.CENSUS_SUBJECT_KEYS + CS.CENSUS_HTML_KEYS + CS.CENSUS_BODY_KEYS))
    named = C.named_columns(rows, names)
    files = C.list_files(spark, emails_root, C.CENSUS_GLOB)
    rep = CS.census(named, files, stage=True, numeric_order=True)
    rid = run_id or new_run_id()
    K.flat_csv(rep.per_year.orderBy("year"), K.run_path(out_root, "census", rid, "per_year_counts"))
    K.flat_csv(rep.per_file.orderBy("file"), K.run_path(out_root, "census", rid, "files_summary"))
    K.flat_csv(rep.top_duplicates, K.run_path(out_root, "census", rid, "duplicates_top"))
    K.flat_csv(rep.unique_examples, K.run_path(out_root, "census", rid, "unique_examples"))
    record = CS.overall_record(rep.overall, rep.per_year, emails_root, out_root)
    K.nested_json(record, K.run_path(out_root, "census", rid, "overall"))
    return rep
