"""Quality rules with robust multivariate outliers, in built-in functions only.

Each text gets five counts; their transforms form a vector. For every cell of
language and source a minimum-covariance-determinant estimate is fitted by
concentration steps: start from medians and MADs, keep the ``SHARE`` of rows
with the least Mahalanobis distance, estimate mean and covariance from them,
repeat. A document is rejected if its squared distance exceeds ``CUT``.

All steps are aggregates by cell with partial sums (quantiles by
``percentile_approx``, of bounded size), so a hot cell costs no single task.
Cells with fewer than ``MIN_ROWS`` documents are pooled by language; those of
a pool that is still smaller are judged by an estimate over all documents.
Fewer than ``MIN_ROWS`` documents in all reject nothing.

Edge cases: a null text has no words (``base_failed``); null language or
source is a cell of its own; repeated rows count as often as they occur; an
empty table gives no rows; other columns are carried only on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# --- fixed values: what counts as blank and as a symbol ---
BLANKS = r" \t\n\u000B\u000C\r"      # as written in a SQL literal
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SHARE = 0.75            # rows that a concentration step keeps
STEPS = 4               # concentration steps
MIN_ROWS = 200          # least size of a cell with its own estimate
CUT = 100.0             # squared Mahalanobis distance
#: Least standard deviation of each transform: a count that is zero in most documents has no spread of its own.
FLOOR = (0.25, 0.05, 0.25, 0.5, 0.5)
DIM = len(FLOOR)
MEDIAN_CHI2 = 4.3515    # of 5 degrees of freedom: scales the trimmed covariance

# Words -> (bits of a position, sorted 3-word windows as hash and position in one
# number, positions of windows found twice) -> words covered. Equal hashes are
# confirmed by the words.
_SAME = """shiftright(x, b) = shiftright({y}, b)
   and w[int(x & (shiftleft(1L, b) - 1))] = w[int({y} & (shiftleft(1L, b) - 1))]
   and w[int(x & (shiftleft(1L, b) - 1)) + 1] = w[int({y} & (shiftleft(1L, b) - 1)) + 1]
   and w[int(x & (shiftleft(1L, b) - 1)) + 2] = w[int({y} & (shiftleft(1L, b) - 1)) + 2]"""
_REPEATS = f"""
transform(array(int(ceil(log2(size(w) + 1)))), b ->
 transform(array(sort_array(transform(sequence(0, size(w) - 3), i ->
    shiftleft(shiftright(xxhash64(w[i], w[i + 1], w[i + 2]), b), b) | bigint(i)))), p ->
  transform(array(sort_array(transform(filter(p, (x, i) ->
     (i > 0 and {_SAME.format(y='p[i - 1]')}) or (i < size(p) - 1 and {_SAME.format(y='p[i + 1]')})),
     x -> x & (shiftleft(1L, b) - 1)))), q ->
   aggregate(transform(q, (x, i) -> if(i = 0, 3L, least(3L, x - q[i - 1]))), 0L, (s, x) -> s + x)
 )[0])[0])[0]"""


def counts(text: str = "text") -> Column:
    """Struct of the five counts of a text column, each of type BIGINT."""
    t = f"coalesce({text}, '')"
    return F.expr(f"""transform(array(filter(split({t}, '[{BLANKS}]+'), x -> x <> '')), w -> named_struct(
        'n_words', bigint(size(w)),
        'word_chars', bigint(char_length(translate({t}, '{BLANKS}', ''))),
        'n_symbols', bigint(char_length({t}) - char_length(translate({t}, '{SYMBOLS}', ''))),
        'n_dup_lines', transform(array(filter(split({t}, '\\n'), x -> x rlike '[^{BLANKS}]')), l ->
             bigint(size(l) - size(array_distinct(l))))[0],
        'n_repeat_words', if(size(w) < 4, 0L, {_REPEATS})))[0]""")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    c = F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log1p("n_words"), F.log(c / n), F.log1p(1000 * F.col("n_symbols") / c),
            F.log1p("n_dup_lines"), F.log1p(100 * F.col("n_repeat_words") / n)]


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with m0.. and l00.. ."""
    z: list[Column] = []
    for i in range(DIM):
        v = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _with_factor(est: DataFrame, keys: list[str]) -> DataFrame:
    """Cell estimates with means m*, variances c* -> means and Cholesky factors.
    One factor entry after the other, so that each expression stays short."""
    for i, j in _PAIRS:
        v = F.col(f"c{i}{j}")
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    return est.select(*keys, *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i, j in _PAIRS])


def fit(rows: DataFrame, folder: str, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Estimates per cell (columns ``g1, g2``) of ``rows`` (g1, g2, x0..)."""
    keys = ["g1", "g2"]
    med = stage(rows.groupBy(*keys).agg(*[F.percentile_approx(f"x{i}", 0.5, 10000).alias(f"m{i}") for i in range(DIM)]),
                folder, "median")
    mad = (rows.join(med, keys).groupBy(*keys)
           .agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(DIM)],
                *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 10000).alias(f"d{i}") for i in range(DIM)]))
    est = mad.select(*keys, *[f"m{i}" for i in range(DIM)], *[
        (F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    est = stage(_with_factor(est, keys), folder, "start")
    for n in range(steps):
        near = rows.join(est, keys).withColumn("d2", _distance())
        # Written, so that its size is known and it is broadcast if small: a hot cell stays spread over the tasks.
        cut = stage(near.groupBy(*keys).agg(F.percentile_approx("d2", share, 10000).alias("cut")), folder, f"cut-{n}")
        sums = (near.select(*keys, "d2", *[f"x{i}" for i in range(DIM)]).join(cut, keys).filter("d2 <= cut")
                .groupBy(*keys).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(DIM)],
                                    *[F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}{j}") for i, j in _PAIRS]))
        est = sums.select(*keys, *[f"m{i}" for i in range(DIM)], *[
            (F.col(f"v{i}{j}") + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
        est = stage(_with_factor(est, keys), folder, f"step-{n}")
    # The trimmed covariance is too small: scale so that the median distance is that of a normal cloud.
    scale = (rows.join(est, keys).withColumn("d2", _distance()).groupBy(*keys)
             .agg(F.percentile_approx("d2", 0.5, 10000).alias("med"), F.count("*").alias("cell_rows"))
             .withColumn("scale", F.greatest(F.col("med") / MEDIAN_CHI2, F.lit(1.0))))
    return stage(est.join(scale.select(*keys, "scale", "cell_rows"), keys), folder, "estimate")


def _cell() -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(f"_{c}") for c in ("lang", "source")]


def counted(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, the cell, the counts and ``base_failed`` of every row."""
    # Numbered rows keep a later filter on the counts above this projection: counts are computed once.
    number = F.monotonically_increasing_id().alias("_n")
    got = docs.select(*carry, *_cell(), counts().alias("_s"), number).select(*carry, "_lang", "_source", "_s.*", "_n")
    return got.withColumn("base_failed", base_failed())


def estimates(got: DataFrame, folder: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Estimates for each language and source of ``counted`` rows, from all
    that pass the base rules. Written to shared storage: its size is then
    known, and the later join is a broadcast only if that is small."""
    passed = got.filter("not base_failed").select("_lang", "_source", *[v.alias(f"x{i}") for i, v in enumerate(_vector())])
    sizes = stage(passed.groupBy("_lang", "_source").count(), folder, "cells")
    small = sizes.filter(F.col("count") < min_rows).groupBy("_lang").agg(F.sum("count").alias("_pool"))
    cells = stage(sizes.join(small, "_lang", "left").select(
        "_lang", "_source",
        F.when((F.col("count") >= min_rows) | (F.col("_pool") >= min_rows), F.col("_lang")).otherwise("*").alias("g1"),
        F.when(F.col("count") >= min_rows, F.col("_source")).otherwise("*").alias("g2")), folder, "keys")
    x = [f"x{i}" for i in range(DIM)]
    rows = passed.join(cells.filter("g1 <> '*'"), ["_lang", "_source"]).select("g1", "g2", *x)
    if not cells.filter("g1 = '*'").isEmpty():
        rows = rows.union(passed.select(F.lit("*"), F.lit("*"), *x))
    est = fit(rows, folder)
    return stage(cells.join(est, ["g1", "g2"]), folder, "params")


def judge(got: DataFrame, params: DataFrame, carry: list[str], cut: float = CUT, min_rows: int = MIN_ROWS) -> DataFrame:
    """Distance and verdict of ``counted`` rows."""
    joined = got.join(params, ["_lang", "_source"], "left").select(
        "*", *[v.alias(f"x{i}") for i, v in enumerate(_vector())])
    d = _distance() / F.col("scale")
    return (joined.withColumn("distance", F.when(~F.col("base_failed") & (F.col("cell_rows") >= min_rows), d))
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut))
            .select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "distance", "kept"))


def quality(docs: DataFrame, folder: str) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` and ``kept`` for every row of
    ``docs`` (doc_id, text, lang, source). The counts are staged once."""
    got = stage(counted(docs, ["doc_id"]), folder, "counts")
    return judge(got, estimates(got, folder), ["doc_id"])


def kept_rows(docs: DataFrame, folder: str) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. The texts
    are read twice (for the estimates, for the verdicts) and never staged or
    shuffled."""
    narrow = stage(counted(docs, []), folder, "counts")
    rows = docs.select("text", "lang", "source", F.struct("*").alias("_row"))
    judged = judge(counted(rows, ["_row"]), estimates(narrow, folder), ["_row", "_n"])
    return judged.filter("kept and _n >= 0").select("_row.*")
