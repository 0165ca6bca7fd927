"""Text Column functions.

Every function takes and returns ``pyspark.sql.Column`` and is built from
JVM-side expressions only, so it stays inside whole-stage codegen and works on
batch and streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import YEAR_MAX, YEAR_MIN
from .regex import DIGIT, FOLD_FROM, FOLD_TO, NOT_WS, WORD, WS, WS_CHARS, WS_NOT_BLANK


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_empty(x) -> Column:
    """None -> ''."""
    return F.coalesce(_c(x), F.lit(""))


def py_strip(x) -> Column:
    """``str.strip()``: remove Python whitespace at both ends (a trim by
    characters; a regex would try ``WS+$`` at every blank of the text)."""
    return F.trim(_c(x), F.lit(WS_CHARS))


def is_blank(x) -> Column:
    """True when the value is None or only whitespace (``not v.strip()``)."""
    return F.coalesce(~_c(x).rlike(NOT_WS), F.lit(True))


def collapse_ws(x) -> Column:
    """``re.sub(r"\\s+", " ", s)``. Single blanks, the usual case, are no
    match: they would be replaced by themselves."""
    return F.regexp_replace(_c(x), f"(?: {WS}|{WS_NOT_BLANK}){WS}*", " ")


# T1 -------------------------------------------------------------------------
# Case-insensitive only where letters are (tag names, back-reference); the
# same matches as a global (?isu), without case folding at every position.
_SCRIPT_STYLE = f"<{WS}*((?iu:script|style))[^>]*>(?s:.*?)<{WS}*/{WS}*(?iu:\\1){WS}*>"
_TAG = "<[^>]+>"


def html_to_text(x) -> Column:
    """Drop script/style blocks, then every tag (each becomes a space),
    collapse whitespace, trim. Entities stay encoded."""
    t = F.regexp_replace(blank_to_empty(x), _SCRIPT_STYLE, " ")
    t = F.regexp_replace(t, _TAG, " ")
    return F.trim(collapse_ws(t))


# T2 -------------------------------------------------------------------------
def normalize_text(x) -> Column:
    """Lower, runs of non [a-z0-9] -> one space, trim."""
    return F.trim(F.regexp_replace(F.lower(blank_to_empty(x)), "[^a-z0-9]+", " "))


# T3 -------------------------------------------------------------------------
def normalize_subject(x) -> Column:
    """Strip, lower, drop one leading re:/fw:/fwd:, collapse whitespace."""
    s = F.lower(py_strip(blank_to_empty(x)))
    s = F.regexp_replace(s, f"^(re|fw|fwd){WS}*:{WS}*", "")
    return collapse_ws(s)


# T4 -------------------------------------------------------------------------
def deobfuscate(x) -> Column:
    """T4: ``hxxp(s)://`` at a word start -> ``http(s)://``; ``[.]`` -> ``.``.

    The two regex passes run only on texts that hold an ``hxxp`` at all (a
    regex replace always rebuilds the whole string); ``[.]`` is a literal
    replace. Case is spelled out (of h, x, p, s only s has a further variant,
    the long s) and the look-behind runs only at an h."""
    t = blank_to_empty(x)
    hxxp = f"[hH](?<!{WORD}[hH])[xX][xX][pP]"
    fixed = F.regexp_replace(t, f"{hxxp}[sS\u017f]://", "https://")
    fixed = F.regexp_replace(fixed, f"{hxxp}://", "http://")
    t = F.when(t.rlike("[hH][xX][xX][pP]"), fixed).otherwise(t)
    return F.replace(t, F.lit("[.]"), F.lit("."))


# T5 -------------------------------------------------------------------------
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# The same matches, the local part possessive: its class has no ``@``, so
# giving characters back never helps.
_EMAIL = EMAIL_PATTERN.replace("+@", "++@")


def redact_emails(x) -> Column:
    """T5: every e-mail address -> ``[redacted-email]``; None -> ''. The regex
    runs only on texts with an ``@``."""
    t = blank_to_empty(x)
    return F.when(t.contains("@"), F.regexp_replace(t, _EMAIL, "[redacted-email]")).otherwise(t)


# T9 / T10 -------------------------------------------------------------------
# ``\b[A-Z]{2,}\b`` with the first letter before the look-behind (which then
# only runs at capitals); ``(https?://|www\.)`` ignoring case with explicit
# classes: of h, t, p, s, w only s has a further Unicode case variant (long s).
ALL_CAPS_PATTERN = f"[A-Z](?<!{WORD}[A-Z])[A-Z]+(?!{WORD})"
EXCLAM_PATTERN = "!+"
MONEY_PATTERN = "[£$€]"
LINK_PATTERN = "[hH][tT][tT][pP][sS\u017f]?://|[wW][wW][wW]\\."


def heuristics(x) -> dict[str, Column]:
    """The four surface heuristics as BIGINT columns, keyed by name."""
    t = blank_to_empty(x)
    return {
        "all_caps_words": F.regexp_count(t, F.lit(ALL_CAPS_PATTERN)).cast("bigint"),
        "exclamations": F.regexp_count(t, F.lit(EXCLAM_PATTERN)).cast("bigint"),
        "money_symbols": F.regexp_count(t, F.lit(MONEY_PATTERN)).cast("bigint"),
        "links": F.regexp_count(t, F.lit(LINK_PATTERN)).cast("bigint"),
    }


def text_length(x) -> Column:
    """Code points of the text (None -> 0)."""
    return F.length(blank_to_empty(x)).cast("bigint")


def fold_case(x) -> Column:
    """Case fold used by the cue matcher: lower() after mapping the four code
    points Python's IGNORECASE equates with ASCII letters (only where one
    occurs: ``translate`` looks every character up in a map)."""
    t = blank_to_empty(x)
    found = reduce(Column.__or__, [t.contains(F.lit(a)) for a in FOLD_FROM])
    return F.lower(F.when(found, F.translate(t, FOLD_FROM, FOLD_TO)).otherwise(t))


# T12 / T13 ------------------------------------------------------------------
YEAR_PATTERN = f"(?<!{WORD})(?:19|20){DIGIT}{{2}}(?!{WORD})"


def first_year(x) -> Column:
    """The first ``\\b(19|20)\\d{2}\\b`` in the text, or ''."""
    return F.regexp_extract(blank_to_empty(x), YEAR_PATTERN, 0)


def year_in_window(y, lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> Column:
    yi = _c(y).try_cast("int")
    return F.coalesce(yi.between(lo, hi), F.lit(False))


def extract_year(x, lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> Column:
    """First year of the text if it lies in the window, else ''."""
    y = first_year(x)
    return F.when(year_in_window(y, lo, hi), y).otherwise(F.lit(""))


def guess_year(date, file_name, lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> dict[str, Column]:
    """Year from the date field, else from the file name, with audit.

    Returns ``year`` ('' when unknown), ``year_source`` (date_valid |
    fallback_file | unknown) and ``date_out_of_range`` (the date held a year
    outside the window; counted independently of the source).
    """
    dy = first_year(date)
    fy = first_year(file_name)
    d_ok = year_in_window(dy, lo, hi)
    f_ok = year_in_window(fy, lo, hi)
    return {
        "year": F.when(d_ok, dy).when(f_ok, fy).otherwise(F.lit("")),
        "year_source": F.when(d_ok, F.lit("date_valid"))
        .when(f_ok, F.lit("fallback_file"))
        .otherwise(F.lit("unknown")),
        "date_out_of_range": (dy != F.lit("")) & ~d_ok,
    }


# T7 -------------------------------------------------------------------------
def first_present(cols: Sequence) -> Column:
    """The first value that is not blank after strip, in priority order;
    '' when none (the value itself is returned unstripped)."""
    cols = [_c(c) for c in cols]
    if not cols:
        return F.lit("")
    return F.coalesce(*[F.when(~is_blank(c), c) for c in cols], F.lit(""))


# T16 ------------------------------------------------------------------------
_NUMERIC = r"^[+-]?(?:(?:\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"


def tolerant_int(x) -> Column:
    """``int(float(s))`` with every failure -> 0 (truncates toward zero).

    Only Python float literals are accepted: digits with optional single
    underscores between them, a fraction and an exponent. 'nan'/'inf' -> 0.
    """
    s = py_strip(F.coalesce(_c(x).cast("string"), F.lit("")))
    ok = s.rlike(_NUMERIC)
    d = F.regexp_replace(s, "_", "").try_cast("double")
    v = F.when(ok & ~F.isnan(d) & (F.abs(d) < F.lit(9.2e18)), d.cast("bigint"))
    return F.coalesce(v, F.lit(0).cast("bigint"))
