"""Cue counting (C1-C4): the lexicon compiled into Column expressions.

projection, then per phrase ``when(contains(folded, phrase),
regexp_count(folded, <bounded phrase>))``. The cheap ``contains`` skips the
regex for the (usual) texts without the phrase; the look-around boundaries
reproduce Python's Unicode ``\\b`` exactly. Everything stays JVM-side.

Semantics: each phrase is counted on its own, non-overlapping with itself;
phrases overlap each other freely; matching is case-insensitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import DEFAULT_LEXICON, Lexicon
from .regex import bounded
from .text import fold_case, normalize_text


# Letters from rare to frequent, for the choice of a phrase's search key only.
_RARE_FIRST = "qjxzkwvyfbgphmuclodrsntaie "


def search_key(phrase: str) -> str:
    """The end of the phrase, of four characters or more, that starts with its
    rarest letter: a literal search compares on where the first byte matches,
    and a text without the key lacks the phrase."""
    ends = [phrase[i:] for i in range(max(1, len(phrase) - 3))]
    return min(ends, key=lambda e: (_RARE_FIRST.find(e[0]), -len(e)))


def _phrase_count(folded: Column, phrase: str) -> Column:
    p = phrase.lower()
    key = search_key(p)
    found = folded.contains(F.lit(p))
    return F.when(
        found if key == p else folded.contains(F.lit(key)) & found, F.regexp_count(folded, F.lit(bounded(p)))
    ).otherwise(F.lit(0))


def phrase_count_columns(folded: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> list[tuple[str, str, Column]]:
    """(category, phrase, INT count column) for every phrase.

    ``folded`` must already be case-folded (``fold_case``) or be normalised
    text (``normalize_text``), and should be a column of a preceding
    projection so the fold is computed once.
    """
    return [
        (cat, p, _phrase_count(folded, p)) for cat, phrases in lexicon.categories for p in phrases
    ]


def category_totals(folded: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> dict[str, Column]:
    """``sum_<category>`` BIGINT columns (0 when no phrase matched)."""
    out: dict[str, Column] = {}
    for cat, phrases in lexicon.categories:
        terms = [_phrase_count(folded, p) for p in phrases]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out[f"sum_{cat}"] = total.cast("bigint") if terms else F.lit(0).cast("bigint")
    return out


# A non-word, non-space separator: no phrase can match across it and it acts
# as a text end for the boundaries, so counting over "raw SEP norm" equals the
# raw count plus the normalised count -- one regex per phrase instead of two.
PASS_SEPARATOR = "\u0001"


def cue_source(text: Column, merged: bool = False) -> Column:
    """The text the phrase regexes run over: the case-folded text, or for the
    merged (C4) semantics the folded text and its T2 form joined by
    ``PASS_SEPARATOR``."""
    if not merged:
        return fold_case(text)
    return F.concat(fold_case(text), F.lit(PASS_SEPARATOR), normalize_text(text))


def with_folded(df: DataFrame, text_col: str, merged: bool = False) -> DataFrame:
    """Add ``_cue_src`` in its own projection (computed once, not per phrase)."""
    return df.select("*", cue_source(F.col(text_col), merged).alias("_cue_src"))


def add_category_totals(
    df: DataFrame,
    text_col: str,
    lexicon: Lexicon = DEFAULT_LEXICON,
    merged: bool = False,
) -> DataFrame:
    """Add the ``sum_<category>`` columns for ``text_col``.

    ``merged=False``: one raw pass (emails, C6).
    ``merged=True``: raw pass + normalised pass added (images, URLs, C4), so an
    ordinary hit counts twice and a hit visible in only one form once.
    """
    staged = with_folded(df, text_col, merged)
    sums = category_totals(F.col("_cue_src"), lexicon)
    return staged.select(*df.columns, *[v.alias(k) for k, v in sums.items()])


def phrase_counts_long(
    df: DataFrame,
    key_cols: list[str],
    text_col: str,
    lexicon: Lexicon = DEFAULT_LEXICON,
    merged: bool = False,
) -> DataFrame:
    """C2 in long form: (keys..., category, phrase, n) for every n > 0."""
    staged = with_folded(df.select(*key_cols, text_col), text_col, merged)
    counts = phrase_count_columns(F.col("_cue_src"), lexicon)
    # Counts first (one projection, split into small generated methods), then
    # stack: keeps the generated code of each step under the JVM method limit.
    counted = staged.select(
        *key_cols, *[v.cast("bigint").alias(f"_n{i}") for i, (_, _, v) in enumerate(counts)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.lit(p).alias("phrase"), F.col(f"_n{i}").alias("n"))
            for i, (c, p, _) in enumerate(counts)
        ]
    )
    return counted.select(*key_cols, F.inline(entries)).where(F.col("n") > 0)
