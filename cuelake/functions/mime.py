"""RFC 2047 encoded words as Column functions.

``decode_words`` states what ``str(make_header(decode_header(s)))`` of the
Python library gives: words of one charset side by side are one byte string,
blanks between encoded words vanish, and a blank is put between plain and
encoded text that touch. Undecodable values stay as they are.

Covered (``covered``): values in ASCII on one line whose words are well-formed,
not empty and in UTF-8, US-ASCII or one of ``SINGLE_BYTE``. Nothing else is decoded here.
"""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLE_BYTE = tuple(
    n for n in [f"iso-8859-{i}" for i in (*range(1, 12), *range(13, 17))] + [f"windows-{i}" for i in range(1250, 1259)]
    + ["koi8-r", "koi8-u"])
CHARSETS = ("utf-8", "us-ascii", *SINGLE_BYTE)

WORD = r"=\?[^?]*?\?[qQbB]\?.*?\?="
_NAMES = "|".join(n.replace("-", r"\-") for n in sorted(CHARSETS, key=len, reverse=True))
_BASE64 = r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}={0,2}|[A-Za-z0-9+/]{3}=?)?"
_COVERED_WORD = rf"^=\?(?i:{_NAMES})\?(?:[qQ]\?.+|[bB]\?(?!\?=){_BASE64})\?=$"
_ONE_LINE_ASCII = r"^[\x00-\x09\x0e-\x1b\x1f-\x7f]*$"
_SPACE = r"[\t-\r\x1c-\x20]"
_LATIN = "".join(chr(b) for b in range(128, 256))


def _tables() -> tuple[Column, Column]:
    """Per single-byte charset: what bytes 128 to 255 stand for (an undefined
    one stands for itself), and the undefined bytes, as Latin-1 characters."""
    to, undefined = [], []
    for name in CHARSETS[1:]:
        got = [codecs.decode(bytes([b]), name, "replace") for b in range(128, 256)]
        to += [F.lit(name), F.lit("".join(c if g == "�" else g for c, g in zip(_LATIN, got)))]
        undefined += [F.lit(name), F.lit("".join(c for c, g in zip(_LATIN, got) if g == "�"))]
    return F.create_map(*to), F.create_map(*undefined)


def covered(s: Column) -> Column:
    return s.rlike(_ONE_LINE_ASCII) & F.forall(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), lambda w: w.rlike(_COVERED_WORD))


def _payload(word: Column) -> Column:
    """The bytes of an encoded word, in hex."""
    body = F.regexp_extract(word, r"^=\?[^?]*\?[qQbB]\?(.*)\?=$", 1)
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    letters = F.regexp_extract_all(body, F.lit("=[0-9a-fA-F]{2}|."), F.lit(0))
    quoted = F.array_join(F.transform(letters, lambda t: F.when(F.length(t) == 3, F.upper(F.substring(t, 2, 2)))
                                      .when(t == "_", F.lit("20")).otherwise(F.hex(t))), "")
    return F.when(F.lower(F.regexp_extract(word, r"^=\?[^?]*\?(.)", 1)) == "b", F.hex(F.unbase64(padded))).otherwise(quoted)


def _parts(s: Column) -> Column:
    """Plain and encoded parts in order: ``array<struct<cs, hex>>``, ``cs`` is
    '' for plain text. Neighbours of one charset are joined."""
    cut = F.regexp_extract_all(F.regexp_replace(s, f"^{_SPACE}+", ""), F.lit(rf"{WORD}|.+?(?={WORD}|$)"), F.lit(0))
    is_word = lambda t: t.rlike(f"^{WORD}$")
    # Bound once through a one-element array: its size is asked for each element.
    kept = F.element_at(F.transform(F.array(cut), lambda c: F.filter(
        c, lambda t, i: ~(t.rlike(f"^{_SPACE}+$") & (i > 0) & (i < F.size(c) - 1)))), 1)
    parts = F.transform(kept, lambda t: F.struct(
        F.when(is_word(t), F.lower(F.regexp_extract(t, r"^=\?([^?]*)", 1))).otherwise("").alias("cs"),
        F.when(is_word(t), _payload(t)).otherwise(F.hex(t)).alias("hex")))

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(p["cs"].alias("cs"), F.concat(last["hex"], p["hex"]).alias("hex"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["cs"] == p["cs"]), merged).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<struct<cs:string,hex:string>>"), add)


def decode_words(s: Column) -> Column:
    """A covered value decoded, or unchanged where a word is no text of its charset."""
    to, undefined = _tables()

    def text(p: Column) -> Column:
        raw = F.unhex(p["hex"])
        utf8, latin = raw.cast("string"), F.decode(raw, "ISO-8859-1")
        name = F.when(p["cs"] == "", "us-ascii").otherwise(p["cs"])
        bad = F.element_at(undefined, name)
        single = F.when(F.call_function("translate", latin, bad, F.lit("")) == latin,
                        F.call_function("translate", latin, F.lit(_LATIN), F.element_at(to, name)))
        return F.when(p["cs"] == "utf-8", F.when(F.is_valid_utf8(utf8), utf8)).otherwise(single)

    texts = F.transform(_parts(s), lambda p: F.struct(p["cs"].isin("", "us-ascii").alias("ascii"), text(p).alias("t")))
    edge = rf"(?:{_SPACE}|[()\\])"

    def join(acc: Column, p: Column) -> Column:
        gap = (F.when(~acc["some"], False)
               .when(acc["ascii"] & p["ascii"], True)
               .when(p["ascii"], ~p["t"].rlike(f"^{edge}"))
               .when(acc["ascii"], ~acc["t"].rlike(rf"{edge}\z"))
               .otherwise(False))
        return F.struct(F.lit(True).alias("some"), p["ascii"].alias("ascii"),
                        F.concat(acc["t"], F.when(gap, " ").otherwise(""), p["t"]).alias("t"))

    start = F.struct(F.lit(False).alias("some"), F.lit(True).alias("ascii"), F.lit("").alias("t"))
    return F.coalesce(F.aggregate(texts, start, join, lambda acc: acc["t"]), s)
