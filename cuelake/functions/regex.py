"""Regex building blocks shared by the Column functions.

Spark runs ``java.util.regex``; the oracle (DuckDB) runs RE2. Both differ
from Python ``re`` in ``\\b``, ``\\s`` and ``\\d``, so every class the
semantics depend on is spelled out here once.
"""

from __future__ import annotations

# Python's str ``\w`` (letters, numbers, underscore).
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# Python's ``\s`` / ``str.isspace()`` set, written for java.util.regex (one
# bit map for the characters below U+0100, ranges for the others).
WS = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_NOT_BLANK = WS.replace(r"\x20", "")
# Its characters.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NOT_WS = "[^" + WS[1:-1] + "]"
# The same set written for RE2 (DuckDB oracle).
WS_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Python's ``\d`` (Unicode decimal digits).
DIGIT = r"\p{Nd}"

# Characters that Python's IGNORECASE equates with ASCII letters but that a
# plain lower() does not fold: long s, Kelvin sign, dotted capital I, dotless i.
FOLD_FROM = "\u017f\u212a\u0130\u0131"
FOLD_TO = "skii"


def _is_word_char(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def java_quote(s: str) -> str:
    """Literal text inside a java.util.regex pattern."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def re2_quote(s: str) -> str:
    """Literal text inside an RE2 pattern."""
    out = []
    for ch in s:
        if ch.isalnum() or ch == " " or ch == "_":
            out.append(ch)
        else:
            out.append("\\" + ch if ord(ch) < 128 else ch)
    return "".join(out)


def bounded(phrase: str) -> str:
    """``\\b<phrase>\\b`` of Python ``re`` as java look-arounds.

    A ``\\b`` next to a word character means "no word character on the other
    side"; next to a non-word character it means "a word character there".
    The literal comes first and the left boundary is checked by a look-behind
    after it (``p(?<!Wp)`` equals ``(?<!W)p``): a pattern that starts with a
    literal lets java.util.regex use its Boyer-Moore search instead of trying
    every position (about 1.6x faster on the bench texts, same counts).
    """
    if not phrase:
        raise ValueError("empty phrase")
    lit = java_quote(phrase)
    left = f"(?<!{WORD}{lit})" if _is_word_char(phrase[0]) else f"(?<={WORD}{lit})"
    right = f"(?!{WORD})" if _is_word_char(phrase[-1]) else f"(?={WORD})"
    return lit + left + right
