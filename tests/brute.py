"""Plain-Python statements of the semantics, used as test oracles
on small fixtures only."""

import re

from cuelake.functions.lexicon import CUE_LEXICON


def phrase_counts(text: str) -> dict[tuple[str, str], int]:
    out = {}
    for cat, phrases in CUE_LEXICON.items():
        for p in phrases:
            n = len(re.findall(r"\b" + re.escape(p) + r"\b", text, flags=re.IGNORECASE))
            if n:
                out[(cat, p)] = n
    return out


def norm(text: str) -> str:
    """T2 by a character scan: ASCII letters and digits stay, all else parts words."""
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in text.lower())
    return " ".join(kept.split())


def totals(text: str, merged: bool = False) -> dict[str, int]:
    t = {c: 0 for c in CUE_LEXICON}
    for (c, _), n in phrase_counts(text).items():
        t[c] += n
    if merged:
        for (c, _), n in phrase_counts(norm(text)).items():
            t[c] += n
    return t
