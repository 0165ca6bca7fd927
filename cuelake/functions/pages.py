"""Page text for cue detection (T11) as Column expressions.

A stored page contributes its title, its final URL and the text of its
non-empty anchors, joined by ``" \\n "``; ``max_links`` and ``max_chars`` limit
them on request (``MAX_LINKS`` and ``MAX_LINK_CHARS`` are usual values). Anchor
text follows ``get_text(strip=True)``: every text node stripped, empty ones
dropped, the rest joined without separator. Common entities are decoded; a
full HTML parser is not built (see README).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import WS
from .text import blank_to_empty, py_strip

# --- fixed values: entity -> character, applied in this order (&amp; last) ---
ENTITIES: list[tuple[str, str]] = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&amp;", "&"),
]

TITLE_PATTERN = f"(?is)<title(?:{WS}[^>]*)?>(.*?)</title{WS}*>"
ANCHOR_PATTERN = f"(?is)<a(?:{WS}[^>]*)?>(.*?)</a{WS}*>"
TAG_SPLIT = "<[^>]*>"


def decode_entities(x) -> Column:
    t = blank_to_empty(x)
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def page_title(html) -> Column:
    """The first <title> element's text when it holds no tag, else ''."""
    inner = F.regexp_extract(blank_to_empty(html), TITLE_PATTERN, 1)
    # `inner` is referenced once (a condition plus a branch would extract it
    # from the whole page twice): a one-element array filtered on "no tag".
    kept = F.try_element_at(F.filter(F.array(inner), lambda t: ~t.contains("<")), F.lit(1))
    return decode_entities(F.coalesce(kept, F.lit("")))


def anchor_texts(html, max_links: int | None = None, max_chars: int | None = None) -> Column:
    """ARRAY of the non-empty anchor texts (the first ``max_links``, each cut
    to ``max_chars`` characters; None: all)."""
    inner = F.regexp_extract_all(blank_to_empty(html), F.lit(ANCHOR_PATTERN), F.lit(1))

    def one(a: Column) -> Column:
        nodes = F.transform(F.split(a, TAG_SPLIT), lambda s: py_strip(decode_entities(s)))
        joined = F.array_join(F.filter(nodes, lambda s: s != ""), "")
        return joined if max_chars is None else F.substring(joined, 1, max_chars)

    texts = F.filter(F.transform(inner, one), lambda t: t != "")
    return texts if max_links is None else F.slice(texts, 1, max_links)


def page_text(html, final_url, max_links: int | None = None, max_chars: int | None = None) -> Column:
    """Title, final URL, anchor texts; non-empty parts joined by ' \\n '."""
    parts = F.concat(
        F.array(page_title(html), blank_to_empty(final_url)),
        anchor_texts(html, max_links, max_chars),
    )
    return F.array_join(F.filter(parts, lambda s: s != ""), " \n ")
