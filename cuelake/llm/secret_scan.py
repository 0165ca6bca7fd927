"""Secret scan in built-in functions only.

Three fixed patterns give the base spans. The method adds spans of high
entropy: candidates are runs of ``WINDOW`` or more token characters; for each
character class a window of ``WINDOW`` characters slides over a candidate.
Symbol counts and the sum of c * log2(c) are updated by the character that
enters and the one that leaves, so a step costs the same for any window. The
Shannon entropy is log2(WINDOW) - sum / WINDOW; the sums are whole numbers
(scaled by 2^20), so the comparison is exact. Windows at or above the class's
threshold, all of whose characters belong to the class, are merged into
spans. A candidate that the allow-list matches adds no span: words and
numbers without the other, UUIDs, alphabets and documented example keys, and
what the caller names. Base spans are never suppressed.

Every text is judged by itself in one projection: nothing is shuffled, and a
hot source or a repeated text costs only its own rows.

Positions are code points, end exclusive. Each kind's spans are leftmost and
don't overlap; spans of different kinds may. Spans are ordered by start, then
by kind in the order of ``KINDS``.

Edge cases: null and empty texts have no spans; very long texts and runs are
scanned whole, in blocks of ``BLOCK`` windows; repeated rows are judged each;
an empty table gives no rows; other columns, whatever their names, are
carried only on request.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the base patterns and the least lengths of a match ---
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

WINDOW = 24
BLOCK = 256
CANDIDATE = f"[A-Za-z0-9+/_-]{{{WINDOW},}}"
#: kind -> (symbols, whether case counts, least entropy in bits of a window)
CLASSES = {
    "entropy_hex": ("0123456789abcdef", False, 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", True, 3.9),
}
KINDS = ("assign", "access", "hex", *CLASSES)

#: Candidates that match add no span.
ALLOWED = (
    "^[^0-9]*$", "^[^A-Za-z]*$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "abcdefghijkl", "ABCDEFGHIJKL", "0123456789", "EXAMPLE",
)

SCALE = 1 << 20
#: Scaled c * log2(c) by count.
TERMS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]


def most(bits: float) -> int:
    """The largest sum of terms at which a window has ``bits`` of entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)


def _text(pattern: str) -> str:
    """A pattern as a raw SQL literal; a quote is written by its code."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _ends(matches: str, pieces: str) -> str:
    """End of each match: running sums over the lengths of the pieces between
    the matches and of the matches, by blocks (no step depends on all before it)."""
    return f"""transform(array(transform({matches}, (x, i) -> char_length({pieces}[i]) + char_length(x))), n ->
        transform(array(transform(sequence(0, (size(n) - 1) div {BLOCK}),
                                  b -> aggregate(slice(n, b * {BLOCK} + 1, {BLOCK}), 0L, (s, v) -> s + v))), t ->
        transform(array(transform(t, (v, b) -> aggregate(slice(t, 1, b), 0L, (s, u) -> s + u))), g ->
            transform(n, (v, i) -> g[i div {BLOCK}]
                + aggregate(slice(n, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (s, u) -> s + u))
        )[0])[0])[0]"""


def _found(text: str, pattern: str) -> str:
    """All matches of a pattern: array of (start, end, word)."""
    p = _text(pattern)
    return f"""transform(array(regexp_extract_all({text}, {p}, 0)), m -> if(size(m) = 0,
        cast(array() as array<struct<start: bigint, end: bigint, word: string>>),
        transform(array(split({text}, {p}, -1)), q -> transform(array({_ends('m', 'q')}), e ->
            transform(m, (x, i) -> named_struct('start', e[i] - char_length(x), 'end', e[i], 'word', x)))[0])[0]))[0]"""


def _windows(kind: str) -> str:
    """Spans of one class in a candidate ``c`` (start, end, word)."""
    symbols, case, bits = CLASSES[kind]
    term = "array(" + ", ".join(f"{t}L" for t in TERMS) + ")"
    # Symbols are numbered from 1; 0 is a character outside the class. The
    # state: counts by number, the sum of the terms of the numbers above 0,
    # and the starts of the windows found.
    up, down = "k[i]", f"if(i < {WINDOW}, -1, k[i - {WINDOW}])"
    step = f"""transform(array(named_struct('up', {up}, 'down', {down})), m ->
        transform(array(a.s - if(m.down <= 0, 0L, term[a.n[m.down]] - term[a.n[m.down] - 1])
                            + if(m.up = 0, 0L, term[a.n[m.up] + 1 - int(m.up = m.down)] - term[a.n[m.up] - int(m.up = m.down)])), s ->
            named_struct(
                'n', transform(a.n, (v, j) -> v + int(j = m.up) - int(j = m.down)),
                's', s,
                'hit', if(i >= {WINDOW - 1} and s <= {most(bits)}L and a.n[0] + int(m.up = 0) - int(m.down = 0) = 0,
                          array_append(a.hit, i - {WINDOW - 1}), a.hit)))[0])[0]"""
    block = f"""transform(array(slice(codes, b * {BLOCK} + 1, {BLOCK + WINDOW - 1})), k ->
        aggregate(sequence(0, size(k) - 1),
                  named_struct('n', array_repeat(0, {len(symbols) + 1}), 's', 0L, 'hit', cast(array() as array<int>)),
                  (a, i) -> {step}, a -> transform(a.hit, h -> b * {BLOCK} + h)))[0]"""
    # A window of so many bits has at least 2^bits different symbols.
    hits = f"""if(size(array_distinct(codes)) < {math.ceil(2 ** bits)}, cast(array() as array<int>),
        flatten(transform(sequence(0, (size(codes) - {WINDOW}) div {BLOCK}), b -> {block})))"""
    merged = f"""transform(array(filter(h, (x, i) -> i = size(h) - 1 or h[i + 1] - x > {WINDOW})), z ->
        transform(filter(h, (x, i) -> i = 0 or x - h[i - 1] > {WINDOW}), (x, i) -> named_struct(
            'start', c.start + x, 'end', c.start + z[i] + {WINDOW}, 'word', substring(c.word, x + 1, z[i] + {WINDOW} - x))))[0]"""
    return f"""transform(array({term}), term ->
        transform(array(transform(split({'c.word' if case else 'lower(c.word)'}, ''), x -> instr('{symbols}', x))), codes ->
        transform(array({hits}), h -> {merged})[0])[0])[0]"""


def scan(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``carry`` and, for each kind, its spans as an array of (start, end, word)."""
    allow = " or ".join(["false", *(f"c.word rlike {_text(p)}" for p in allowed)])
    got = docs.select(F.struct(*carry).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    got = got.select(
        "_row", F.expr(f"filter({_found('_t', ASSIGN)}, x -> char_length(regexp_extract(x.word, {_text(ASSIGN)}, 2)) >= {ASSIGN_LEAST})").alias("assign"),
        F.expr(_found("_t", ACCESS)).alias("access"), F.expr(_found("_t", HEX)).alias("hex"),
        F.expr(f"filter({_found('_t', CANDIDATE)}, c -> not ({allow}))").alias("_c"))
    return got.select("_row.*", "assign", "access", "hex", *[
        F.expr(f"flatten(transform(_c, c -> {_windows(kind)}))").alias(kind) for kind in CLASSES])


def listed(kinds: Sequence[str] = KINDS) -> Column:
    """The spans of ``scan`` columns as text: kind:start:end, by start, then kind."""
    each = [f"transform({k}, x -> named_struct('start', x.start, 'order', {i}, 'label', concat_ws(':', '{k}', x.start, x.end)))"
            for i, k in enumerate(KINDS) if k in kinds]
    return F.expr(f"array_join(transform(array_sort(concat({', '.join(each)})), x -> x.label), ',')")


def report(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, for every document."""
    return scan(docs, allowed=allowed).select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), listed().alias("spans"))
