"""DuckDB (RE2) twins of the Column functions, as SQL expression strings.

Used only to write the oracle SQL of ``__spark_entry__.oracle_sql``. RE2 has
no look-around and no back-reference, so word boundaries are checked by
doubling every separator (each match may consume one separator on each
side) and script/style blocks by an alternation.
"""

from __future__ import annotations

from ..functions.lexicon import DEFAULT_LEXICON, SUSPICIOUS_KEYWORDS, Lexicon
from ..functions.pages import ENTITIES
from ..functions.regex import FOLD_FROM, FOLD_TO, WS_RE2
from ..functions.text import EMAIL_PATTERN
from ..functions.urls import BRACKET_HOST_OK, URL_SPLIT

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
NOT_WS_RE2 = "[^" + WS_RE2[1:-1] + "]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def coalesce_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def fold(x: str) -> str:
    return f"lower(translate({coalesce_empty(x)}, {q(FOLD_FROM)}, {q(FOLD_TO)}))"


def doubled(x: str) -> str:
    return f"regexp_replace({x}, {q('(' + NW + ')')}, '\\1\\1', 'g')"


def _phrase_re2(p: str) -> str:
    out = []
    for ch in p:
        if ch.isalnum() or ch == "_":
            out.append(ch)
        else:
            e = "\\" + ch if not ch.isspace() and ord(ch) < 128 else ch
            out.append(e + e)
    return "".join(out)


def phrase_count(doubled_text: str, phrase: str) -> str:
    pat = f"(?:^|{NW}){_phrase_re2(phrase.lower())}(?:$|{NW})"
    return f"len(regexp_extract_all({doubled_text}, {q(pat)}))"


def category_sums(doubled_text: str, lexicon: Lexicon = DEFAULT_LEXICON, alias: bool = True) -> list[str]:
    out = []
    for cat, phrases in lexicon.categories:
        terms = " + ".join(phrase_count(doubled_text, p) for p in phrases)
        out.append(f"CAST(({terms}) AS BIGINT)" + (f" AS sum_{cat}" if alias else ""))
    return out


def normalize_text(x: str) -> str:
    return f"trim(regexp_replace(lower({coalesce_empty(x)}), '[^a-z0-9]+', ' ', 'g'))"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(WS_RE2 + '+')}, ' ', 'g')"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_RE2 + '+|' + WS_RE2 + '+$')}, '', 'g')"


def is_blank(x: str) -> str:
    return f"coalesce(NOT regexp_matches({x}, {q(NOT_WS_RE2)}), true)"


def html_to_text(x: str) -> str:
    ws = WS_RE2
    alt = "|".join(
        f"<{ws}*{t}[^>]*>.*?<{ws}*/{ws}*{t}{ws}*>" for t in ("script", "style")
    )
    t = f"regexp_replace({coalesce_empty(x)}, {q('(?is)' + alt)}, ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    return f"trim({collapse_ws(t)})"


def normalize_subject(x: str) -> str:
    s = f"lower({py_strip(coalesce_empty(x))})"
    s = f"regexp_replace({s}, {q('^(re|fw|fwd)' + WS_RE2 + '*:' + WS_RE2 + '*')}, '')"
    return collapse_ws(s)


def deobfuscate(x: str) -> str:
    # RE2: the look-behind becomes "start or a non-word character", kept by
    # re-emitting the captured separator.
    t = f"regexp_replace({coalesce_empty(x)}, {q('(?i)(^|' + NW + ')hxxps://')}, '\\1https://', 'g')"
    t = f"regexp_replace({t}, {q('(?i)(^|' + NW + ')hxxp://')}, '\\1http://', 'g')"
    return f"replace({t}, '[.]', '.')"


def redact_emails(x: str) -> str:
    return f"regexp_replace({coalesce_empty(x)}, {q(EMAIL_PATTERN)}, '[redacted-email]', 'g')"


def heuristics(x: str) -> list[str]:
    t = coalesce_empty(x)
    caps = f"len(regexp_extract_all({doubled(t)}, {q('(?:^|' + NW + ')[A-Z]{2,}(?:$|' + NW + ')')}))"
    return [
        f"CAST({caps} AS BIGINT) AS all_caps_words",
        f"CAST(len(regexp_extract_all({t}, '!+')) AS BIGINT) AS exclamations",
        f"CAST(len(regexp_extract_all({t}, '[£$€]')) AS BIGINT) AS money_symbols",
        f"CAST(len(regexp_extract_all({t}, {q('(?i)(https?://|www[.])')})) AS BIGINT) AS links",
    ]


YEAR_RE2 = r"(?:^|[^\p{L}\p{N}_])((?:19|20)\p{Nd}{2})(?:$|[^\p{L}\p{N}_])"


def first_year(x: str) -> str:
    return f"regexp_extract({coalesce_empty(x)}, {q(YEAR_RE2)}, 1)"


def year_ok(y: str, lo: int = 2005, hi: int = 2024) -> str:
    return f"coalesce(TRY_CAST({y} AS INTEGER) BETWEEN {lo} AND {hi}, false)"


def first_present(cols: list[str]) -> str:
    if not cols:
        return "''"
    parts = [f"CASE WHEN NOT {is_blank(c)} THEN {c} END" for c in cols]
    return f"coalesce({', '.join(parts)}, '')"


def sha1_sig(norm: str, min_chars: int = 5) -> str:
    return f"CASE WHEN length({norm}) < {min_chars} THEN '' ELSE sha1({norm}) END"


def sus_count(x: str) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(k)}) AS BIGINT)" for k in SUSPICIOUS_KEYWORDS) + ")"


def phrase_list_literal(lexicon: Lexicon = DEFAULT_LEXICON) -> str:
    return "[" + ", ".join(q(p) for p in lexicon.phrases()) + "]"


# --- URLs ---------------------------------------------------------------------
# The split and bracket patterns are valid in both java.util.regex and RE2.


def normalize_url(x: str) -> str:
    u = py_strip(coalesce_empty(x))
    return (
        f"(CASE WHEN {u} = '' THEN '' WHEN starts_with(lower({u}), 'http://') OR starts_with(lower({u}), 'https://') "
        f"OR starts_with(lower({u}), 'www.') THEN {u} ELSE 'http://' || {u} END)"
    )


def url_stage_sql(src: str, keep: str, url: str = "url") -> str:
    """SELECT list computing URL parts in three nested stages over ``src``.

    Output columns: keep..., url, scheme, netloc, path, query, host, error.
    """
    from ..functions.lexicon import USES_PARAMS_SCHEMES

    schemes = ", ".join(q(s) for s in USES_PARAMS_SCHEMES)
    s1 = (
        f"SELECT {keep}, {url} AS url, "
        f"regexp_replace(regexp_replace(coalesce({url}, ''), '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g') AS u0 FROM {src}"
    )
    s2 = (
        f"SELECT {keep}, url, lower(regexp_extract(u0, {q(URL_SPLIT)}, 1)) AS scheme, "
        f"regexp_extract(u0, {q(URL_SPLIT)}, 2) AS netloc, regexp_extract(u0, {q(URL_SPLIT)}, 3) AS raw_path, "
        f"regexp_extract(u0, {q(URL_SPLIT)}, 4) AS query FROM ({s1})"
    )
    s3 = (
        f"SELECT {keep}, url, scheme, netloc, query, "
        f"CASE WHEN scheme IN ({schemes}) THEN regexp_replace(raw_path, ';[^/]*$', '') ELSE raw_path END AS path, "
        f"regexp_replace(netloc, '^.*@', '') AS hostinfo FROM ({s2})"
    )
    s4 = (
        f"SELECT {keep}, url, scheme, netloc, query, path, hostinfo, "
        f"regexp_extract(hostinfo, '\\[([^\\]]*)', 1) AS bracketed, "
        f"regexp_extract(hostinfo, '\\[[^\\]]*\\](.*)$', 1) AS after_close FROM ({s3})"
    )
    return (
        f"SELECT {keep}, url, scheme, netloc, path, query, "
        f"lower(CASE WHEN contains(hostinfo, '[') THEN bracketed ELSE regexp_extract(hostinfo, '^([^:]*)', 1) END) AS host, "
        f"CASE WHEN contains(netloc, '[') <> contains(netloc, ']') OR (contains(hostinfo, '[') AND ("
        f"NOT regexp_matches(bracketed, {q(BRACKET_HOST_OK)}))) THEN 'ValueError(''Invalid IPv6 URL'')' END AS error "
        f"FROM ({s4})"
    )


def apex(host: str) -> str:
    return f"array_to_string(string_split(lower(coalesce({host}, '')), '.')[-2:], '.')"


def url_feature_list(prefix_ok: str = "error IS NULL") -> list[str]:
    """Feature expressions over the url_stage_sql columns (NULL on error)."""
    pathq = "(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END)"
    labels = "len(regexp_extract_all(host, '[^.]+'))"
    digits = "len(regexp_extract_all(host, '\\p{Nd}'))"
    alnum = "len(regexp_extract_all(host, '[\\p{Nd}\\p{L}]'))"
    f = {
        "host": "host",
        "apex": apex("host"),
        "uses_https": "CAST(scheme = 'https' AS BIGINT)",
        "has_ip_host": "CAST(host <> '' AND (contains(host, ':') OR regexp_matches(host, '^\\p{Nd}{1,3}(\\.\\p{Nd}{1,3}){3}$')) AS BIGINT)",
        "has_punycode": "CAST(regexp_matches(host, '(^|\\.)xn--') AS BIGINT)",
        "at_symbol": "CAST(contains(url, '@') AS BIGINT)",
        "subdomain_count": f"CAST(greatest({labels} - 2, 0) AS BIGINT)",
        "hyphen_count": "CAST(length(host) - length(replace(host, '-', '')) AS BIGINT)",
        "digit_ratio_host": f"CAST(round_even({digits} / greatest({alnum}, 1), 3) AS DOUBLE)",
        "url_length": "CAST(length(url) AS BIGINT)",
        "path_length": "CAST(length(path) AS BIGINT)",
        "query_length": "CAST(length(query) AS BIGINT)",
        "sus_kw_host": f"CAST({sus_count('host')} AS BIGINT)",
        "sus_kw_path": f"CAST({sus_count(pathq)} AS BIGINT)",
    }
    out = []
    for k, v in f.items():
        zero = "''" if k in ("host", "apex") else ("0.0" if k == "digit_ratio_host" else "0")
        cast = "DOUBLE" if k == "digit_ratio_host" else ("VARCHAR" if k in ("host", "apex") else "BIGINT")
        out.append(f"CAST(CASE WHEN {prefix_ok} THEN {v} ELSE {zero} END AS {cast}) AS {k}")
    return out


def mask_expr() -> str:
    """U7 over url_stage_sql columns."""
    ps = py_strip("path")
    seg = f"string_split({ps}, '/')[2]"
    first = (
        f"CASE WHEN {ps} <> '' AND {ps} <> '/' AND {seg} IS NOT NULL AND {seg} <> '' "
        f"THEN '/' || {seg} ELSE '/' END"
    )
    return f"CASE WHEN error IS NOT NULL THEN '[redacted]' ELSE {apex('host')} || ':' || {first} END"


# --- page text (T11) -----------------------------------------------------------
def decode_entities(x: str) -> str:
    t = coalesce_empty(x)
    for e, c in ENTITIES:
        t = f"replace({t}, {q(e)}, {q(c)})"
    return t


def page_text(html: str, final_url: str) -> str:
    ws = WS_RE2
    title_re = f"(?is)<title(?:{ws}[^>]*)?>(.*?)</title{ws}*>"
    anchor_re = f"(?is)<a(?:{ws}[^>]*)?>(.*?)</a{ws}*>"
    inner = f"regexp_extract({coalesce_empty(html)}, {q(title_re)}, 1)"
    title = f"(CASE WHEN contains({inner}, '<') THEN '' ELSE {decode_entities(inner)} END)"
    anchors = f"regexp_extract_all({coalesce_empty(html)}, {q(anchor_re)}, 1)"
    node = f"lambda s: {py_strip(decode_entities('s'))}"
    one = (
        f"lambda a: array_to_string(list_filter(list_transform(string_split_regex(a, '<[^>]*>'), {node}), "
        f"lambda s: s <> ''), '')"
    )
    texts = f"list_filter(list_transform({anchors}, {one}), lambda t: t <> '')"
    parts = f"list_concat([{title}, {coalesce_empty(final_url)}], {texts})"
    return f"array_to_string(list_filter({parts}, lambda s: s <> ''), ' ' || chr(10) || ' ')"
