"""Fixed values that define the results: the persuasion lexicon, the URL
keyword list and the column-role name sets.

Everything here is data. The lexicon is also a *parameter* of every cue
operator: pass your own ``Lexicon`` to count a different phrase list.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values (must stay word for word; order = category / phrase position) ---
CUE_LEXICON: dict[str, list[str]] = {
    "authority": [
        "official notice", "account review team", "security team", "compliance team",
        "verified badge", "support team", "customer service", "help center",
        "administrator", "admin", "security", "support", "service", "notice",
    ],
    "urgency": [
        "urgent action required", "act now", "immediate action", "final notice",
        "expires soon", "deadline", "verify within 24 hours",
        "urgent", "immediately", "now", "today", "minutes", "hours", "24 hours",
    ],
    "scarcity": [
        "only a few left", "limited availability", "limited slots", "while supplies last",
        "limited", "last chance", "only today",
    ],
    "fear_loss": [
        "unusual activity detected", "unauthorised login", "unauthorized login",
        "your account is locked", "payment failed", "suspicious activity",
        "security alert", "fraud alert",
        "suspended", "suspension", "locked", "disabled", "restricted",
        "compromised", "violation", "failed", "failure", "alert", "warning",
    ],
    "consistency_commitment": [
        "confirm your identity", "verify your account", "update your details",
        "complete your profile", "continue to your account",
        "confirm", "verify", "update", "continue", "proceed", "submit", "resolve",
        "login", "sign in", "reset", "password", "identity", "account",
    ],
    "similarity_socialproof": [
        "people like you", "as recommended", "popular choice", "trending now",
        "recommended", "popular", "trending",
    ],
    "reward_reciprocity": [
        "claim your reward", "you have won", "exclusive offer", "congratulations",
        "reward", "bonus", "voucher", "gift", "prize",
    ],
    "brand_trust": [
        "amazon", "barclays", "facebook", "meta", "instagram", "mastercard", "netflix", "paypal",
        "apple", "microsoft", "google", "coinbase", "uphold", "telenet",
    ],
}

# Suspicious URL keywords, counted as distinct substrings present.
SUSPICIOUS_KEYWORDS: list[str] = [
    "login", "verify", "update", "secure", "account", "wallet", "bank", "password", "billing", "invoice",
    "appeal", "case", "support", "help", "gift", "prize", "bonus", "urgent", "suspend", "limited", "verify-now",
]

# Heuristic columns (surface cues) in output order.
EXTRA_COLUMNS: list[str] = ["all_caps_words", "exclamations", "money_symbols", "links"]

# Email scan column roles: header names are stripped + lower-cased before lookup.
SCAN_SUBJECT_KEYS: list[str] = ["subject", "subj", "title", "headline"]
SCAN_BODY_KEYS: list[str] = [
    "body", "text", "message", "content", "payload", "snippet",
    "description", "body_text", "email", "data", "body_snippet",
]
SCAN_HTML_KEYS: list[str] = ["html", "body_html", "message_html", "content_html", "sanitized_body"]
# When a header has neither a body nor an html column, every column but these is body.
SCAN_META_KEYS: list[str] = ["id", "date", "from", "from_domain", "to", "timestamp"]

# Census column roles: exact, case-sensitive names, in priority order.
CENSUS_SUBJECT_KEYS: list[str] = ["subject", "subj", "title", "headline"]
CENSUS_HTML_KEYS: list[str] = ["sanitized_body", "body_html", "message_html", "content_html"]
CENSUS_BODY_KEYS: list[str] = [
    "body_snippet", "body", "text", "message", "content", "payload",
    "description", "body_text", "email", "data",
]

# Census limits and year window.
YEAR_MIN = 2005
YEAR_MAX = 2024
MIN_CONTENT_CHARS = 5
MAX_EXAMPLES_PER_SIG = 3
TOP_DUP_CLUSTERS = 50
UNIQUE_EXAMPLES = 200
EXAMPLE_SUBJECT_CHARS = 200

# URL scan defaults.
DEFAULT_URL_LIMIT = 50
DEFAULT_URL_SEED = 2025
MAX_LINKS = 200
MAX_LINK_CHARS = 200

# Python's urlparse splits ";params" off the last path segment only for these schemes.
USES_PARAMS_SCHEMES: list[str] = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
]
# --- end of fixed values ---


@dataclass(frozen=True)
class Lexicon:
    """An ordered category -> phrases mapping (the cue operator's parameter)."""

    categories: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def from_dict(cls, d: dict[str, list[str]]) -> "Lexicon":
        return cls(tuple((c, tuple(p)) for c, p in d.items()))

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.categories]

    def rows(self) -> list[tuple[str, int, str, int]]:
        """Long form: (category, cat_pos, phrase, phrase_pos), positions from 1."""
        out = []
        for ci, (cat, phrases) in enumerate(self.categories, start=1):
            for pi, p in enumerate(phrases, start=1):
                out.append((cat, ci, p, pi))
        return out

    def phrases(self) -> list[str]:
        return [p for _, ps in self.categories for p in ps]

    def sum_columns(self) -> list[str]:
        return [f"sum_{c}" for c in self.names]

    def to_dataframe(self, spark):
        """The lexicon as a tiny DataFrame (102 rows by default)."""
        return spark.createDataFrame(
            self.rows(), "category string, cat_pos int, phrase string, phrase_pos int"
        )


DEFAULT_LEXICON = Lexicon.from_dict(CUE_LEXICON)
