"""Language identification by hierarchical discrimination.

First a one-versus-rest linear SVM per family names the language family, then
one-versus-one linear SVMs separate the languages within it. A text becomes
the hashed counts of its letter bigrams and trigrams (square root, unit
length); the whole text counts, whatever its length.

Training rows: at most about ``per_language`` labelled documents of each
language (a documented bound on the fit alone), chosen by a hash of the id.
Each SVM is trained in a group of its own, of bounded size.

Edge cases: a null text or one without a letter is ``und`` with score 0;
with no training rows every text is ``und``, with one language every text
with letters is that language; repeated rows and null ids stay as they are;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

UNDETERMINED = "und"
DIM = 4096
#: Bounds of the training sample: rows per language, rows of one family problem.
PER_LANGUAGE = 500
PER_FAMILY_PROBLEM = 4000

# --- fixed values: language families (a language that is not here is a family of its own) ---
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
    "indic": ["hi", "bn", "mr", "ur"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"other:{lang}")


def _is_letter(c: int) -> bool:
    return unicodedata.category(chr(c))[0] == "L"


_LETTERS = np.array([_is_letter(c) for c in range(0x3000)])


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of hashed letter bigrams and trigrams; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTERS[np.minimum(c, len(_LETTERS) - 1)]
    if (far := np.flatnonzero(c >= len(_LETTERS))).size:
        letter = letter.copy()
        kinds = {v: _is_letter(v) for v in np.unique(c[far]).tolist()}
        letter[far] = [kinds[v] for v in c[far].tolist()]
    if not letter.any():
        return None
    c = np.where(letter, c, 32).astype(np.uint32)
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]      # one blank between words
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0xC2B2AE35)
    two = ((two ^ (two >> np.uint32(13))) * np.uint32(0x165667B1)) >> np.uint32(20)
    three = ((three ^ (three >> np.uint32(13))) * np.uint32(0x2545F491)) >> np.uint32(20)
    x = np.sqrt(np.bincount(two, minlength=DIM) + np.bincount(three, minlength=DIM)).astype(np.float32)
    return x / np.sqrt((x * x).sum())


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Weights and bias (last) of a linear SVM: class-balanced squared hinge
    loss, accelerated gradient steps from zero (no randomness)."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = z = np.zeros(x.shape[1])
    step, t = 1 / 4.0, 1.0                       # 2 * max squared row length = 4 bounds the curvature
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (penalty * z - 2 * x.T @ (weight * slack * y))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, w = new + (old - 1) / t * (new - w), new
    return w


@dataclass
class Model:
    languages: list[str]
    families: dict[str, list[str]]
    weights: dict[str, np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.languages:
            return UNDETERMINED, 0.0
        x = np.append(x, 1.0)
        if len(self.families) == 1:
            family, sure = next(iter(self.families)), 1.0
        else:
            margin = {f: float(self.weights[f"family\t{f}"] @ x) for f in self.families}
            family = max(margin, key=lambda f: (margin[f], f))
            sure = 1 / (1 + np.exp(-4 * margin[family]))
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], float(sure)
        votes = dict.fromkeys(langs, 0.0)
        for a, b in itertools.combinations(langs, 2):
            p = 1 / (1 + np.exp(-4 * float(self.weights[f"pair\t{a}\t{b}"] @ x)))
            votes[a] += p
            votes[b] += 1 - p
        best = max(langs, key=lambda v: (votes[v], v))
        return best, float(sure * votes[best] / (len(langs) - 1))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, family_rows: int = PER_FAMILY_PROBLEM) -> Model:
    """Model from ``labelled`` (doc_id, text, lang). The driver receives one
    count per language and one weight vector per SVM."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    families: dict[str, list[str]] = {}
    for v in languages:
        families.setdefault(family_of(v), []).append(v)
    if len(languages) < 2:
        return Model(languages, families, {})
    # A row is taken if the hash of its id falls below the share that its language needs.
    unit = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == v, F.lit(min(1.0, per_language / counts[v]))) for v in languages])
    sample = labelled.withColumn("u", unit / share).filter("u < 1")
    spread_rows = min(1.0, family_rows / (len(languages) * per_language))
    many = len(families) > 1

    def problems(batches):
        for b in batches:
            out = {"problem": [], "positive": [], "x": []}
            for text, lang, u in zip(b["text"], b["lang"], b["u"]):
                x = features(text)
                if x is None:
                    continue
                own = family_of(lang)
                todo = [(f"family\t{f}", f == own) for f in families if many and u < spread_rows]
                todo += [(f"pair\t{p}\t{q}", p == lang) for p, q in itertools.combinations(families[own], 2) if lang in (p, q)]
                for name, positive in todo:
                    out["problem"].append(name)
                    out["positive"].append(positive)
                    out["x"].append(x.astype("<f4").tobytes())
            yield out

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["positive", "x"])     # the order of arrival doesn't matter
        x = np.stack([np.frombuffer(v, "<f4") for v in pdf["x"]])
        w = train_svm(x, np.where(pdf["positive"], 1.0, -1.0))
        return pd.DataFrame({"problem": [key[0]], "w": [w.tobytes()]})

    rows = (map_batches(sample.select("text", "lang", "u"), problems, "problem string, positive boolean, x binary")
            .groupBy("problem").applyInPandas(solve, "problem string, w binary").collect())
    weights = {r["problem"]: np.frombuffer(r["w"]) for r in rows}
    zero = np.zeros(DIM + 1)
    for f in families:
        weights.setdefault(f"family\t{f}", zero)
        for p, q in itertools.combinations(families[f], 2):
            weights.setdefault(f"pair\t{p}\t{q}", zero)
    return Model(languages, families, weights)


def language(model: Model) -> Column:
    """A function of a text column: ``struct(lang_pred, score)``. The model is
    one vector per SVM: a few dozen kilobytes."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        got = [model.predict(t if isinstance(t, str) else None) for t in text]
        return pd.DataFrame(got, columns=["lang_pred", "score"])

    return predict
