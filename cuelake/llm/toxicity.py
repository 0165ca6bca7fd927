"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained: one on windows of ordinary text, one on the
words that set toxic texts apart (by the number of distinct words before them). Each window of a
text is compressed with the ordinary dictionary and with both together; the
bytes that the toxic dictionary saves are the window's evidence. A logistic
curve over the text's evidence, fitted on sample rows that trained no
dictionary, gives a score in 0..1; 0.3 is the decision threshold.

Fit sample: about ``SAMPLE_TOXIC`` toxic and ``SAMPLE_ORDINARY`` ordinary
labelled documents of up to ``SAMPLE_CHARS`` characters, chosen by a hash.
Scoring reads every window of every text.

Edge cases: a null or empty text has no evidence and gets the curve's lowest
value; without labelled rows of both classes every score is 0; repeated rows
and null ids stay as they are; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WINDOW = 128
THRESHOLD = 0.3
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1500, 4500, 60_000
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
#: A word is typical of toxic texts if it follows so many different words there, and so many times as often as in ordinary ones.
MIN_TEXTS, MIN_RATIO = 8, 10.0

_SEARCH = {"window_log": 17, "hash_log": 14, "chain_log": 14, "search_log": 5, "min_match": 4, "target_length": 32,
           "strategy": zstandard.STRATEGY_BTLAZY2, "write_content_size": False, "write_dict_id": False}
_NOT_WORD = re.compile(r"[^\w]+")


def windows(text: str | None) -> list[bytes]:
    """Lower-case words with single blanks, cut at blanks after ``WINDOW`` bytes."""
    b = (" " + _NOT_WORD.sub(" ", (text or "").lower()).strip() + " ").encode("utf-8", "surrogatepass")
    out, i = [], 0
    while i < len(b) - 1:
        j = b.find(b" ", i + WINDOW) + 1 if i + WINDOW < len(b) else len(b)
        j = min(j or len(b), i + 2 * WINDOW)           # a word longer than a window is cut
        out.append(b[i:j])
        i = j - (b[j - 1:j] == b" " and j < len(b))    # the next window starts with that blank
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    curve: tuple[float, ...]

    def __post_init__(self):
        self._with = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "curve": self.curve, "_with": None}

    def evidence(self, text: str | None) -> np.ndarray:
        """Mean saving per window, share of windows that save 3 bytes or more,
        mean of the three best windows, and log of the number of windows."""
        if self._with is None:
            def of(b):
                return zstandard.ZstdCompressor(
                    dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                    compression_params=zstandard.ZstdCompressionParameters(**_SEARCH)).compress
            self._with = of(self.ordinary), of(self.toxic + self.ordinary)
        plain, both = self._with
        d = np.array([len(plain(w)) - len(both(w)) for w in windows(text)], dtype=float)
        if not len(d):
            return np.zeros(4)
        return np.array([d.mean(), (d >= 3).mean(), np.sort(d)[-3:].mean(), np.log1p(len(d))])

    def score(self, text: str | None) -> float:
        if not self.curve:
            return 0.0
        e = self.evidence(text)
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + e @ np.array(self.curve[1:]), -30, 30))))


def train_dictionary(samples: list[bytes], size: int, **how) -> bytes:
    """A zstandard dictionary; too few samples give their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_texts(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Dictionaries from two thirds of the distinct texts, the curve from the rest."""
    if len(set(toxic.tolist())) < 2:
        return Model(b"", b"", ())
    part = np.arange(len(texts)) % 3
    learn = [set(), set()]
    for t, y, p in zip(texts, toxic, part):
        if p < 2:
            learn[int(y)].add(t)
    # Near copies repeat a word behind the same word, so distinct predecessors are counted, not texts.
    of = [Counter(), Counter()]
    for y in (0, 1):
        pairs = set()
        for t in learn[y]:
            w = _NOT_WORD.sub(" ", t.lower()).split()
            pairs.update(zip([""] + w, w))
        of[y].update(w for _, w in pairs)
    n0, n1 = max(1, len(learn[0])), max(1, len(learn[1]))
    least = max(2, min(MIN_TEXTS, n1 // 20))
    typical = {w for w, c in of[1].items() if c >= least and len(w) > 2 and c / n1 >= MIN_RATIO * (of[0][w] + 1) / n0}
    found = [w for t in sorted(learn[1]) for w in _NOT_WORD.sub(" ", t.lower()).split() if w in typical]
    rng = np.random.default_rng(0)
    rng.shuffle(found)
    lines = [(" " + " ".join(found[i:i + 8]) + " ").encode() for i in range(0, len(found), 8)]
    ordinary = [w for t in sorted(learn[0])[:3000] for w in windows(t)]
    ordinary = [ordinary[i] for i in rng.permutation(len(ordinary))[:8000]]
    model = Model(train_dictionary(ordinary, ORDINARY_BYTES), train_dictionary(lines, TOXIC_BYTES, k=32, d=6), ())
    rest = part == 2 if len(set(toxic[part == 2].tolist())) == 2 else part >= 0
    x = np.array([model.evidence(t) for t, r in zip(texts, rest) if r])
    model.curve = tuple(logistic(x, toxic[rest].astype(float), weight[rest]).tolist())
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), 1e-3 * weight.sum() * np.eye(x.shape[1])
    ridge[0, 0] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge,
                                x.T @ (weight * (p - y)) + ridge @ w)
    return w


def _unit(crc: Column) -> Column:
    """A row's place in 0..1, by its id and the checksum of its text."""
    return F.pmod(F.xxhash64("doc_id", crc), F.lit(1 << 30)) / float(1 << 30)


def _shares(rows: DataFrame, toxic_rows: int, ordinary_rows: int) -> dict[int, float]:
    """Per label, the share of its rows that the sample takes."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return {y: min(1.0, cap / n.get(y, 1)) for y, cap in ((0, ordinary_rows), (1, toxic_rows))}


def _taken(rows: DataFrame, share: dict[int, float]) -> DataFrame:
    return rows.filter(F.col("u") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))


def _train(sample: DataFrame, share: dict[int, float]) -> Model:
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "text"])
        y = pdf["toxic"].to_numpy()
        m = fit_texts(pdf["text"].tolist(), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
        return pd.DataFrame({"ordinary": [m.ordinary], "toxic": [m.toxic], "curve": [list(m.curve)]})

    got = (sample.select("text", "toxic", "u").withColumn("all", F.lit(0)).groupBy("all")
           .applyInPandas(solve, "ordinary binary, toxic binary, curve array<double>").collect())
    return Model(bytes(got[0]["ordinary"]), bytes(got[0]["toxic"]), tuple(got[0]["curve"])) if got else Model(b"", b"", ())


_USABLE = f"char_length(text) BETWEEN 1 AND {SAMPLE_CHARS}"


def fit(labelled: DataFrame, toxic_rows: int = SAMPLE_TOXIC, ordinary_rows: int = SAMPLE_ORDINARY) -> Model:
    """Model from ``labelled`` (doc_id, text, toxic). One task trains on the
    bounded sample; the driver receives two dictionaries and five numbers."""
    rows = labelled.filter("toxic IN (0, 1)").filter(_USABLE).select(
        "doc_id", "text", "toxic", _unit(F.crc32(F.col("text").cast("binary"))).alias("u"))
    share = _shares(rows, toxic_rows, ordinary_rows)
    return _train(_taken(rows, share), share)


def fit_joined(docs: DataFrame, labels: DataFrame, folder: str, toxic_rows: int = SAMPLE_TOXIC,
               ordinary_rows: int = SAMPLE_ORDINARY) -> Model:
    """``fit`` for labels in a table of their own: ``docs`` (doc_id, text) and
    ``labels`` (doc_id, toxic). Ids and checksums meet the labels; the chosen
    ones are written below ``folder``, and only their texts are fetched. The
    written table's size is known to Spark, which broadcasts it below its
    threshold and shuffles beyond. Rows repeated in full train once."""
    rows = docs.filter(_USABLE).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc")).join(
        labels.filter("toxic IN (0, 1)").select("doc_id", "toxic"), "doc_id").distinct().withColumn("u", _unit(F.col("crc")))
    share = _shares(rows, toxic_rows, ordinary_rows)
    chosen = stage(_taken(rows, share), folder, "toxicity-sample")
    texts = docs.filter(_USABLE).select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("crc"))
    return _train(texts.join(chosen, ["doc_id", "crc"]).dropDuplicates(["doc_id", "crc", "toxic"]), share)


def toxicity(model: Model) -> Column:
    """A function of a text column: score, DOUBLE. The model is twenty kilobytes."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t if isinstance(t, str) else None) for t in text], dtype=float)

    return score
