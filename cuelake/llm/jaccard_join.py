"""Near-duplicate join on word shingles: MinHash candidates, Bayesian pruning,
exact verification.

Two texts are linked if the Jaccard similarity of their sets of ``WORDS``-word
shingles is ``THRESHOLD`` or more. Equal sets are one class from the start.

1. Each text gets 128 MinHash values in 32 bands of four. A linked pair shares
   no band with probability below 5e-8.
2. Texts that share a band with another go to blocks: a text's home is the
   least text that it shares a band with, and a home of many texts is salted
   into blocks of about ``BLOCK`` texts or ``BLOCK_BYTES`` of shingles. A block
   is packed into one row. Two blocks form a unit if a band occurs in both;
   every pair of texts belongs to one unit at most, and a unit is one row that
   holds both blocks: texts are never repeated row by row.
3. In a unit, the pairs that share a band are compared 16 MinHash values at a
   time. A pair goes as soon as the posterior probability (uniform prior) of
   reaching the threshold is below ``TOLERANCE``; the rest is verified on the
   whole shingle sets. A unit gives one row per text: links counted, and the
   least text of its local component; no list of pairs is ever made.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of one to four
words is one shingle; a text without words (null, empty) is linked with
nothing. Shingles are known by 64-bit hashes. Repeated rows are one class;
a null doc_id is a row like any other; an empty table gives no rows; other
columns stay if the caller asks for them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, stage

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16               # MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK = 256
BLOCK_BYTES = 4 << 20

_RNG = np.random.default_rng(20)
_MUL = (_RNG.integers(0, 2**32, (HASHES, 1), dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, (HASHES, 1), dtype=np.uint64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = np.array(list(map(xxhash.xxh64_intdigest, (text or "").encode("utf-8", "surrogatepass").lower().split())), dtype=np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    g = w[:n]
    for k in range(1, min(words, len(w))):
        g = (g ^ (g >> np.uint64(29))) * _P + w[k:n + k]
    g = (g ^ (g >> np.uint64(32))) * _Q
    return np.unique(g ^ (g >> np.uint64(29)))


def minhash(grams: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (_MUL * low[i:i + 4096] + _ADD).min(axis=1), out=out)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    s = signature.reshape(BANDS, ROWS).astype(np.uint64)
    k = np.arange(1, BANDS + 1, dtype=np.uint64) * _Q
    for j in range(ROWS):
        k = (k ^ (k >> np.uint64(31)) ^ s[:, j]) * _P
    return (k ^ (k >> np.uint64(29))).view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values the least number of matches at which a pair stays:
    the posterior of the similarity is Beta(m + 1, n - m + 1)."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:            # P(Beta >= t) = P(Binomial(n + 1, t) <= m)
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _sketch(batches):
    for b in batches:
        out = {"_rid": b["_rid"], "digest": [], "keys": []}
        for text in b["text"]:
            g = shingles(text)
            out["digest"].append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
            out["keys"].append(bands(minhash(g)) if len(g) else [])
        yield out


def _sets(batches):
    for b in batches:
        out, size = {"rep": [], "copies": [], "sig": [], "grams": []}, 0
        for rid, copies, text in zip(b["_rid"], b["copies"], b["text"]):
            g = shingles(text)
            for k, v in (("rep", rid), ("copies", copies), ("sig", minhash(g).tobytes()), ("grams", g.tobytes())):
                out[k].append(v)
            size += g.nbytes
            if size > 16 << 20:
                yield out
                out, size = {k: [] for k in out}, 0
        if out["rep"]:
            yield out


def unit_links(sig_a, sig_b, keys_a, keys_b, sets_a, sets_b, same: bool, threshold: float, least: dict[int, int]):
    """Index pairs of linked texts of two blocks (of one, if ``same``)."""
    hit = np.zeros((len(sig_a), len(sig_b)), bool)
    for k in range(BANDS):
        hit |= keys_a[:, k, None] == keys_b[None, :, k]
    i, j = np.nonzero(np.triu(hit, 1) if same else hit)
    m = np.zeros(len(i), np.int32)
    for n in range(0, HASHES, STEP):
        m += (sig_a[i, n:n + STEP] == sig_b[j, n:n + STEP]).sum(1)
        stay = m >= least[n + STEP]
        i, j, m = i[stay], j[stay], m[stay]
    keep = np.zeros(len(i), bool)
    cut = np.flatnonzero(np.diff(i, prepend=-1)).tolist() + [len(i)]
    for lo, hi in zip(cut, cut[1:]):                  # one left text against all its partners
        a = sets_a[i[lo]]
        for s in range(lo, hi, 64):
            part = [sets_b[q] for q in j[s:min(s + 64, hi)]]
            size = np.array([len(p) for p in part])
            flat = np.concatenate(part)
            at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
            both = np.add.reduceat(a[at] == flat, np.concatenate(([0], size.cumsum()[:-1])))
            keep[s:s + len(part)] = both >= threshold * (len(a) + size - both) - 1e-9
    return i[keep], j[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Union-find: a root for each of n nodes."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


PACKED = "block bigint, rep binary, copies binary, sig binary, sizes binary, grams binary"


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The texts of a block as one row, by ``rep``."""
    pdf = pdf.sort_values("rep")
    return pd.DataFrame({
        "block": [key[0]], "rep": [pdf["rep"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()],
        "sig": [b"".join(pdf["sig"])], "sizes": [np.array([len(g) // 8 for g in pdf["grams"]], np.int64).tobytes()],
        "grams": [b"".join(pdf["grams"])]})


def _unpack(row: dict, end: str = "") -> tuple:
    rep, copies, sizes = (np.frombuffer(row[c + end], np.int64) for c in ("rep", "copies", "sizes"))
    sig = np.frombuffer(row["sig" + end], np.uint32).reshape(len(rep), HASHES)
    return rep, copies, sig, np.stack([bands(x) for x in sig]), np.split(np.frombuffer(row["grams" + end], np.uint64), sizes.cumsum()[:-1])


def _verifier(threshold: float):
    """Units (a packed block, and another one or nulls) to one row per linked text."""
    least = least_matches(threshold)

    def verify(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                rep, copies, sig, keys, sets = left = _unpack(row)
                same = row["rep_2"] is None
                rep_b, copies_b, sig_b, keys_b, sets_b = left if same else _unpack(row, "_2")
                i, j = unit_links(sig, sig_b, keys, keys_b, sets, sets_b, same, threshold, least)
                if not same:
                    j = j + len(rep)
                    rep, copies = np.concatenate((rep, rep_b)), np.concatenate((copies, copies_b))
                links = np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
                root = np.array(roots(len(rep), i, j))
                low = pd.Series(rep).groupby(root).transform("min").to_numpy()
                some = links > 0
                yield pa.record_batch([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(low[some])],
                                      names=["rep", "links", "root"])

    return verify


def join(docs: DataFrame, folder: str, threshold: float = THRESHOLD, block: int = BLOCK,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) as struct ``row`` next to
    ``doc_id``, ``class_id`` (least doc_id of the class), ``n_links`` (other
    rows whose text is linked with the row's) and ``kept`` (one row per class).
    """
    rows = stage(docs.select(F.struct("*").alias("row")).withColumn("_rid", F.monotonically_increasing_id()), folder, "rows")
    rows = rows.select("_rid", "row", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"))
    sketch = stage(map_batches(rows.select("_rid", "text"), _sketch, "_rid bigint, digest binary, keys array<bigint>"),
                   folder, "sketch")
    ids = rows.select("_rid", "doc_id").join(sketch.select("_rid", "digest"), "_rid")
    classes = stage(ids.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("_rid").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least")), folder, "classes")
    # Bands of one text per class; then only bands that two texts share.
    keyed = (sketch.join(classes.select(F.col("rep").alias("_rid")), "_rid")
             .select(F.col("_rid").alias("rep"), F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    hits = stage(keyed.join(shared, "key"), folder, "hits")
    home = hits.groupBy("rep").agg(F.min("lead").alias("home"))
    home = stage(home, folder, "homes")
    # A shingle has 8 bytes and a word about six characters with its blank.
    size = rows.select(F.col("_rid").alias("rep"), (HASHES * 4 + F.length("text") * 4 / 3).alias("bytes"))
    parts = home.join(size, "rep").groupBy("home").agg(
        F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)).alias("parts"))
    blocks = stage(home.join(parts, "home").select(
        "rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), "parts")).alias("block")), folder, "blocks")
    at = hits.join(blocks, "rep").select("key", "block").distinct()
    at = stage(at, folder, "band-blocks")
    pairs = (at.join(at.select("key", F.col("block").alias("other")), "key").filter("block < other")
             .select("block", "other").distinct())
    texts = (rows.select("_rid", "text").join(
        blocks.join(classes, "rep").select(F.col("rep").alias("_rid"), "copies"), "_rid"))
    sets = map_batches(texts.select("_rid", "copies", "text"), _sets, "rep bigint, copies bigint, sig binary, grams binary")
    packed = stage(sets.join(blocks, "rep").groupBy("block").applyInPandas(_pack, PACKED), folder, "packed")
    second = packed.select(F.col("block").alias("other"), *[F.col(c).alias(f"{c}_2") for c in packed.columns[1:]])
    none = [F.lit(None).cast("binary").alias(c) for c in second.columns[1:]]
    units = (packed.join(stage(pairs, folder, "units"), "block").join(second, "other").drop("block", "other")
             .union(packed.filter(F.length("rep") > 8).select(*packed.columns[1:], *none)))
    found = stage(units.mapInArrow(_verifier(threshold), "rep bigint, links bigint, root bigint"), folder, "links")
    comp = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), folder)
    per_class = (classes.join(found.groupBy(F.col("rep").alias("id")).agg(F.sum("links").alias("links")),
                              F.col("rep") == F.col("id"), "left").drop("id")
                 .join(comp, F.col("rep") == F.col("id"), "left")
                 .select("digest", F.coalesce("component", "rep").alias("class"), "least",
                         (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    per_class = stage(per_class, folder, "per-class")
    low = per_class.groupBy("class").agg(F.min("least").alias("class_id"))
    per_class = per_class.drop("least").join(low, "class")
    return (rows.join(sketch.select("_rid", "digest"), "_rid").join(per_class, "digest", "left").select(
        "row", "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.coalesce("class", "_rid") == F.col("_rid")).alias("kept")))
