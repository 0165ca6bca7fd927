"""Hidden Markov language model over whole corpora.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; every text ends with
one end token. A token of class ``c`` (hash of the word modulo ``CLASSES``,
the end token has a class of its own) has in state ``s`` the probability
``(E(word, s) + r(c, s)) / Z(s)``:

* ``E`` are the expected counts by word and state, the start vector and the
  transitions those of Baum-Welch. ``PASSES`` passes go over all training
  tokens. The texts lie in blocks, the words in shards (by class). A word that
  one block alone holds keeps its counts beside that block. For the others
  each block sends a shard one packed row a pass, and gets the sums back
  likewise; words are keyed once and numbered since. Counts are held in units
  of ``UNIT``, as integers: sums don't depend on their order, and the total
  weights ``Z`` are those of the rounded counts. The driver receives sums by
  class, ``CLASSES x STATES`` numbers.
  A bounded sample of segments, by classes, gives the first pass its start.
* ``r(c, s)`` is the share of state ``s`` in the expected counts of the class:
  the back-off of rare words. As in the base, all words that training texts
  don't hold are one word; its weight is the share of the state in all counts.
  ``Z`` makes the probabilities of a state add up to 1.

The score is the exact likelihood of the whole sequence by the scaled forward
recursion. Only in training are texts cut into segments of ``SEGMENT`` tokens
(a segment inside a text has a start vector of its own).

Words are known by 64-bit keys (a clash would add two words' counts; at 10^9
distinct words about one is expected for every 40 corpora).

Edge cases: a null text is the empty one, the end token alone; a null id
belongs to the training part; repeated rows are scored, and counted, each;
with no training rows every count is 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import atexit
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, remove, stage

STATES = 8
CLASSES = 32768
SEGMENT = 64
PASSES = 3
#: Tokens of one block of texts (bounds a task's memory; a longer text is a block alone).
BLOCK_TOKENS = 3_000_000
#: Segments that a block offers for the starting point, blocks that are asked, and rounds on them.
SEED_SEGMENTS, SEED_BLOCKS, SEED_ROUNDS = 1500, 12, 40
LOG10 = math.log(10)

#: Unit of expected counts, and (word, block) pairs of one shard (bounds a task's memory).
UNIT = 1 / 256
SHARD_PAIRS, LEAST_SHARDS = 500_000, 16

BLOCK_SCHEMA = ("block bigint, ids binary, null_id binary, held binary, lengths binary, tokens binary, "
                "key array<bigint>, train array<bigint>, seed binary")
END = b""       # stands for the end token; no word is empty
END_KEY = int(np.array([xxhash.xxh64_intdigest(END)], np.uint64).view(np.int64)[0])


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=3).compress(a.reshape(-1, 1).view(np.uint8).T.tobytes())


def unpack(b: bytes, dtype: str = "<u8") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def make_blocks(docs: DataFrame) -> DataFrame:
    """One row per block of texts: tokens as numbers of the block's own words,
    the words' 64-bit keys, and how often each occurs in training texts.
    ``docs``: doc_id, text, held_out."""

    def run(batches):
        part, n = TaskContext.get().partitionId() << 32, 0

        def fresh():
            return {END: 0}, [], [], [], []

        words, ids, held, lengths, tokens = fresh()
        total = 0

        def close():
            nonlocal n, words, ids, held, lengths, tokens, total
            flat = np.concatenate(tokens).astype("<i4")
            size, out = np.array(lengths, "<i8"), np.array(held, bool)
            train = np.bincount(flat[~np.repeat(out, size)], minlength=len(words))
            keys = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)
            starts, lens = segments(np.concatenate(([0], size.cumsum()[:-1])), size, ~out)[:2]
            full = np.flatnonzero(lens == SEGMENT)
            if len(full) > SEED_SEGMENTS:                   # evenly over the block
                full = full[np.linspace(0, len(full) - 1, SEED_SEGMENTS).astype(int)]
            cls = classes_of(keys)
            seed = cls[flat[starts[full][:, None] + np.arange(SEGMENT)]] if len(full) else np.zeros((0, SEGMENT))
            row = {"block": [part + n], "ids": [np.array([i or 0 for i in ids], "<i8").tobytes()],
                   "null_id": [np.array([i is None for i in ids], bool).tobytes()], "held": [out.tobytes()],
                   "lengths": [size.tobytes()], "tokens": [pack(flat)], "key": [keys],
                   "train": [train.astype(np.int64)], "seed": [seed.astype("<i4").tobytes()]}
            words, ids, held, lengths, tokens = fresh()
            n, total = n + 1, 0
            return row

        for b in batches:
            for doc, text, out in zip(b["doc_id"], b["text"], b["held_out"]):
                got = (text or "").encode("utf-8", "surrogatepass").lower().split()
                try:
                    t = [words[w] for w in got]
                except KeyError:
                    for w in got:
                        if w not in words:
                            words[w] = len(words)
                    t = [words[w] for w in got]
                t.append(0)
                ids.append(doc)
                held.append(out)
                lengths.append(len(t))
                tokens.append(np.array(t, "<i4"))
                total += len(t)
                if total >= BLOCK_TOKENS:
                    yield close()
        if ids:
            yield close()

    return map_batches(docs.select("doc_id", "text", "held_out"), run, BLOCK_SCHEMA)


def classes_of(keys: np.ndarray) -> np.ndarray:
    """Class of each word of a block; the first word is the end token."""
    c = (keys.view(np.uint64) % np.uint64(CLASSES)).astype(np.int32)
    c[0] = CLASSES
    return c


def segments(starts: np.ndarray, sizes: np.ndarray, use: np.ndarray):
    """Starts, lengths and 'is the first of its text' of the segments of the texts to use."""
    starts, sizes = starts[use], sizes[use]
    k = (sizes + SEGMENT - 1) // SEGMENT
    doc = np.repeat(np.arange(len(sizes)), k)
    nth = np.arange(len(doc)) - np.repeat(np.concatenate(([0], k.cumsum()[:-1])) if len(k) else k, k)
    return starts[doc] + nth * SEGMENT, np.minimum(SEGMENT, sizes[doc] - nth * SEGMENT), nth == 0


@dataclass
class Params:
    start: np.ndarray        # (2, K): first segment of a text, later segment
    move: np.ndarray         # (K, K)
    emit: np.ndarray         # (CLASSES + 1, K): each column sums to 1, or back-off shares if there is a total
    total: np.ndarray | None = None     # (K,): sum of the weights of all words
    unseen: np.ndarray | None = None    # (K,): weight of the unseen word


def emissions(p: Params, classes: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Emission of each word of a block, from its class and expected counts
    (before the first pass by class: a factor of the word alone is left out)."""
    if p.total is None:
        return p.emit[classes]
    return np.where(e.any(1)[:, None], e + p.emit[classes], p.unseen) / p.total


class Expected:
    """Sums of expected counts."""

    def __init__(self, k: int, n: int = CLASSES + 1):
        self.start, self.move, self.emit = np.zeros((2, k)), np.zeros((k, k)), np.zeros((n, k))

    def add(self, obs: np.ndarray, lens: np.ndarray, first: np.ndarray, p: Params) -> None:
        """Forward and backward recursions over many segments at once.
        ``obs``: (SEGMENT, n) classes by time, segments longest first."""
        steps, n = obs.shape
        k = p.move.shape[0]
        active = [int(np.searchsorted(-lens, -t, side="left")) for t in range(steps + 1)]    # segments longer than t
        move, emit = p.move.astype(np.float32), p.emit.astype(np.float32)
        start = p.start.astype(np.float32)[np.where(first, 0, 1)]
        e = emit[obs]
        alpha = np.zeros((steps, n, k), np.float32)
        scale = np.ones((steps, n), np.float32)
        for t in range(steps):
            m = active[t]
            a = (start if t == 0 else alpha[t - 1, :m] @ move) * e[t, :m]
            scale[t, :m] = c = np.maximum(a.sum(1), 1e-30)
            alpha[t, :m] = a / c[:, None]
        beta = np.ones((n, k), np.float32)
        xi = np.zeros((k, k))
        gamma = np.zeros_like(alpha)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            gamma[t, :m] = alpha[t, :m] * beta[:m]
            if t:
                back = e[t, :m] * beta[:m] / scale[t, :m, None]
                xi += alpha[t - 1, :m].T @ back
                beta[:m] = back @ move.T
        self.move += xi * move
        np.add.at(self.start, np.where(first, 0, 1), gamma[0])
        flat = obs.ravel()
        for s in range(k):
            self.emit[:, s] += np.bincount(flat, weights=gamma[:, :, s].ravel(), minlength=len(self.emit))


def maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Params:
    """Smoothed re-estimates. A class's unseen share follows its overall count."""
    total = emit.sum(1)
    prior = (total + 0.5) / (total + 0.5).sum()
    emit = emit + (0.02 * emit.sum(0, keepdims=True) + 1) * prior[:, None]
    move, start = move + 0.1, start + 0.1
    return Params(start / start.sum(1, keepdims=True), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def starting_point(seed: np.ndarray, k: int = STATES, rounds: int = SEED_ROUNDS) -> Params:
    """From sample segments (n, SEGMENT): group them by their class counts
    (k-means on the unit sphere, spread-out first centres), then Baum-Welch."""
    rng = np.random.default_rng(0)
    n = len(seed)
    if n < k:
        emit = np.ones((CLASSES + 1, k)) + rng.random((CLASSES + 1, k))
        return maximise(np.ones((2, k)), np.eye(k) * k * 9 + 1, emit)
    dims = 2048
    x = np.zeros((n, dims), np.float32)
    np.add.at(x, (np.arange(n)[:, None], seed % dims), 1)
    x = np.sqrt(x)
    x *= np.log(n / np.maximum((x > 0).sum(0), 1)).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    pick, near = [0], x @ x[0]
    for _ in range(k - 1):
        pick.append(int(near.argmin()))
        near = np.maximum(near, x @ x[pick[-1]])
    centre = x[pick]
    for _ in range(15):
        own = (x @ centre.T).argmax(1)
        centre = np.stack([x[own == s].sum(0) if (own == s).any() else x[rng.integers(n)] for s in range(k)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    emit = np.stack([np.bincount(seed[own == s].ravel(), minlength=CLASSES + 1) for s in range(k)], axis=1).astype(float)
    p = maximise(np.ones((2, k)), np.eye(k) * 50 + 1, emit)
    lens, first = np.full(n, SEGMENT), np.zeros(n, bool)
    for _ in range(rounds):
        e = Expected(k)
        for i in range(0, n, 2048):
            e.add(seed[i:i + 2048].T, lens[i:i + 2048], first[i:i + 2048], p)
        e.start[0] = e.start[1]
        p = maximise(e.start, e.move, e.emit)
    return p


def maximise_words(start: np.ndarray, move: np.ndarray, by_class: np.ndarray, words: np.ndarray) -> Params:
    """Re-estimates from sums of expected counts; ``by_class``: (CLASSES + 1, K),
    ``words``: training words of each class."""
    unseen = by_class.sum(0) + 0.5
    unseen /= unseen.sum()
    back = by_class + unseen
    back /= back.sum(1, keepdims=True)
    move, start = move + 0.1, start + 0.1
    return Params(start / start.sum(1, keepdims=True), move / move.sum(1, keepdims=True), back,
                  by_class.sum(0) + words @ back + unseen, unseen)


def layout(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a block's words by shard and key, and where each shard
    begins. The shard of a word is its class modulo ``shards``."""
    shard = classes_of(keys) % shards
    order = np.lexsort((keys, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def meet(blocks: DataFrame, shards: int) -> DataFrame:
    """The blocks' words meet in their shards. A row with ``of_block`` tells a
    block which of its words (in the order of ``layout``) are shared: held by
    other blocks too, and by training texts; their numbers in the shard and
    training counts. A row without has the shard's sums: training tokens,
    distinct words, and distinct words of each class."""

    def offer(batches):
        for b in batches:
            for block, key, count in zip(b["block"], b["key"], b["train"]):
                keys, count = np.asarray(key, np.int64), np.asarray(count, np.int64)
                order, at = layout(keys, shards)
                used = [j for j in range(shards) if at[j] < at[j + 1]]
                of = [order[at[j]:at[j + 1]] for j in used]
                yield {"block": [block] * len(used), "shard": used,
                       "key": [pack(np.diff(keys[o], prepend=0)) for o in of], "train": [pack(count[o]) for o in of]}

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        keys = [unpack(k, "<i8").cumsum() for k in rows["key"]]
        ends = np.cumsum([len(k) for k in keys])
        words, nth = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(nth, weights=np.concatenate([unpack(t, "<i8") for t in rows["train"]])).astype(np.int64)
        shared = (np.bincount(nth) > 1) & (count > 0)
        number = shared.cumsum() - 1
        out = []
        for block, end, k in zip(rows["block"], ends, keys):
            mine = nth[end - len(k):end]
            both = mine[shared[mine]]
            out.append((block, shard, np.packbits(shared[mine]).tobytes(), pack(np.diff(number[both], prepend=0)),
                        pack(count[both]), None, None, None))
        known = words[count > 0]
        cls = np.where(known == END_KEY, CLASSES, known.view(np.uint64) % np.uint64(CLASSES)).astype(np.int64)
        out.append((None, shard, None, None, None, int(count.sum()), len(known),
                    np.bincount(cls // shards, minlength=len(range(shard, CLASSES + 1, shards))).tolist()))
        return pd.DataFrame(out, columns=["of_block", "shard", "flags", "number", "count", "total", "distinct", "by_class"]).astype(
            {"of_block": "Int64", "total": "Int64", "distinct": "Int64"})

    return (map_batches(blocks.select("block", "key", "train"), offer, "block bigint, shard int, key binary, train binary")
            .groupBy("shard").applyInPandas(answer, "of_block bigint, shard int, flags binary, number binary, count binary, "
                                                    "total bigint, distinct bigint, by_class array<bigint>"))


class Known:
    """What a block knows of its words, from the rows it was sent."""

    def __init__(self, keys: np.ndarray, rows: pd.DataFrame, shards: int, k: int):
        self.order, self.at = layout(keys, shards)
        self.shared, self.number = np.zeros(len(keys), bool), {}
        self.count, self.e = np.zeros(len(keys), np.int64), np.zeros((len(keys), k))
        told = rows["flags"].notna()
        for shard, flags, number, count in rows.loc[told, ["shard", "flags", "number", "count"]].itertuples(index=False):
            pos = self.order[self.at[shard]:self.at[shard + 1]]
            self.shared[pos] = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(pos)).astype(bool)
            self.number[shard] = number
            self.count[self.of(shard)] = unpack(count)
        for shard, e in rows.loc[rows["e"].notna(), ["shard", "e"]].itertuples(index=False):
            self.e[self.of(shard)] = unpack(e).reshape(k, -1).T * UNIT

    def of(self, shard: int) -> np.ndarray:
        """Positions of the shared words of a shard; of the block's own words for -1."""
        if shard < 0:
            return self.order[~self.shared[self.order]]
        pos = self.order[self.at[shard]:self.at[shard + 1]]
        return pos[self.shared[pos]]


def expectation(blocks: DataFrame, p: Params, known: DataFrame, shards: int) -> DataFrame:
    """Expected counts of all training texts under ``p``. ``known``: the rows
    of ``meet`` for blocks, and with ``e`` those of the pass before. A row of
    shard -1 has the counts of the words of one block alone, and the start
    vectors and transitions as one array; the others the counts of shared words
    by number, and the sums of all words by class."""
    k = p.move.shape[0]

    def of_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        size, keys, flat = np.frombuffer(r["lengths"], "<i8"), np.asarray(r["key"], np.int64), unpack(r["tokens"], "<i4")
        words, cls, e = Known(keys, right, shards, k), classes_of(keys), Expected(k, len(keys))
        q = Params(p.start, p.move, emissions(p, cls, words.e))
        starts, lens, first = segments(np.concatenate(([0], size.cumsum()[:-1])), size, ~np.frombuffer(r["held"], bool))
        order = np.argsort(-lens, kind="stable")
        for i in range(0, len(order), 4096):
            o = order[i:i + 4096]
            at = starts[o][None, :] + np.arange(lens[o[0]])[:, None]
            e.add(flat[np.minimum(at, len(flat) - 1)], lens[o], first[o], q)
        units = np.rint(e.emit / UNIT).astype(np.uint64)
        by_class = np.stack([np.bincount(cls, weights=units[:, j], minlength=CLASSES + 1) for j in range(k)], axis=1).astype(np.uint64)
        sums = np.concatenate([e.start.ravel(), e.move.ravel()]).tolist()
        out = [(r["block"], -1, None, pack(units[words.of(-1)].T), None, sums)]
        for shard in range(shards):
            part = by_class[shard::shards]
            if shard in words.number or part.any():
                out.append((r["block"], shard, words.number.get(shard), pack(units[words.of(shard)].T), pack(part), None))
        return pd.DataFrame(out, columns=["of_block", "shard", "number", "e", "by_class", "sums"])

    return (blocks.select("block", "held", "lengths", "tokens", "key").groupBy("block").cogroup(known.groupBy("of_block"))
            .applyInPandas(of_block, "of_block bigint, shard int, number binary, e binary, by_class binary, sums array<double>"))


def add_up(found: DataFrame, k: int) -> DataFrame:
    """Sums of the shared words, sent back to the blocks; a row without
    ``of_block`` has the shard's sums by class."""

    def of_shard(rows: pd.DataFrame) -> pd.DataFrame:
        numbers = [unpack(n).cumsum() if n is not None else np.zeros(0, np.uint64) for n in rows["number"]]
        total = np.zeros((1 + max((int(n[-1]) for n in numbers if len(n)), default=-1), k), np.uint64)
        by_class = np.zeros(1, np.uint64)
        for n, e, part in zip(numbers, rows["e"], rows["by_class"]):
            total[n.astype(np.int64)] += unpack(e).reshape(k, -1).T
            by_class = by_class + unpack(part)
        shard = int(rows["shard"].iloc[0])
        out = [(block, shard, pack(total[n.astype(np.int64)].T), None) for block, n in zip(rows["of_block"], numbers) if len(n)]
        return pd.DataFrame([*out, (None, shard, None, pack(by_class))], columns=["of_block", "shard", "e", "by_class"]).astype(
            {"of_block": "Int64"})

    return found.filter("shard >= 0").groupBy("shard").applyInPandas(of_shard, "of_block bigint, shard int, e binary, by_class binary")


def train(blocks: DataFrame, told: DataFrame, v: np.ndarray, shards: int, folder: str, states: int = STATES,
          passes: int = PASSES) -> tuple[Params, DataFrame]:
    """Parameters, and what the blocks know of their words. ``told``: the
    rows of ``meet`` for blocks, ``v``: training words of each class."""
    chosen = [r["block"] for r in blocks.select("block").orderBy(F.xxhash64("block")).limit(SEED_BLOCKS).collect()]
    rows = blocks.filter(F.col("block").isin(chosen)).orderBy("block").select("seed").collect()
    seed = np.concatenate([np.frombuffer(r["seed"], "<i4") for r in rows] or [np.zeros(0, "<i4")]).reshape(-1, SEGMENT)
    p, known = starting_point(seed, states), told.withColumn("e", F.lit(None).cast("binary"))
    for n in range(passes):
        found = stage(expectation(blocks, p, known, shards), folder, f"found-{n}")
        totals = stage(add_up(found, states), folder, f"totals-{n}")
        if n:
            remove(blocks.sparkSession, f"{folder}/found-{n - 1}")
            remove(blocks.sparkSession, f"{folder}/totals-{n - 1}")
        by_class = np.zeros((CLASSES + 1, states))
        for r in totals.filter("of_block IS NULL").collect():
            by_class[r["shard"]::shards] = unpack(r["by_class"]).reshape(-1, states) * UNIT
        sums = np.zeros((2 + states) * states)
        for r in found.filter("shard < 0").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("x")).collect():
            sums[r["pos"]] = r["x"]
        sums = sums.reshape(-1, states)
        p = maximise_words(sums[:2], sums[2:], by_class, v)
        known = told.unionByName(
            totals.filter("of_block IS NOT NULL").drop("by_class").unionByName(found.filter("shard < 0").select("of_block", "shard", "e")),
            allowMissingColumns=True)
    return p, known


def log_forward(obs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p: Params) -> np.ndarray:
    """Natural log-likelihood of each text (classes ``obs[start:start+size]``):
    scaled forward recursion, all texts of the block side by side."""
    order = np.argsort(-sizes, kind="stable")
    s, n, out = starts[order], sizes[order], np.zeros(len(sizes))
    a = p.emit[obs[s]] * p.start[0]
    c = a.sum(1)
    a /= c[:, None]
    logs = np.log(c)
    m = len(s)
    for t in range(1, int(n[0])):
        while n[m - 1] <= t:
            m -= 1
        a = (a[:m] @ p.move) * p.emit[obs[s[:m] + t]]
        c = a.sum(1)
        a /= c[:, None]
        logs[:m] += np.log(c)
    out[order] = logs
    return out


def _forget(spark, name: str) -> None:
    """Drop the catalog's entry of the blocks at exit; their folder is removed by ``scratch``."""
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception as e:  # noqa: BLE001
        print(f"table {name} not dropped: {type(e).__name__}")


def score(docs: DataFrame, folder: str, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    for every row of ``docs`` (doc_id, text, held_out); learns from the rows
    that are not held out. ``base_score`` is the add-one unigram model."""
    spark, name = docs.sparkSession, f"llm_blocks_{uuid.uuid4().hex}"
    # Bucketed, so that no pass shuffles the blocks.
    (make_blocks(docs).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortBy("block")
     .option("path", f"{folder}/blocks").format("parquet").saveAsTable(name))
    atexit.register(_forget, spark, name)
    blocks = spark.table(name)
    pairs, shards = blocks.agg(F.sum(F.size("key"))).first()[0] or 0, LEAST_SHARDS
    while shards < CLASSES and pairs > shards * SHARD_PAIRS:
        shards *= 2
    words = stage(meet(blocks, shards), folder, "words")
    total, distinct, v = 0, 0, np.zeros(CLASSES + 1)
    for r in words.filter("of_block IS NULL").select("shard", "total", "distinct", "by_class").collect():
        total, distinct, v[r["shard"]::shards] = total + r["total"], distinct + r["distinct"], r["by_class"]
    p, known = train(blocks, words.filter("of_block IS NOT NULL").drop("total", "distinct", "by_class"), v, shards, folder, states, passes)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        keys = np.asarray(r["key"], np.int64)
        mine = Known(keys, right, shards, states)
        c, e = np.where(mine.shared, mine.count, r["train"]), mine.e
        tokens, sizes = unpack(r["tokens"], "<i4"), np.frombuffer(r["lengths"], "<i8")
        starts = np.concatenate(([0], sizes.cumsum()[:-1]))
        base = np.log10((c + 1) / (total + distinct + 1))
        both = np.add.reduceat(np.stack([base, c > 0], axis=1)[tokens], starts, axis=0)
        q = Params(p.start, p.move, emissions(p, classes_of(keys), e))
        ids = pd.Series(np.frombuffer(r["ids"], "<i8")).astype("Int64")
        ids[np.frombuffer(r["null_id"], bool)] = pd.NA
        return pd.DataFrame({
            "doc_id": ids, "held_out": np.frombuffer(r["held"], bool), "n_tokens": sizes,
            "n_known": both[:, 1].astype(np.int64), "train_tokens": total, "base_score": both[:, 0],
            "score": log_forward(tokens, starts, sizes, q) / LOG10})

    return (blocks.drop("seed").groupBy("block").cogroup(known.groupBy("of_block")).applyInPandas(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                "base_score double, score double"))
