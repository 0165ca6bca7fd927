"""Phrase collocation mining on a weighted de Bruijn graph, per language.

A node is a phrase of N-1 words, an edge the phrase of N words that leads
from its first N-1 words to its last N-1; its weight is how often it occurs.
Only the longest phrase that begins at each word is counted: N words, or
fewer where the piece ends before. All shorter counts follow from the graph:
what passes through a phrase of k words is the flow of its extensions by one
word, plus the phrases of k words that a piece end cut short.

An exact filter keeps the counted phrases few. A first pass adds up the
numbers of all phrases of 1 to N words by hash bucket; what is in a bucket
whose sum is under ``least`` occurs less than ``least`` times, and so does
every phrase that holds it. Before the word that would make such a phrase the
second pass ends the phrase as at a piece end, and it counts such words
together, without their names. Flows of all other phrases stay exact, and
none of these can be a candidate or a part of one. The filter is a bitmap of
``2 ** bits`` bits (32 MB), whatever the corpus; a fuller one passes more
phrases and changes no result. The sums travel packed: a row holds the sorted
buckets of one range as gaps, with their numbers, in about two bytes each.

Edges of at least ``least`` form the graph that is compacted: a node whose
whole flow comes in by one edge and leaves by one is merged with them. The
paths, found by pointer jumping, share one weight; their inner nodes are
contained in a phrase as frequent as they are, so all of them drop out at
once. A path is part of one piece, so it is no longer than the longest piece.

Candidates have 2 to N words. A candidate is dropped if a longer one that
holds it occurs at least ``percent`` percent as often; one word more is
enough to look at, as counts fall with length. The score is that of the
worst cut in two, in exact decimals.

Hot phrases are summed before every shuffle; a language is ranked in shares
first, and only the ``top`` of each share meet.

Edge cases: null texts have no words; null languages count as ``und``; words
are any characters but blanks and piece ends; long texts and pieces are read
whole; repeated rows count as often as they occur; ties of the score go by
count, then phrase (bytes), those of cuts to the shortest first part; a
language without candidates, or an empty table, gives no rows; columns of
clashing names are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, stage

MAX_WORDS = 3
LEAST = 10
PERCENT = 50
TOP = 2000
SHARES = 32
BITS = 28
#: Buckets (2 ** LINE of them) whose sums travel in one row, and occurrences that a task adds up before it sends them.
LINE = 14
HELD = 1 << 23
#: Bytes of text that are worked on at once (a longer text is one block).
BLOCK = 1 << 19

# Byte classes: 0 part of a word, 1 blank, 2 end of a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64)))) for b in (_BASE, _INVERSE))


class Words:
    """The words of texts: ``data`` holds them joined by single spaces,
    ``begin`` and ``end`` are their places in it, ``piece`` numbers pieces."""

    def __init__(self, texts: list[str]):
        raw = _LOWER[np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)]
        kind = _CLASS[raw]
        word = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[edge[::2]]
        word[edge[1::2]] = True                 # one separator after each word
        raw[edge[1::2]] = 0x20
        self.data = raw[word]
        size = edge[1::2] - edge[::2]
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size

    def hashes(self, powers) -> np.ndarray:
        """A hash of each word: equal words have equal hashes."""
        power, inverse = powers
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data + np.uint64(1)) * power[:len(self.data)])))
        h = (total[self.end] - total[self.begin]) * inverse[self.begin]
        h ^= h >> np.uint64(32)
        return h * _MIX

    def strings(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The phrases from word ``first`` to word ``last``, as texts."""
        begin, size = self.begin[first], self.end[last] - self.begin[first]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])])


def _blocks(batches, powers: list) -> Iterator[tuple[str, Words, np.ndarray]]:
    """Languages, words and word hashes of about ``BLOCK`` bytes each."""
    def block(lang, texts):
        words = Words(texts)
        if len(words.data) >= len(powers[0][0]):
            powers[0] = _powers(2 * len(words.data))
        return lang, words, words.hashes(powers[0])

    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            if sizes.get(lang, 0) + sum(sizes.values()) > 8 * BLOCK:        # many languages: bounded in all
                lang_out = max(sizes, key=sizes.get)
                sizes.pop(lang_out)
                yield block(lang_out, held.pop(lang_out))
            value = text.as_py()
            held.setdefault(lang, []).append(value)
            sizes[lang] = sizes.get(lang, 0) + len(value)
            if sizes[lang] >= BLOCK:
                sizes.pop(lang)
                yield block(lang, held.pop(lang))
    for lang, texts in held.items():
        yield block(lang, texts)


def _buckets(lang: str, words: Words, h: np.ndarray, bits: int, max_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1 to ``max_words`` words, by their first word: whether
    the last one is of the same piece, and the bucket of the phrase."""
    salt = np.uint64((zlib.crc32(lang.encode()) * 0x9E3779B1 + 1) & (2**64 - 1))
    down = np.uint64(64 - bits)
    one = (h ^ salt) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = [(np.ones(len(h), bool), (one ^ (one >> np.uint64(31))) * _MIX >> down)]
    x = h
    for k in range(1, min(max_words, len(h))):
        x = (x[:-1] * np.uint64(3) + salt) ^ (h[k:] * np.uint64(0xA0761D6478BD642F))
        x ^= x >> np.uint64(29)
        x *= _MIX
        out.append((words.piece[:-k] == words.piece[k:], x >> down))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _packed(buckets: list[np.ndarray], least: int) -> pa.RecordBatch:
    """How often each bucket is there, ``least`` at most, a row for each line
    of buckets: low and high bytes of the gaps between them, and the numbers."""
    found, n = np.unique(np.concatenate(buckets), return_counts=True)
    line = (found >> np.uint32(LINE)).astype(np.int32)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    gap = np.diff(found, prepend=np.uint32(0))
    gap[first] = found[first] & np.uint32((1 << LINE) - 1)
    n = np.minimum(n, least).astype(np.min_scalar_type(least))
    offsets = np.append(first, len(found))

    def column(values):
        return pa.Array.from_buffers(pa.binary(), len(first), [
            None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    return pa.record_batch([pa.array(line[first]), column(gap.astype(np.uint8)), column((gap >> np.uint32(8)).astype(np.uint8)), column(n)],
                           names=["line", "low", "high", "n"])


def word_filter(docs: DataFrame, least: int, bits: int = BITS, max_words: int = MAX_WORDS) -> np.ndarray:
    """Bitmap (64-bit words) of the buckets whose phrases add up to ``least``."""
    def count(batches):
        powers = [_powers(2 * BLOCK)]
        held: list[np.ndarray] = []
        for lang, words, h in _blocks(batches, powers):
            if len(h):
                held += [bucket[same].astype(np.uint32) for same, bucket in _buckets(lang, words, h, bits, max_words)]
                if sum(map(len, held)) >= HELD:
                    yield _packed(held, least)
                    held = []
        if held:
            yield _packed(held, least)

    def add(batches):
        # Each line comes in rows that follow each other.
        at, sums = None, np.zeros(1 << LINE, np.int64)
        for b in batches:
            for line, low, high, n in zip(b.column("line").to_pylist(), b.column("low"), b.column("high"), b.column("n")):
                if line != at:
                    if at is not None:
                        yield filled(at, sums)
                    at, sums = line, np.zeros(1 << LINE, np.int64)
                gap = np.frombuffer(low.as_buffer(), np.uint8) + (np.frombuffer(high.as_buffer(), np.uint8).astype(np.int64) << 8)
                sums[np.cumsum(gap)] += np.frombuffer(n.as_buffer(), np.min_scalar_type(least))
        if at is not None:
            yield filled(at, sums)

    def filled(line, sums):
        return pa.record_batch([pa.array([line], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])], names=["line", "set"])

    lines = (_texts(docs).mapInArrow(count, "line int, low binary, high binary, n binary")
             .repartition("line").sortWithinPartitions("line").mapInArrow(add, "line int, set binary"))
    bitmap = np.zeros((1 << max(bits, LINE)) >> 3, np.uint8)
    found = lines.toArrow()
    for line, bytes_set in zip(found["line"].to_pylist(), found["set"]):
        at = line << (LINE - 3)
        bitmap[at:at + (1 << (LINE - 3))] = np.frombuffer(bytes_set.as_buffer(), np.uint8)
    return bitmap.view(np.uint64)


def longest(docs: DataFrame, bitmap: np.ndarray, max_words: int = MAX_WORDS, bits: int = BITS) -> DataFrame:
    """(lang, phrase, n): how often each phrase is the longest, of at most
    ``max_words`` words, that begins at a word and holds no rare phrase. The
    empty phrase stands for all rare words."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def known(bucket):
        return ((shared.value[bucket >> np.uint64(6)] >> (bucket & np.uint64(63))) & np.uint64(1)).astype(bool)

    def count(batches):
        powers = [_powers(2 * BLOCK)]
        for lang, words, h in _blocks(batches, powers):
            if not len(h):
                continue
            last, on = np.arange(len(h)), np.ones(len(h), bool)
            for k, (same, bucket) in enumerate(_buckets(lang, words, h, bits, max_words)):
                # A phrase goes on as long as it, and what is left without its first word, is frequent.
                goes_on = same & known(bucket) & on[:len(bucket)] & (on[1:len(bucket) + 1] if k else True)
                on = np.concatenate((goes_on, np.zeros(k, bool)))
                if k:
                    last += on
                else:
                    first = np.flatnonzero(on)
            if len(first) < len(h):
                yield pa.record_batch([pa.array([lang]), pa.array([""]), pa.array([len(h) - len(first)])], names=["lang", "phrase", "n"])
            table = pa.table({"phrase": words.strings(first, last[first])}).group_by("phrase").aggregate([([], "count_all")])
            for b in table.to_batches():
                yield pa.record_batch([pa.array([lang] * b.num_rows), b.column("phrase").cast(pa.string()), b.column("count_all")],
                                      names=["lang", "phrase", "n"])

    return _texts(docs).mapInArrow(count, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _size(phrase: str) -> Column:
    return F.size(F.split(phrase, " "))


def _first(phrase: str, k: int | Column) -> Column:
    """The first k words (all but the last -k - 1 from the right for a negative k: the last -k)."""
    return F.substring_index(phrase, " ", k) if isinstance(k, int) else F.expr(f"substring_index({phrase}, ' ', {k})")


class Graph:
    """The graph of a corpus: ``counts`` holds the phrases of 1 to
    ``max_words`` words that occur ``least`` times (lang, k, phrase, n),
    ``totals`` the words of each language (lang, n)."""

    def __init__(self, docs: DataFrame, folder: str, max_words: int = MAX_WORDS, least: int = LEAST, bits: int = BITS):
        self.folder, self.max_words = folder, max_words
        bitmap = word_filter(docs, least, bits, max_words)
        edges = stage(longest(docs, bitmap, max_words, bits).withColumn("k", _size("phrase")), folder, "longest")
        flow = edges.filter(F.col("k") == max_words).select("lang", "phrase", "n")
        levels = [flow]
        for k in range(max_words - 1, 0, -1):
            cut_short = edges.filter(F.col("k") == k).select("lang", "phrase", "n")
            flow = stage(flow.select("lang", _first("phrase", k).alias("phrase"), "n").union(cut_short)
                         .groupBy("lang", "phrase").agg(F.sum("n").alias("n")), folder, f"flow-{k}")
            levels.append(flow)
        self.totals = stage(flow.groupBy("lang").agg(F.sum("n").alias("n")), folder, "totals")
        frequent = [f.filter((F.col("n") >= least) & (F.col("phrase") != "")).select("lang", F.lit(max_words - i).alias("k"), "phrase", "n") for i, f in enumerate(levels)]
        counts = frequent[0]
        for f in frequent[1:]:
            counts = counts.union(f)
        self.counts = stage(counts, folder, "counts")
        # Only counts and totals are read from here on.
        for name in ("longest", *(f"flow-{k}" for k in range(1, max_words))):
            remove(docs.sparkSession, f"{folder}/{name}")

    def level(self, k: int) -> DataFrame:
        return self.counts.filter(F.col("k") == k).select("lang", "phrase", "n")

    def incident(self, k: int) -> DataFrame:
        """Phrases of k words with the most frequent phrase that adds a word
        before (``n_in``, ``p_in``) and after (``n_out``, ``p_out``)."""
        longer = self.level(k + 1)
        out = longer.groupBy("lang", _first("phrase", k).alias("phrase")).agg(F.max("n").alias("n_out"), F.max_by("phrase", "n").alias("p_out"))
        into = longer.groupBy("lang", _first("phrase", -k).alias("phrase")).agg(F.max("n").alias("n_in"), F.max_by("phrase", "n").alias("p_in"))
        return self.level(k).join(out, ["lang", "phrase"], "left").join(into, ["lang", "phrase"], "left")

    @cached_property
    def nodes(self) -> DataFrame:
        """The nodes, and whether each is ``unary``: all its flow comes by one edge and leaves by one."""
        unary = F.coalesce((F.col("n_in") == F.col("n")) & (F.col("n_out") == F.col("n")), F.lit(False))
        return stage(self.incident(self.max_words - 1).withColumn("unary", unary), self.folder, "nodes")

    def paths(self) -> DataFrame:
        """The edges of the compacted graph: (lang, words, n). Each is a
        maximal chain of edges over unary nodes; all occur ``n`` times."""
        size = self.max_words - 1
        before = self.nodes.filter("unary").select("lang", F.col("phrase").alias("_u"), F.col("p_in").alias("head"))
        edges = stage(self.level(self.max_words).withColumn("_u", _first("phrase", size)).join(before, ["lang", "_u"], "left")
                      .select("lang", "phrase", "n", "head", F.lit(1).cast("bigint").alias("place")), self.folder, "edges")
        # Edges behind another one jump to its predecessor's predecessor, so chains need as many rounds as their
        # length has bits; an edge is done when its head has no predecessor. All others take no part.
        done, ahead, rounds = [], edges.filter("head IS NOT NULL"), 0
        reach = ahead
        while not ahead.isEmpty():
            far = reach.select("lang", F.col("phrase").alias("head"), F.col("head").alias("_h"), F.col("place").alias("_p"))
            step = stage(ahead.join(far, ["lang", "head"], "left").select(
                "lang", "phrase", "n", F.coalesce("_h", "head").alias("head"),
                (F.col("place") + F.coalesce("_p", F.lit(0))).alias("place"), F.col("_h").isNull().alias("ended")), self.folder, f"path-{rounds}")
            rounds += 1
            done.append(step.filter("ended").drop("ended"))
            ahead = step.filter("not ended").drop("ended")
            reach = ahead
            for d in done:
                reach = reach.union(d)
        state = edges.filter("head IS NULL").select("lang", "phrase", "n", F.col("phrase").alias("head"), F.lit(0).cast("bigint").alias("place"))
        for d in done:
            state = state.union(d)
        path = state.groupBy("lang", "head").agg(
            F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", _first("phrase", -1).alias("word")))).alias("_w"))
        return path.select("lang", F.concat(F.split(_first("head", size), " "), F.transform("_w", lambda w: w["word"])).alias("words"), "n")

    def candidates(self, percent: int = PERCENT) -> DataFrame:
        """(lang, phrase, k, a) of all candidates that no longer one makes superfluous."""
        n = self.max_words
        longest = self.paths().select("lang", F.explode(F.expr(
            f"transform(sequence(1, size(words) - {n - 1}), i -> array_join(slice(words, i, {n}), ' '))")).alias("phrase"),
            F.lit(n).alias("k"), F.col("n").alias("a"))
        out = [longest]
        for k in range(2, n):
            # Nodes inside a path are as frequent as its edges, so they drop.
            around = (self.nodes.filter("not unary") if k == n - 1 and percent <= 100 else self.incident(k))
            most = F.coalesce(F.greatest("n_in", "n_out"), F.lit(0))
            out.append(around.filter(100 * most < percent * F.col("n")).select("lang", "phrase", F.lit(k).alias("k"), F.col("n").alias("a")))
        found = out[0]
        for o in out[1:]:
            found = found.union(o)
        return found


def score(a: str = "a", left: str = "l", right: str = "r") -> Column:
    """floor(1000000 * a * a / (l * r)), exact for counts below 10^15."""
    a, left, right = (f"cast({c} as decimal(15, 0))" for c in (a, left, right))
    return F.expr(f"(cast({a} * {a} as decimal(30, 0)) * cast(1000000 as decimal(7, 0))) div cast({left} * {right} as decimal(30, 0))")


def phrases(docs: DataFrame, folder: str, max_words: int = MAX_WORDS, least: int = LEAST, percent: int = PERCENT, top: int = TOP,
            bits: int = BITS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    graph = Graph(docs, folder, max_words, least, bits)
    cuts = (graph.candidates(percent).withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
            .withColumn("_l", F.expr("substring_index(phrase, ' ', cut)")).withColumn("_r", F.expr("substring_index(phrase, ' ', cut - k)")))
    count = graph.counts.select("lang", "phrase", "n")
    cuts = (cuts.join(count.withColumnsRenamed({"phrase": "_l", "n": "l"}), ["lang", "_l"])
            .join(count.withColumnsRenamed({"phrase": "_r", "n": "r"}), ["lang", "_r"]))
    worst = (cuts.select("lang", "phrase", "a", F.struct(score().alias("score"), "cut", "l", "r").alias("c"))
             .groupBy("lang", "phrase", "a").agg(F.min("c").alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    # First within shares of a language, so that the last task of a language gets SHARES * top rows at most.
    order = "order by score desc, a desc, phrase"
    worst = (worst.withColumn("_share", F.expr(f"row_number() over (partition by lang, pmod(xxhash64(phrase), {SHARES}) {order})"))
             .filter(F.col("_share") <= top))
    ranked = worst.withColumn("rank", F.expr(f"row_number() over (partition by lang {order})")).filter(F.col("rank") <= top)
    return ranked.join(graph.totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")
