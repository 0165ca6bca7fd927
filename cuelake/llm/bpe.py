"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

``merge_ranks`` merges one pre-token: buckets per merge rank hold positions of
a linked list of parts, a two-level bitmap says which buckets hold any, and
find-first-set gives the next rank; entries whose pair has changed meanwhile
are stale and skipped. The work is O(n log n) for a pre-token of n bytes, so
a very long pre-token costs no square.

Edge cases: a null text is encoded like the empty one (no ids); repeated rows
and null ids stay one row each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from .common import Cache, map_batches

#: Entries of a worker's pre-token cache; longer pre-tokens are not kept.
CACHE_ENTRIES = 1_200_000
CACHE_BYTES = 64


class RankQueue:
    """Priority queue over ranks 0..n-1: a heap of positions for each rank in
    use, words of 512 bits that tell which ranks these are, and a bitmap of
    the words that aren't zero."""

    def __init__(self, n: int):
        self.words, self.top = [0] * ((n >> 9) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [pos]
            self.words[rank >> 9] |= 1 << (rank & 511)
            self.top |= 1 << (rank >> 9)
        else:
            heappush(bucket, pos)

    def pop(self) -> tuple[int, int]:
        """Least rank, then least position: find first set in both levels."""
        at = (self.top & -self.top).bit_length() - 1
        word = self.words[at]
        rank = at << 9 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        pos = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            word &= word - 1
            self.words[at] = word
            if not word:
                self.top &= self.top - 1
        return rank, pos


def merge_ranks(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Token ids of one pre-token: lowest rank first, leftmost first. The queue
    is empty before and after."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))                  # end of the part that starts here
    prev = list(range(-1, n - 1))
    rank_of, push, pop = ranks.get, queue.push, queue.pop
    pair = [rank_of(piece[i:i + 2], -1) for i in range(n)]      # rank of the part here joined with the next
    pair[-1] = -1
    for i, r in enumerate(pair):
        if r >= 0:
            push(r, i)
    while queue.top:
        rank, i = pop()
        if pair[i] != rank:                      # stale
            continue
        nxt = end[i]
        stop = end[i] = end[nxt]
        pair[nxt] = pair[i] = -1
        if stop < n:
            prev[stop] = i
            r = pair[i] = rank_of(piece[i:end[stop]], -1)
            if r >= 0:
                push(r, i)
        if (p := prev[i]) >= 0:
            r = pair[p] = rank_of(piece[p:stop], -1)
            if r >= 0:
                push(r, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


class Codec:
    def __init__(self, rank_file: str, pattern: str):
        import regex

        self.ranks = read_ranks(rank_file)
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache = Cache(CACHE_ENTRIES)

    def _miss(self, token: str) -> bytes:
        raw = token.encode("utf-8")
        ids = np.asarray(merge_ranks(raw, self.ranks, self.queue), dtype="<u4").tobytes()
        return self.cache.keep(token, ids) if len(raw) <= CACHE_BYTES else ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, miss = self.cache.get, self._miss
        return b"".join([get(t) or miss(t) for t in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec_of(rank_file: str, pattern: str) -> Codec:
    """One per worker process: later tasks find the cache warm."""
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit) for every text."""

    def run(batches):
        codec = codec_of(rank_file, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": [codec.encode(t or "") for t in b["text"]]}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, ids binary")


def decode(ids: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` for rows of ``doc_id, ids``."""

    def run(batches):
        codec = codec_of(rank_file, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "bytes": [codec.decode(x or b"") for x in b["ids"]]}

    return map_batches(ids.select("doc_id", "ids"), run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and keep the digests of both: ids and bytes
    never leave the worker, so nothing wide is shuffled or written."""

    def run(batches):
        codec = codec_of(rank_file, pattern)
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in b["text"]:
                ids = codec.encode(text or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield out

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
