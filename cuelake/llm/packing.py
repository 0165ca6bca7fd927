"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A task tokenises the documents of its partition, cuts an overlong document
into full windows first, and places what remains longest first: a segment
tree over remaining capacities gives the tightest open window that still
holds the piece. Nothing is shuffled: windows are local to a partition, so
padding is at most a few windows for each ``SHARD_PIECES`` pieces.

Edge cases: a null or empty text is the closing id alone (one token); rows
with a null id or repeated rows are packed like any other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Cache, map_batches

WINDOW = 4096
CLOSING_ID = 2
#: Pieces that are sorted and packed together in one task (bounds its memory).
SHARD_PIECES = 200_000
#: Entries of a worker's word cache.
CACHE_WORDS = 600_000

PIECE_SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                "sequence_id bigint, offset bigint")


class CapacityTree:
    """Segment tree over the values 0..capacity; a leaf counts the open
    windows with that much room. ``tightest(n)`` finds the least room >= n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:                     # climb until a right sibling holds a window
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:             # then descend to its least leaf
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """``(window, offset)`` for each length (all <= capacity), in input order.
    Ties in length keep input order."""
    tree, open_by_room, used = CapacityTree(capacity), {}, []
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        n = lengths[k]
        room = tree.tightest(n)
        if room is None:
            w, room = len(used), capacity
            used.append(0)
        else:
            w = open_by_room[room].pop()
            tree.change(room, -1)
        placed[k] = (w, used[w])
        used[w] += n
        if left := room - n:
            open_by_room.setdefault(left, []).append(w)
            tree.change(left, 1)
    return placed


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


class WordIds:
    """Token ids of a text, exactly as the tokenizer file gives them, with a
    cache per pre-token. Texts of plain Latin letters are split here; any
    other text goes through the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        letters, digits = _latin("L"), _latin("N")
        self.beyond = re.compile(r"[^\x00-\u017f]").search
        self.words = re.compile(rf"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^\s{letters}{digits}]+").findall
        self.cache = Cache(CACHE_WORDS)

    def plain(self, text: str) -> bool:
        """Latin letters in composed form, none of the characters that are
        white space to one regular expression library only, and no added
        token (whose string is one id wherever it stands)."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f\x85\xa0") or any(a in text for a in self.added):
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not self.beyond(text) and unicodedata.is_normalized("NFC", text)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.plain(text):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = self.words(text.lower())
        got = list(map(self.cache.get, words))
        if None in got:
            new = list({w for w, g in zip(words, got) if g is None})
            ids = [e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
            fresh = {w: self.cache.keep(w, struct.pack(f"<{len(i)}I", *i)) for w, i in zip(new, ids)}
            got = [fresh[w] if g is None else g for w, g in zip(words, got)]
        return b"".join(got)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process: later tasks find the cache warm."""
    return WordIds(path)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, closing_id: int = CLOSING_ID,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their place in a sequence.

    Sequence ids are ``partition << 40 | window``: unique, and the same when a
    lost task runs again. ``tokenizer`` is a path that every executor can open.
    """

    names = PIECE_SCHEMA.replace(" bigint", "").split(", ")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, tail = word_ids(tokenizer), np.array([closing_id], "<u4").tobytes()
        base, sequences = TaskContext.get().partitionId() << 40, 0
        rest: list[tuple] = []

        def place():
            nonlocal sequences
            placed = best_fit_decreasing([p[2] for p in rest], window)
            rows = [(*p, base + sequences + w, o) for p, (w, o) in zip(rest, placed)]
            sequences += 1 + max((w for w, _ in placed), default=-1)
            rest.clear()
            return rows

        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = (ids_of(text) if text else b"") + tail
                n = len(ids) // 4
                for start in range(0, n, window):
                    cut = ids[4 * start: 4 * (start + window)]
                    piece = (doc, start, len(cut) // 4, zlib.crc32(cut), n)
                    if piece[2] == window:
                        rows.append((*piece, base + sequences, 0))
                        sequences += 1
                    else:
                        rest.append(piece)
            if len(rest) >= shard_pieces:
                rows += place()
            if rows:
                yield dict(zip(names, map(list, zip(*rows))))
        if rest:
            yield dict(zip(names, map(list, zip(*place()))))

    return map_batches(docs.select("doc_id", "text"), run, PIECE_SCHEMA)
