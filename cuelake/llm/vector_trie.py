"""Vector code compression: product codes by a trie over distinct parts.

Vectors are scaled to whole numbers, floor(4096 * x), and cut into 8 parts.
A part position's codebook has 16 entries and starts as that part of the 16
smallest vec_ids; each round assigns every part to its nearest entry and
moves an entry to the componentwise floor of its parts' mean.

The training rounds read the distinct parts and how often each occurs, in
lexicographic order. A batch of them is a trie whose levels are the
dimensions: the traversal goes depth first and hands down the vector of
squared distances to all entries accumulated so far, so what a common prefix
costs is paid once for all parts below it. At a leaf the least distance gives
the entry; the leaf's weight is added to that entry's count and sums. A batch
gives at most 8 * 16 partial sums, which Spark adds up; only these reach the
driver, whatever the number of vectors. Vectors are coded in one last pass
over the table by the same traversal, without a join. All arithmetic is in
64-bit whole numbers and exact.

Edge cases: a vector is dropped if it is null or empty, holds a null or
non-finite component, has another length than most vectors (the greater of
two equally frequent lengths), or a component so large that squared distances
might pass 62 bits. Lengths that 8 does not divide are filled up with zeros.
Of repeated vec_ids, the vector least in order of its components is the
start entry; a null vec_id is coded, but starts no entry; with fewer than 16
ids, codebooks have fewer entries, with none the code is null. Repeated rows
count as often as they occur. An empty table gives no rows. Clashing names
of other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096


def scaled(vectors: DataFrame, vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """All columns of the usable rows, and ``_v``: scaled components, their
    number a multiple of 8. One small job finds the usual length."""
    x = F.col(vec)
    finite = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.filter(x.isNotNull() & (F.size(x) > 0) & ~finite)
    usual = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = usual["n"] if usual else PARTS
    most = float(2 ** ((62 - (n - 1).bit_length()) // 2 - 1))
    width = -(-n // PARTS) * PARTS
    rows = rows.filter((F.size(x) == n) & ~F.exists(x, lambda e: F.abs(e.cast("double") * scale) >= most))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint"))
    return rows.withColumn("_v", F.concat(whole, F.array_repeat(F.lit(0).cast("bigint"), width - n)) if width > n else whole)


def start(rows: DataFrame, vec_id: str = "vec_id", entries: int = ENTRIES) -> np.ndarray:
    """The first codebooks (part, entry, position) from ``scaled`` rows: a
    top-k of fixed size."""
    ids = [r[0] for r in rows.select(vec_id).filter(F.col(vec_id).isNotNull()).distinct().orderBy(vec_id).limit(entries).collect()]
    if not ids:
        return np.zeros((0, 0, 0), np.int64)
    first = rows.filter(F.col(vec_id).isin(ids)).groupBy(F.col(vec_id).alias("i")).agg(F.min("_v").alias("v")).collect()
    books = np.array([r["v"] for r in sorted(first, key=lambda r: r["i"])], dtype=np.int64)
    return books.reshape(len(first), PARTS, -1).transpose(1, 0, 2)


def parts(rows: DataFrame) -> DataFrame:
    """Distinct parts of ``scaled`` rows: (pos, part, weight)."""
    width = f"size(_v) div {PARTS}"
    each = F.expr(f"transform(sequence(0, {PARTS - 1}), p -> named_struct('pos', p, 'part', slice(_v, p * ({width}) + 1, {width})))")
    return rows.select(F.explode(each).alias("e")).groupBy("e.pos", "e.part").agg(F.count("*").alias("weight"))


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in lexicographic order: the index of the nearest entry (ties to
    the lower) and the squared distance. Depth-first over the trie of the rows."""
    n, dims = block.shape
    code, error = np.empty(n, np.int64), np.empty(n, np.int64)
    # A node: its rows (from, to), its depth, the distances accumulated on the way to it.
    nodes = [(0, n, 0, np.zeros(len(book), np.int64))] if n else []
    while nodes:
        lo, hi, depth, shared = nodes.pop()
        column = block[lo:hi, depth]
        begins = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1))
        below = shared + (column[begins, None] - book[:, depth]) ** 2
        sizes = np.diff(begins, append=hi - lo)
        if depth + 1 == dims:
            best = below.argmin(1)
            code[lo:hi] = np.repeat(best, sizes)
            error[lo:hi] = np.repeat(below[np.arange(len(best)), best], sizes)
            continue
        alone = np.flatnonzero(sizes == 1)      # a path without branches down to its leaf
        if len(alone):
            at, total = lo + begins[alone], below[alone]
            for d in range(depth + 1, dims):
                total = total + (block[at, d][:, None] - book[:, d]) ** 2
            best = total.argmin(1)
            code[at], error[at] = best, total[np.arange(len(best)), best]
        for k in np.flatnonzero(sizes > 1)[::-1]:
            nodes.append((lo + begins[k], lo + begins[k] + sizes[k], depth + 1, below[k]))
    return code, error


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sorted(block: np.ndarray) -> np.ndarray:
    return np.lexsort(block.T[::-1])


def moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the distinct parts."""
    count, entries, width = books.shape
    names = [f"s{d}" for d in range(width)]

    def sums(batches):
        for b in batches:
            pos, part = b.column("pos").to_numpy(), _matrix(b.column("part"))
            weight = b.column("weight").to_numpy()
            rows = []
            for p in np.unique(pos):
                at = np.flatnonzero(pos == p)
                at = at[_sorted(part[at])]
                code, _ = nearest(part[at], books[p])
                total = np.zeros((entries, width + 1), np.int64)
                np.add.at(total, code, np.column_stack([weight[at], part[at] * weight[at, None]]))
                rows += [(p, e, *total[e]) for e in np.flatnonzero(total[:, 0])]
            if rows:
                table = np.array(rows, np.int64)
                yield pa.record_batch([pa.array(c) for c in table.T], names=["pos", "entry", "n", *names])

    schema = ", ".join(f"{c} bigint" for c in ("pos", "entry", "n", *names))
    exact = distinct.mapInArrow(sums, schema).groupBy("pos", "entry").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)])
    new = books.copy()
    for r in exact.collect():
        new[r["pos"], r["entry"]] = [int(r[c]) // int(r["n"]) for c in names]
    return new


def train(rows: DataFrame, folder: str, vec_id: str = "vec_id", entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of ``scaled`` rows. A round that
    moves no entry is the last, as all later ones would repeat it."""
    books = start(rows, vec_id, entries)
    if not books.size:
        return books
    distinct = stage(parts(rows).repartitionByRange(F.col("pos"), F.col("part")).sortWithinPartitions("pos", "part"), folder, "parts")
    for _ in range(rounds):
        new = moved(distinct, books)
        if np.array_equal(new, books):
            break
        books = new
    return books


def coded(rows: DataFrame, books: np.ndarray, carry: list[str]) -> DataFrame:
    """``carry``, ``code`` and ``error`` of ``scaled`` rows."""
    schema = rows.select(*carry).schema.add("code", "string").add("error", "long")

    def run(batches):
        for b in batches:
            all_parts = _matrix(b.column("_v")).reshape(b.num_rows, len(books), -1) if b.num_rows else None
            if all_parts is None:
                continue
            codes, error = np.empty((b.num_rows, len(books)), np.int64), np.zeros(b.num_rows, np.int64)
            for p, book in enumerate(books):
                at = _sorted(all_parts[:, p])
                codes[at, p], found = nearest(all_parts[at, p], book)
                error[at] += found
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carry), pa.array(text), pa.array(error)], names=[*carry, "code", "error"])

    if not books.size:
        return rows.select(*carry, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return rows.select(*carry, "_v").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, folder: str, vec_id: str = "vec_id", vec: str = "embedding",
             label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Every usable vector with its code and errors, and the codebooks."""
    rows = scaled(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("_x"), F.col(label).alias("label")), "_x")
    books = train(rows, folder)
    out = stage(coded(rows, books, ["vec_id", "label"]), folder, "codes")
    # One row per label, written, so that its size is known before it is joined: a hot label costs no single task.
    total = stage(out.groupBy("label").agg(F.sum("error").alias("label_error")), folder, "labels").withColumnRenamed("label", "_label")
    return out.join(total, out["label"].eqNullSafe(total["_label"])).select("vec_id", "label", "code", "error", "label_error"), books


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``vector``: the entries that a code stands for, scaled back."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in e]) for e in b]) for b in books])
    return codes.withColumn("vector", F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(len(books) - 1)),
        lambda p: flat[p][F.conv(F.substring(F.col("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int")])))
