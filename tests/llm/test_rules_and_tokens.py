"""Quality rules, byte-level BPE, packing."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.llm import bpe, packing, quality_rules, queries
from cuelake.llm.common import scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BLANK = r"[^\x20\x09-\x0D]+"


def base_counts(text):
    t = text or ""
    w = re.findall(BLANK, t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(BLANK, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, docs, hard):
    odd = [(None,), ("",), ("a a a a a",), ("a b a b a b",), (" x y 😀😀 #*$",), ("a\n a\na\n\n\na\n",), ("f v \f\x0b f",)]
    rows = docs.select("text").union(hard.select("text")).union(spark.createDataFrame(odd, "text string"))
    for r in rows.select("text", quality_rules.counts().alias("c")).collect():
        assert tuple(r["c"]) == base_counts(r["text"])


def test_quality_verdicts(spark, docs):
    got = queries.op5_quality_rules(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").collect()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) > 0.99 * len(good)
    assert sum(r["kept"] for r in bad) < 0.1 * len(bad)


def test_concentration_steps_ignore_outliers(spark, folder):
    rng = np.random.default_rng(1)
    clean = rng.multivariate_normal([5, 1.6, 2, 3, 4], np.eye(5) + 0.5, 1500)
    far = rng.normal(40, 1, (500, 5))
    rows = spark.createDataFrame([("g", "h", *map(float, v)) for v in np.vstack([clean, far])],
                                 "g1 string, g2 string, " + ", ".join(f"x{i} double" for i in range(5)))
    e = quality_rules.fit(rows, folder).first()
    assert [e[f"m{i}"] for i in range(5)] == pytest.approx([5, 1.6, 2, 3, 4], abs=0.2)


def test_quality_hard_rows(spark, hard, folder):
    got = quality_rules.quality(hard, folder).collect()
    assert len(got) == hard.count() and {r["doc_id"]: r["kept"] for r in got}[1] is False
    kept = quality_rules.kept_rows(hard, scratch(spark))
    assert kept.columns == hard.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality_rules.quality(hard.limit(0), scratch(spark)).count() == 0


def test_rare_languages_are_judged_by_all_documents(spark, folder):
    """Twenty documents of a rare language are too few for an estimate of their own."""
    got = spark.range(520).selectExpr(
        "id AS doc_id", "if(id < 500, '=en', '=xx') AS _lang", "'=a' AS _source", "bigint(200 + id % 90) AS n_words",
        "bigint(1000 + id % 70) AS word_chars", "if(id = 519, 900L, id % 3) AS n_symbols", "0L AS n_dup_lines", "id % 4 AS n_repeat_words",
        "false AS base_failed")
    rows = quality_rules.judge(got, quality_rules.estimates(got, folder), ["doc_id"]).collect()
    assert all(r["distance"] is not None for r in rows)
    assert [r["doc_id"] for r in rows if not r["kept"]] == [519]


def test_no_python_in_quality_plan(spark, docs, folder):
    plan = quality_rules.quality(docs, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)


def test_bpe_equals_library(spark, docs, hard, reference):
    rows = docs.select("doc_id", "text").union(hard.select("doc_id", "text"))
    want = Counter()
    for r in rows.collect():
        ids = np.array(reference.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        want[(r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(rows, RANKS, public_tokenizers.PATTERN).collect())) == want


def test_encode_and_decode_frames(hard):
    ids = bpe.encode(hard, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in back) == Counter(
        (r["doc_id"], r["text"] or "") for r in hard.collect())
    assert bpe.encode(hard.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_any_text(text):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == enc.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_very_long_pre_token(reference):
    import random

    text = "".join(random.Random(2).choices("abcde", k=60_000))
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_decreasing(lengths):
    placed = packing.best_fit_decreasing(lengths, 64)
    used = {}
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    for k in order:                                     # plain search over all windows
        fit = [w for w in used if 64 - used[w] >= lengths[k]]
        room = min((64 - used[w] for w in fit), default=64)
        w, offset = placed[k]
        assert offset == used.get(w, 0) and 64 - used.get(w, 0) == room
        used[w] = offset + lengths[k]


def check_pieces(rows, pieces):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_FILE)
    ids = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in rows]
    want = Counter((i, s, len(x[s:s + 4096]), zlib.crc32(np.array(x[s:s + 4096], "<u4").tobytes()), len(x))
                   for i, x in ids for s in range(0, len(x), 4096))
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return sum(p["length"] for p in pieces) / (4096 * len(by))


def test_packing(spark, docs, hard):
    assert check_pieces(docs.collect(), queries.op10_packing(spark, "/root/testdata/sf0.01").collect()) > 0.98
    check_pieces(hard.collect(), packing.pack(hard, WORD_FILE).collect())
    check_pieces(hard.collect(), packing.pack(hard, WORD_FILE, shard_pieces=3).collect())
    assert packing.pack(hard.limit(0), WORD_FILE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF), max_size=40))
def test_word_ids_any_text(text):
    ids = packing.word_ids(WORD_FILE)
    assert np.frombuffer(ids(text), "<u4").tolist() == ids.tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|startoftext|>a b", "<|ENDOFTEXT|> x", "<|endoftext|>" * 3, "a<|endoftext|", "é <|startoftext|> 中"])
def test_added_tokens_as_the_library(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(WORD_FILE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.word_ids(WORD_FILE)(text), "<u4").tolist() == want


def test_kept_rows_count_each_text_once(spark, docs, folder):
    plan = quality_rules.kept_rows(docs, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("n_dup_lines,") == 1
