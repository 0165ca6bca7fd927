"""Language model, language identification, toxicity."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import hmm_lm, language_id, queries, toxicity
from cuelake.llm.common import held_out, scratch

SF = "/root/testdata/sf0.01"


def test_base_score_and_model_beats_it(spark, docs):
    got = {r["doc_id"]: r for r in queries.op1_lm_scoring(spark, SF).collect()}
    texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in docs.collect()}
    count = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    total, distinct = sum(count.values()), len(count)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in count for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t), abs=1e-6)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_forward_equals_sum_over_paths():
    rng = np.random.default_rng(3)
    k, n = 3, 6
    emit = rng.random((hmm_lm.CLASSES + 1, k))
    p = hmm_lm.maximise(rng.random((2, k)), rng.random((k, k)), emit)
    obs = rng.integers(0, hmm_lm.CLASSES, n)
    total = sum(p.start[0, s[0]] * p.emit[obs[0], s[0]] * math.prod(p.move[s[t - 1], s[t]] * p.emit[obs[t], s[t]] for t in range(1, n))
                for s in itertools.product(range(k), repeat=n))
    got = hmm_lm.log_forward(np.concatenate([obs[:1], obs]), np.array([0, 1]), np.array([1, n]), p)
    assert got[1] == pytest.approx(math.log(total))


def test_expected_counts_equal_path_posteriors():
    rng = np.random.default_rng(4)
    k, n = 2, 4
    p = hmm_lm.maximise(rng.random((2, k)), rng.random((k, k)), rng.random((hmm_lm.CLASSES + 1, k)))
    obs = np.array([5, 9, 5, 7])
    e = hmm_lm.Expected(k)
    e.add(obs[:, None], np.array([n]), np.array([True]), p)
    move, emit, z = np.zeros((k, k)), np.zeros((10, k)), 0.0
    for s in itertools.product(range(k), repeat=n):
        w = p.start[0, s[0]] * p.emit[obs[0], s[0]] * math.prod(p.move[s[t - 1], s[t]] * p.emit[obs[t], s[t]] for t in range(1, n))
        z += w
        for t in range(n):
            emit[obs[t], s[t]] += w
            if t:
                move[s[t - 1], s[t]] += w
    assert np.allclose(e.move, move / z, atol=1e-4) and np.allclose(e.emit[:10], emit / z, atol=1e-4)


def test_lm_hard_rows(spark, hard, folder):
    rows = hmm_lm.score(hard.withColumn("held_out", held_out("doc_id", 7)), folder, passes=1).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in hard.select("doc_id").collect())
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert hmm_lm.score(hard.limit(0).withColumn("held_out", F.lit(False)), scratch(spark), passes=1).count() == 0
    none = hmm_lm.score(hard.withColumn("held_out", F.lit(True)), scratch(spark), passes=1).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in none} == {(0, 0)}


def test_states_know_words_of_one_class(spark, folder):
    """Topics that differ, for four words of five, by words of the same class only."""
    rng = np.random.default_rng(0)
    by_class = {}
    for i in range(12_000):
        key = np.array([0, hmm_lm.xxhash.xxh64_intdigest(f"w{i}".encode())], np.uint64).view(np.int64)
        by_class.setdefault(int(hmm_lm.classes_of(key)[1]), []).append(f"w{i}")
    pairs = [v for v in by_class.values() if len(v) == 2][:40]
    own = [[f"{t}{i}" for i in range(10)] for t in "ab"]
    rows = []
    for i in range(400):
        t = i % 2
        words = [own[t][rng.integers(10)] if rng.random() < 0.2 else pairs[rng.integers(40)][t] for _ in range(256)]
        rows.append((i, " ".join(words), i >= 360))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean")
    out = [r for r in hmm_lm.score(docs, folder).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out)
    assert gain > 0.2


def test_word_probabilities_of_a_state_add_up_to_one():
    rng = np.random.default_rng(1)
    k, cls = 3, np.concatenate([rng.integers(0, 50, 200), [hmm_lm.CLASSES]])
    e, by_class = rng.random((201, k)), np.zeros((hmm_lm.CLASSES + 1, k))
    np.add.at(by_class, cls, e)
    p = hmm_lm.maximise_words(rng.random((2, k)), rng.random((k, k)), by_class, np.bincount(cls, minlength=hmm_lm.CLASSES + 1))
    unseen = hmm_lm.emissions(p, cls[:1], np.zeros((1, k)))[0]
    assert np.allclose(hmm_lm.emissions(p, cls, e).sum(0) + unseen, 1)


def test_language_accuracy(spark, docs):
    got = queries.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_hard_rows(spark, hard, docs):
    model = language_id.fit(docs)
    got = hard.select("doc_id", language_id.language(model)("text").alias("p")).select("doc_id", "p.*").collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 6)} == {"und"}
    assert "und" not in {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 7, 8)}
    assert language_id.fit(docs.limit(0)).predict("words") == ("und", 0.0)
    assert language_id.fit(hard.filter("lang = 'en'")).predict("words")[0] == "en"
    assert hard.limit(0).select(language_id.language(model)("text")).count() == 0


def test_unknown_languages_are_families_of_their_own():
    assert language_id.family_of("en") == language_id.family_of("de") != language_id.family_of("fr")
    assert language_id.family_of("xx") != language_id.family_of("yy")


def test_toxicity_finds_held_out_toxic_texts(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = queries.op4_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    rank = r["score"].rank()
    pos, neg = int((r["toxic"] == 1).sum()), int((r["toxic"] == 0).sum())
    assert (rank[r["toxic"] == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) > 0.75
    assert (r.loc[r["toxic"] == 0, "predicted"]).mean() < 0.06
    assert r["score"].between(0, 1).all() and (r["predicted"] == (r["score"] >= 0.3)).all()


def test_toxicity_hard_rows(spark, hard, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs.join(labels, "doc_id"))
    got = hard.select(toxicity.toxicity(model)("text").alias("s")).collect()
    assert len(got) == hard.count() and all(0 <= r["s"] <= 1 for r in got)
    empty = toxicity.fit(docs.withColumn("toxic", F.lit(0)))
    assert empty.score("anything") == 0.0
    assert toxicity.fit(docs.limit(0).withColumn("toxic", F.lit(0))).score("x") == 0.0


def test_windows_cover_every_byte():
    text = "abc def " * 100 + "z" * 1000 + " end"
    assert b"".join(w.strip() for w in toxicity.windows(text)).replace(b" ", b"") == text.replace(" ", "").encode()


def test_toxicity_fit_on_separate_labels(spark, tmp_path):
    """Labels in a table of their own give the model of the joined rows, and no text meets the labels' join."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    a = toxicity.fit(docs.join(labels, "doc_id"))
    assert toxicity.fit_joined(docs, labels, f"{tmp_path}/a") == a
    assert toxicity.fit_joined(docs.union(docs), labels.union(labels), f"{tmp_path}/b") == a
    assert toxicity.fit_joined(docs, labels.limit(0), f"{tmp_path}/c").score("x") == 0.0
