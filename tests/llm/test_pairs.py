"""Jaccard join and embedding near-duplicates against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuelake.llm import jaccard_join, nn_descent, queries
from cuelake.llm.common import components, scratch


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows, threshold=0.8):
    """(class id, links) of each row by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return Counter((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_join_equals_all_pairs(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op3_ngram_jaccard_join(spark, "/root/testdata/sf0.01").collect())) == brute_join(rows)


def test_join_of_hot_groups_in_blocks(spark, folder):
    """A large group of near copies, split into small blocks, and chains."""
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300 + i, f"w{i} q r s t u v") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.join(df, folder, block=16)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_join(rows)
    assert got.filter("kept").count() == got.select("class_id").distinct().count()


def test_join_hard_rows(spark, hard, folder):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    got = jaccard_join.join(hard, folder)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_join(rows)
    kept = got.filter("kept").select("row.*")
    assert kept.columns == hard.columns and kept.count() == hard.count() - 2
    assert jaccard_join.join(hard.limit(0), scratch(spark)).count() == 0


def test_pruning_keeps_linked_pairs():
    """A pair at the threshold survives each step but for a chance near the tolerance."""
    least = jaccard_join.least_matches()
    rng = np.random.default_rng(0)
    m = (rng.random((200_000, 128)) < 0.8).cumsum(axis=1)
    lost = sum((m[:, n - 1] < k).mean() for n, k in least.items())
    assert lost < 1e-4
    assert all(least[n] < 0.8 * n for n in least) and least[128] > 64


def test_components_of_long_chains(spark, folder):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (205, 103)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), folder).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[205] == 103 == got[103]


def brute_vectors(rows, threshold=0.98):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and g is not None
          for _, v, g in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None
            for (_, v, _), o in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return Counter((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


VEC = "vec_id bigint, embedding array<float>, label int, n_links string"


def test_vectors_equal_all_pairs(spark, folder):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (1, 2):
        for size, noise in ((60, 0.01), (5, 0.015), (2, 0.002)) * 3 + ((1, 0),) * 150:
            base = rng.standard_normal(32)
            for _ in range(size):
                rows.append((n, (base + noise * 5 * rng.standard_normal(32)).tolist(), label, "x"))
                n += 1
    rows += [(1000 + i, rows[0][1], 1, "x") for i in range(20)]
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, VEC), folder, neighbours=6)
    want = brute_vectors([r[:3] for r in rows])
    same = sum((Counter(map(tuple, got.collect())) & want).values())
    assert same >= 0.98 * len(rows)


def test_vectors_hard_rows(spark, folder):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
            (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 2),
            (11, [1.0, 2.0, 0.0], 1), (None, [1.0, 2.0], 3), (12, [-0.0, 1.0], 1), (13, [0.0, 1.0], 1), (14, [1e30, 2e30], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VEC)
    assert Counter(map(tuple, nn_descent.near_duplicates(df, folder).collect())) == brute_vectors(rows)
    assert nn_descent.near_duplicates(df.limit(0), scratch(spark)).count() == 0


def test_vectors_of_nested_clusters(spark, folder):
    """Two tight subgroups fill each other's lists with their own points."""
    rng = np.random.default_rng(5)
    rows = [(1000 + i, rng.standard_normal(64).tolist(), 1, "x") for i in range(200)]
    for pair in range(4):
        q, _ = np.linalg.qr(rng.standard_normal((64, 2)))
        for side in (1, -1):
            centre = q[:, 0] + side * 0.087 * q[:, 1]           # cosine 0.985 between the centres
            for _ in range(25):
                rows.append((len(rows), (centre + 0.0035 * rng.standard_normal(64)).tolist(), 1, "x"))
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, VEC), folder)
    assert Counter(map(tuple, got.collect())) == brute_vectors([r[:3] for r in rows])


@pytest.mark.parametrize("recall", [1.0])
def test_audit_measures_recall(spark, folder, recall):
    rows = spark.createDataFrame([(i, "g", np.array([1.0, 0.001 * i], np.float32).tobytes(), 1) for i in range(30)],
                                 "id bigint, grp string, vec binary, copies bigint")
    links = spark.createDataFrame([(i, 29) for i in range(30)], "id bigint, links bigint")
    assert nn_descent.audit(rows, links, 0.98) == recall
    assert nn_descent.audit(rows, links.filter("id < 15"), 0.98) == 0.5


def test_audit_sees_isolated_lost_pairs(spark):
    """A dense cluster whose links are all known hides no lost pair, and a rare lost pair is seen by its near candidate."""
    rng = np.random.default_rng(6)
    cluster = [np.array([1.0, 0.001 * i] + [0.0] * 30, np.float32) for i in range(60)]
    pairs = [v + d for v in rng.standard_normal((10, 32)) for d in (0.0, 0.02 * rng.standard_normal(32))]
    vectors = cluster + pairs + list(rng.standard_normal((3000, 32)))
    points = spark.createDataFrame([(i, "g", v.astype(np.float32).tobytes(), 1) for i, v in enumerate(vectors)],
                                   "id bigint, grp string, vec binary, copies bigint")
    links = spark.createDataFrame([(i, 59) for i in range(60)], "id bigint, links bigint")
    near = spark.createDataFrame([(60 + i, 0.95) for i in range(20)], "id bigint, sim double")
    assert nn_descent.audit(points, links, 0.98, candidates=near) == pytest.approx(60 / 80)


def test_fresh_signatures_count_components(spark):
    """One lost pair among two components lowers the share to a half, however many links the other has."""
    fresh = spark.createDataFrame([(i, i + 1, 0.99) for i in range(5)] + [(20, 21, 0.985)], "a bigint, b bigint, sim double")
    known = spark.createDataFrame([(i, 0) for i in range(6)], "id bigint, component bigint")
    later = known.union(spark.createDataFrame([(20, 20), (21, 20)], "id bigint, component bigint"))
    assert nn_descent.recapture(fresh, known, later, 0.98, 10) == 0.5
    assert nn_descent.recapture(fresh, later, later, 0.98, 10) == 1.0
    assert nn_descent.recapture(fresh, known, later, 0.98, 3) == 0.0


def test_effort_grows_with_the_label():
    assert [nn_descent.effort(n, 0.98)[0] for n in (100, 10_000, 10_000_000)] == sorted({nn_descent.effort(n, 0.98)[0] for n in (100, 10_000, 10_000_000)})


def test_missed_recall_is_an_error(spark, folder, monkeypatch):
    monkeypatch.setattr(nn_descent, "audit", lambda *a, **b: 0.5)
    monkeypatch.setattr(nn_descent, "ATTEMPTS", 2)
    rows = [(i, [1.0, 0.001 * i], 1, "x") for i in range(5)]
    with pytest.raises(RuntimeError, match="0.5"):
        nn_descent.near_duplicates(spark.createDataFrame(rows, VEC), folder)
