"""Embedding near-duplicates by NN-descent.

Vectors are compared only within a label. Equal vectors are one point from the
start. Every point keeps the ``NEIGHBOURS`` best neighbours known so far inside
its component, and as many outside it (at first each point is a component):

1. Start: in each of several random-hyperplane signatures (so many that a pair
   at the threshold is expected to be missed with probability ``MISS``; they
   grow with the size of the largest label), points that are close in the sorted order of signatures become neighbours. A component's
   points that follow each other there count as one place for the others.
2. Refine: a point's neighbours (and those it is a neighbour of) are compared
   with each other; pairs that beat the worst entry of either list go in.
   Rounds end when few lists change.
3. Links are the pairs of cosine ``THRESHOLD`` or more; they join components.
   A list whose outside places are all links is saturated: it may miss some.
   The joined points then leave the outside places, and steps 1 to 3 go on
   until no list is saturated. At the end each component is compared in blocks;
   each point's links are counted without a list of pairs.
4. Audit, by points and components, so that dense clusters hide nothing:
   - fresh signatures find links that don't depend on the search so far. Of the
     components in which they find a link, the share is taken that was whole
     before (small and large components apart);
   - ``AUDIT`` linked points, as many unlinked ones with a near candidate, and
     as many others are compared with all points of their label.
   Steps 1 to 4 go on with fresh signatures until both shares are ``RECALL``
   or more; after ``ATTEMPTS`` without that, an error gives the shares.

Cosines are in double precision. A vector that is null, empty, zero or holds a
null or non-finite component, or has a null label, links with nothing and is
its own component. Vectors of different lengths aren't compared. Repeated rows
are linked copies (if valid); a null vec_id is a row like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, map_batches, stage

THRESHOLD = 0.98
NEIGHBOURS = 10
TABLES, BITS, ADJACENT = 8, 30, 2       # at least so many tables and bits
MISS = 0.01             # chance that the start misses a pair at the threshold
ROUNDS = 5
LEAST_CHANGE = 0.01     # of all list entries
AUDIT, RECALL, ATTEMPTS = 400, 0.99, 20
NEAR = 0.05             # an unlinked point's candidate so far below the threshold is near
WINDOW_ROWS = 20_000    # rows of a label whose signatures are sorted together
BLOCK = 512


def _points(batches):
    """Valid vectors as float32 bytes and their digest."""
    for b in batches:
        out = {"_rid": b["_rid"], "point": [], "vec": []}
        for v in b["embedding"]:
            point = raw = None
            if v and None not in v:
                x = np.asarray(v, dtype=np.float32) + np.float32(0)         # -0 is 0
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
                    point = hashlib.blake2b(raw, digest_size=16).digest()
            out["point"].append(point)
            out["vec"].append(raw)
        yield out


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length, double precision."""
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)           # no overflow or underflow in the squares
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def effort(n: int, threshold: float) -> tuple[int, int]:
    """Tables and bits for labels of ``n`` points. A pair is adjacent in a table
    if it shares the bits that set its place apart from n others, and two more."""
    bits = math.log2(max(2, n)) + 2
    share = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    tables = math.ceil(math.log(MISS) / math.log(1 - share)) if 0 < share < 1 else 1
    return max(TABLES, tables), max(BITS, math.ceil(bits) + 4)


def _signatures(seed: int, tables: int, n_bits: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            out = {"id": [], "grp": [], "own": [], "tab": [], "sig": []}
            by_size: dict[int, list[int]] = {}
            for k, raw in enumerate(b["vec"]):
                by_size.setdefault(len(raw) // 4, []).append(k)
            for size, at in by_size.items():
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, tables * n_bits))
                bits = (unit([b["vec"][k] for k in at]) @ planes[size] > 0).reshape(len(at), tables, n_bits)
                sig = (bits * (1 << np.arange(n_bits - 1, -1, -1))).sum(axis=2)
                for t in range(tables):
                    out["id"] += [b["id"][k] for k in at]
                    out["grp"] += [b["grp"][k] for k in at]
                    out["own"] += [b["own"][k] for k in at]
                    out["tab"] += [t] * len(at)
                    out["sig"] += sig[:, t].tolist()
            yield out

    return run


def start_pairs(points: DataFrame, n: int, seed: int, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """Pairs ``a, b, inside`` of points that are near in the order of a
    signature: the next points, and the next ones of other components, where
    only the first and last of a component's neighbours in the order stand."""
    sig = map_batches(points.select("id", "grp", "own", "vec"), _signatures(seed, tables, bits), "id bigint, grp string, own bigint, tab int, sig bigint")
    split = max(0, math.ceil(math.log2(max(1, n / WINDOW_ROWS))))
    w = Window.partitionBy("grp", "tab", F.shiftright("sig", max(0, bits - split))).orderBy("sig", "id")

    def following(rows: DataFrame) -> DataFrame:
        after = F.array(*[F.struct(F.lead("id", k).over(w).alias("b"), F.lead("own", k).over(w).alias("own_b"))
                          for k in range(1, ADJACENT + 1)])
        return rows.select("id", "own", after.alias("after")).select(
            F.col("id").alias("a"), "own", F.explode("after").alias("x")).filter("x.b IS NOT NULL").select(
            "a", F.col("x.b").alias("b"), (F.col("own") == F.col("x.own_b")).alias("inside"))

    ends = sig.withColumns({"before": F.lag("own").over(w), "after": F.lead("own").over(w)}).filter(
        "NOT (before <=> own AND after <=> own)").drop("before", "after")
    return following(sig).union(following(ends).filter("NOT inside")).distinct()


def _cosines(batches):
    for b in batches:
        out = {"a": [], "b": [], "inside": b["inside"], "sim": [0.0] * len(b["a"])}
        if b["a"]:
            by_size: dict[int, list[int]] = {}
            for k, raw in enumerate(b["va"]):
                by_size.setdefault(len(raw), []).append(k)
            for at in by_size.values():
                sim = (unit([b["va"][k] for k in at]) * unit([b["vb"][k] for k in at])).sum(axis=1)
                for k, x in zip(at, sim.tolist()):
                    out["sim"][k] = x
            out["a"], out["b"] = b["a"], b["b"]
        yield out


def with_cosine(pairs: DataFrame, points: DataFrame) -> DataFrame:
    a = points.select(F.col("id").alias("a"), F.col("vec").alias("va"))
    b = points.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "inside", "va", "vb"), _cosines,
                       "a bigint, b bigint, inside boolean, sim double")


def best(entries: DataFrame, k: int) -> DataFrame:
    """The k best distinct entries inside and outside of each list; fresh: not known before."""
    one = entries.groupBy("src", "dst", "inside").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("src", "inside").orderBy(F.desc("sim"), "dst")
    return one.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


def both_ways(pairs: DataFrame) -> DataFrame:
    return (pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "inside", "sim", F.lit(1).alias("fresh"))
            .union(pairs.select(F.col("b"), F.col("a"), "inside", "sim", F.lit(1))))


def known_entries(lists: DataFrame, points: DataFrame) -> DataFrame:
    """Entries of earlier lists, inside or outside by the components of now."""
    src = points.select(F.col("id").alias("src"), F.col("own").alias("_s"))
    dst = points.select(F.col("id").alias("dst"), F.col("own").alias("_d"))
    return lists.join(src, "src").join(dst, "dst").select(
        "src", "dst", (F.col("_s") == F.col("_d")).alias("inside"), "sim", F.lit(0).alias("fresh"))


def _local_join(batches):
    """Compare the members of each point's neighbourhood with each other: give
    the pairs with a new entry that beat the worst entry of either list, among
    those inside or outside the component."""
    for b in batches:
        out = {"src": [], "dst": [], "inside": [], "sim": []}
        for members in b["m"]:
            if len(members) < 2:
                continue
            ids = np.array([x["id"] for x in members])
            own = np.array([x["own"] for x in members])
            same = own[:, None] == own[None, :]
            floor = np.where(same, np.array([x["floor_in"] for x in members])[:, None], np.array([x["floor_out"] for x in members])[:, None])
            fresh = np.array([x["fresh"] for x in members], bool)
            x = unit([x["vec"] for x in members])
            sim = x @ x.T
            new = fresh[:, None] | fresh[None, :]
            i, j = np.nonzero(new & (sim > floor) & (ids[:, None] != ids[None, :]))
            out["src"] += ids[i].tolist()
            out["dst"] += ids[j].tolist()
            out["inside"] += same[i, j].tolist()
            out["sim"] += sim[i, j].tolist()
        yield out


def refine(lists: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """One round: lists ``src, dst, inside, sim, fresh`` -> improved lists."""
    floors = lists.groupBy("src").agg(*[
        F.when(F.count_if(c) >= k, F.min(F.when(c, F.col("sim")))).otherwise(-2.0).alias(name)
        for c, name in ((F.col("inside"), "floor_in"), (~F.col("inside"), "floor_out"))])
    known = points.join(floors, points["id"] == floors["src"]).select("id", "own", "vec", "floor_in", "floor_out")
    around = best(lists.select("src", "dst", "inside", "sim", "fresh").union(
        lists.select(F.col("dst"), F.col("src"), "inside", "sim", "fresh")), 2 * k)
    groups = (around.join(known, around["dst"] == known["id"]).groupBy("src")
              .agg(F.collect_list(F.struct("id", "own", "vec", "floor_in", "floor_out", "fresh")).alias("m")).filter("exists(m, x -> x.fresh = 1)"))
    new = map_batches(groups.select("m"), _local_join, "src bigint, dst bigint, inside boolean, sim double")
    return best(lists.select("src", "dst", "inside", "sim", F.lit(0).alias("fresh")).union(new.distinct().withColumn("fresh", F.lit(1))), k)


def saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """Points whose outside places are all links: more may have found no place."""
    return lists.filter(~F.col("inside") & (F.col("sim") >= threshold)).groupBy("src").count().filter(F.col("count") >= k)


def _count_block(threshold: float):
    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["own"] == key[1]], pdf[pdf["own"] == key[2]]
        sim = unit(left["vec"].tolist()) @ unit(right["vec"].tolist()).T >= threshold
        if key[1] == key[2]:
            np.fill_diagonal(sim, False)
            return pd.DataFrame({"id": left["id"], "links": (sim @ right["copies"].to_numpy()).astype(np.int64)})
        return pd.DataFrame({"id": np.concatenate([left["id"], right["id"]]),
                             "links": np.concatenate([sim @ right["copies"].to_numpy(), left["copies"].to_numpy() @ sim]).astype(np.int64)})

    return count


def count_links(comp: DataFrame, points: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links of each point within its component, by pairs of blocks: ``id, links``."""
    sizes = comp.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = comp.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    placed = (own.join(points.select("id", "vec", "copies"), "id")
              .select("component", "id", "vec", "copies", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
              .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}))
    got = placed.groupBy("component", "lo", "hi").applyInPandas(_count_block(threshold), "id bigint, links bigint")
    return got.groupBy("id").agg(F.sum("links").alias("links"))


def recapture(fresh: DataFrame, comp: DataFrame, later: DataFrame, threshold: float, small: int) -> float:
    """Share of the components (``later``) with a link in ``fresh`` that were
    whole before (``comp``, none of whose links come from ``fresh``); the lower
    share of those of up to ``small`` points and of the others."""
    old = comp.toDF("a", "old_a"), comp.toDF("b", "old_b")
    sizes = later.groupBy("component").agg(F.count("*").alias("size"))
    links = (fresh.filter(F.col("sim") >= threshold).join(later.withColumnRenamed("id", "a"), "a")
             .join(old[0], "a", "left").join(old[1], "b", "left"))
    seen = links.groupBy("component").agg(F.min(F.coalesce("old_a", "a") == F.coalesce("old_b", "b")).alias("whole"))
    shares = seen.join(sizes, "component").groupBy(F.col("size") <= small).agg(F.avg(F.col("whole").cast("int")).alias("share"))
    return min((r["share"] for r in shares.collect()), default=1.0)


def audit(points: DataFrame, links: DataFrame, threshold: float, size: int = AUDIT, candidates: DataFrame | None = None) -> float:
    """Estimated share of the points with true links whose links ``links`` (id,
    links) holds in full: ``size`` points (chosen by hash) of each stratum are
    compared with every point of their group. Strata: linked points, unlinked
    ones whose best candidate (``candidates``: id, sim) is near, the others."""
    near = points.select("id").limit(0).withColumn("sim", F.lit(0.0)) if candidates is None else candidates
    strata = (points.join(links.filter("links > 0").select("id", F.lit(True).alias("linked")), "id", "left").join(near, "id", "left")
              .select("id", "grp", "vec", F.when(F.col("linked"), 0).when(F.col("sim") >= threshold - NEAR, 1).otherwise(2).alias("stratum")))
    total = {r["stratum"]: r["count"] for r in strata.groupBy("stratum").count().collect()}
    asked = [r for k in total for r in strata.filter(F.col("stratum") == k).orderBy(F.xxhash64("id")).limit(size).collect()]
    weight = {r["id"]: total[r["stratum"]] / min(size, total[r["stratum"]]) for r in asked}
    by_grp: dict[str, list] = {}
    for r in asked:
        by_grp.setdefault(r["grp"], []).append(r)
    sets = {g: (np.array([r["id"] for r in v]), unit([bytes(r["vec"]) for r in v])) for g, v in by_grp.items()}

    def run(batches):
        for b in batches:
            out = {"id": [], "n": []}
            at: dict[str, list[int]] = {}
            for k, g in enumerate(b["grp"]):
                if g in sets:
                    at.setdefault(g, []).append(k)
            for g, ks in at.items():
                ids, x = sets[g]
                sim = x @ unit([b["vec"][k] for k in ks]).T >= threshold
                sim &= ids[:, None] != np.array([b["id"][k] for k in ks])[None, :]
                out["id"] += ids.tolist()
                out["n"] += (sim @ np.array([b["copies"][k] for k in ks])).tolist()
            yield out

    true = (map_batches(points.select("id", "grp", "vec", "copies"), run, "id bigint, n bigint").groupBy("id")
            .agg(F.sum("n").alias("n")).filter("n > 0"))
    rows = true.join(links, "id", "left").select("id", (F.coalesce("links", F.lit(0)) >= F.col("n")).alias("whole")).collect()
    share = sum(weight[r["id"]] for r in rows)
    return sum(weight[r["id"]] for r in rows if r["whole"]) / share if share else 1.0


def near_duplicates(vectors: DataFrame, folder: str, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS,
                    recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``
    (vec_id, embedding, label)."""
    rows = stage(vectors.select("vec_id", "embedding", "label").withColumn("_rid", F.monotonically_increasing_id()), folder, "rows")
    made = stage(map_batches(rows.select("_rid", "embedding"), _points, "_rid bigint, point binary, vec binary"), folder, "made")
    valid = (rows.select("_rid", "vec_id", "label").filter("label IS NOT NULL").join(made.filter("point IS NOT NULL"), "_rid")
             .withColumn("grp", F.concat_ws(":", F.col("label").cast("string"), F.octet_length("vec"))))
    classes = stage(valid.groupBy("grp", "point").agg(F.min("_rid").alias("id"), F.count("*").alias("copies"),
                                                      F.min("vec_id").alias("least")), folder, "classes")
    points = stage(classes.join(made.select(F.col("_rid").alias("id"), "vec"), "id").select("id", "grp", "vec", "copies"), folder, "points")
    per_group = points.groupBy("grp").count().agg(F.sum("count"), F.max("count")).first()
    n = per_group[0] or 0
    tables, bits = effort(per_group[1] or 0, threshold)
    lists = comp = None
    attempt, passed = 0, False
    while not passed:
        placed = points.withColumn("own", F.col("id")) if comp is None else (
            points.join(comp, "id", "left").withColumn("own", F.coalesce("component", "id")).drop("component"))
        fresh = stage(with_cosine(start_pairs(placed, n, attempt, tables, bits), points), folder, f"fresh-{attempt}")
        lists = stage(best(both_ways(fresh) if lists is None else both_ways(fresh).union(known_entries(lists, placed)), neighbours),
                      folder, f"lists-{attempt}-0")
        for k in range(1, ROUNDS + 1):
            lists = stage(refine(lists, placed, neighbours), folder, f"lists-{attempt}-{k}")
            if lists.filter("fresh = 1").count() <= LEAST_CHANGE * n * neighbours:
                break
        near = lists.filter(F.col("sim") >= threshold).select(F.col("src").alias("a"), F.col("dst").alias("b")).union(
            fresh.filter(F.col("sim") >= threshold).select("a", "b"))
        near = near if comp is None else near.union(comp.filter("id <> component").toDF("a", "b"))
        before, comp = comp, components(near, f"{folder}/components-{attempt}")
        attempt += 1
        # A saturated list's points are joined now: their places are free for others.
        full = not saturated(lists, neighbours, threshold).isEmpty()
        again = 0.0 if before is None else recapture(fresh, before, comp, threshold, neighbours)
        compared = None
        if not full and again >= recall:
            links = stage(count_links(comp, points, threshold), folder, f"links-{attempt}")
            candidates = lists.groupBy(F.col("src").alias("id")).agg(F.max("sim").alias("sim"))
            compared = audit(points, links, threshold, candidates=candidates)
            passed = compared >= recall
        if not passed and attempt >= ATTEMPTS:
            raise RuntimeError(f"near duplicates after {attempt} attempts: recall {recall} not reached; share of components found "
                               f"again {again}, of compared points {compared}, saturated lists {full}")
    per = (classes.join(links, "id", "left").join(comp, "id", "left")
           .select("grp", "point", "least", F.coalesce("component", "id").alias("component"),
                   (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    per = stage(per, folder, "per-class")
    low = per.groupBy("component").agg(F.min("least").alias("component_id"))
    mine = valid.select("_rid", "grp", "point").join(per.drop("least"), ["grp", "point"]).join(low, "component")
    out = rows.select("_rid", "vec_id").join(mine.select("_rid", "n_links", "component_id"), "_rid", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
