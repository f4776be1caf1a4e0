"""Exact top-k by inner product: ball-tree branch and bound in every shard.

Centroids, fitted on a bounded sample, part the vectors into clusters, and clusters into shards of bounded size. A task
builds one tree for a shard and streams its queries past it. Rounds go from the most promising shard outward: every query
first searches one shard of its best cluster, then that cluster's others, then all clusters; the k-th score found so far goes with
it, and neither shards nor nodes whose upper bound is below it are opened. Scores are whole numbers, so no rounding can drop a tie:
where the lengths of two vectors allow a sum of 2^53 or more, their score is computed in integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.scratch import Scratch

#: A score below every possible one; scores beyond 64 bits count as the least or greatest number of 64 bits behind it.
NOTHING, LEAST, GREATEST = -(2**63), -(2**63) + 1, 2**63 - 1
#: From here on, doubles don't hold all whole numbers.
EXACT = 2.0**53
#: The cluster, around the origin, of vectors whose squared length reaches that: they would pull any centroid away.
HUGE = -1


def inner_products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """queries x points: inner products of whole numbers held as doubles, exact, cut to 64 bits."""
    found = np.zeros((len(queries), len(points)), np.int64)
    longest = np.sqrt((points**2).sum(axis=1)).max(initial=0.0)
    # No sum of products exceeds the product of the lengths, so below the limit every partial sum is exact.
    wide = np.sqrt((queries**2).sum(axis=1)) * longest * (1 + 1e-9) >= EXACT
    found[~wide] = (queries[~wide] @ points.T).astype(np.int64)
    if wide.any():
        whole = [[int(x) for x in p] for p in points]
        for i in np.flatnonzero(wide):
            q = [int(x) for x in queries[i]]
            found[i] = [min(max(sum(a * b for a, b in zip(q, p, strict=True)), LEAST), GREATEST) for p in whole]
    return found


class BallTree:
    """Nodes are ranges of a permutation of the rows, split at the median of the widest dimension."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 128):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order].copy(), points[order].copy()
        self.nodes: list[tuple] = []
        self._build(0, len(ids), leaf)

    def _build(self, a: int, b: int, leaf: int) -> int:
        points = self.points[a:b]
        center = points.mean(axis=0)
        radius = float(np.sqrt(((points - center) ** 2).sum(axis=1).max()))
        node, children = len(self.nodes), ()
        self.nodes.append(())
        spread = points.max(axis=0) - points.min(axis=0)
        if b - a > leaf and spread.max() > 0:
            axis = int(spread.argmax())
            middle = (b - a) // 2
            order = np.argpartition(points[:, axis], middle)
            # Ids stay in order inside each half, so that ties in a leaf go to the smaller id.
            order = np.concatenate([np.sort(order[:middle]), np.sort(order[middle:])])
            self.ids[a:b], self.points[a:b] = self.ids[a:b][order], points[order]
            children = (self._build(a, a + middle, leaf), self._build(a + middle, b, leaf))
        self.nodes[node] = (a, b, center, radius, int(self.ids[a:b].min()), children)
        return node

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each queries x k, best first, ties to the smaller id; ``floor`` is a k-th score known from elsewhere. Missing: NOTHING."""
        scores = np.full((len(queries), k), NOTHING, np.int64)
        ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        lengths = np.sqrt((queries**2).sum(axis=1))

        def visit(node: int, active: np.ndarray) -> None:
            a, b, center, radius, least_id, children = self.nodes[node]
            # The slack covers the rounding of centre, radius, lengths and of what is added up; scores themselves are exact.
            bound = queries[active] @ center + lengths[active] * radius
            bound += 1e-6 + 1e-9 * lengths[active] * (np.sqrt((center**2).sum()) + radius)
            bound[np.isnan(bound)] = np.inf  # lengths beyond what doubles hold close nothing
            worst = np.maximum(scores[active, -1], floor[active])
            # At an equal score only a smaller id could still enter a full list.
            open_ = (bound > worst) | ((bound >= worst) & (least_id < ids[active, -1]))
            active = active[open_]
            if not len(active):
                return
            if children:
                # Every query goes to the child of its own higher bound first.
                left, right = (queries[active] @ self.nodes[c][2] + lengths[active] * self.nodes[c][3] for c in children)
                for c, own in ((0, left >= right), (1, left < right), (1, left >= right), (0, left < right)):
                    if own.any():
                        visit(children[c], active[own])
                return
            for lo in range(a, b, 4096):  # a leaf of equal points may be large
                self._merge(scores, ids, query_ids, queries, active, lo, min(b, lo + 4096), k)

        visit(0, np.arange(len(queries)))
        return scores, ids

    def _merge(self, scores, ids, query_ids, queries, active, a, b, k) -> None:
        found = inner_products(queries[active], self.points[a:b])
        own = self.ids[a:b]
        found[query_ids[active][:, None] == own[None, :]] = NOTHING
        if b - a > k:
            # Rank in the leaf breaks ties: ids ascend inside it.
            at = np.argsort(~found, axis=1, kind="stable")[:, :k]
            found, own = np.take_along_axis(found, at, 1), own[at]
        else:
            own = np.broadcast_to(own, found.shape)
        own = np.where(found == NOTHING, np.iinfo(np.int64).max, own)
        all_scores, all_ids = np.concatenate([scores[active], found], 1), np.concatenate([ids[active], own], 1)
        at = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
        scores[active], ids[active] = np.take_along_axis(all_scores, at, 1), np.take_along_axis(all_ids, at, 1)


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, point array<double> of whole numbers: floor(256 * x), x as double, exact whatever its size.

    Left out are null vectors and ids, and vectors with null, NaN or infinite components (as doubles: also where 256 * x is infinite).
    """
    whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)
    x = F.transform(F.col(embedding).cast("array<double>"), lambda v: whole(v * 256))
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * 256) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("point"))


def fit_centroids(points: np.ndarray, clusters: int, seed: int = 3, steps: int = 8) -> np.ndarray:
    """Centroids by k-means steps on a sample; at most as many as there are different points."""
    points = np.unique(points, axis=0)
    centers = points[np.random.default_rng(seed).permutation(len(points))[:clusters]]
    for _ in range(steps):
        near = (points @ centers.T * 2 - (centers**2).sum(axis=1)).argmax(axis=1)
        centers = np.stack([points[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
    return centers


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, rows_a_shard: int = 20_000, queries_a_block: int = 50_000, sample_rows: int = 4_096, clusters: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of the highest inner product for each query, ties to the smaller vec_id.

    Both inputs are rows of :func:`quantized`. A query id counts once, with the least of its vectors if it is there
    repeatedly, and is no candidate of its own; a repeated row is a candidate each time. Scores are cut to 64 bits. With fewer candidates there are fewer rows, with none no row. Vectors of unequal dimensions never meet.
    ``sample_rows`` (those of the smallest id hashes) and ``clusters`` bound what the centroids are fitted on; every vector is
    indexed and searched. A shard's vectors are copied once for each ``queries_a_block`` queries that reach it.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    dims = F.size("point").alias("dims")
    sample = vectors.select("vec_id", "point", dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    centers: dict[int, np.ndarray] = {}  # by dimensions, in all ``sample_rows`` vectors at most
    for d in {r["dims"] for r in sample}:
        own = [r["point"] for r in sample if r["dims"] == d]
        own = np.array(own, np.float64).reshape(len(own), d)
        own = own[(own**2).sum(axis=1) < EXACT]
        # The last row is the origin, the centre of HUGE.
        centers[d] = np.concatenate([fit_centroids(own, clusters) if len(own) else np.zeros((1, d)), np.zeros((1, d))])
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for d, part in rows.groupby("dims"):
                points = np.stack(part["point"].to_numpy()).reshape(len(part), d)
                centers = shared.value.get(d, np.zeros((2, d)))
                near = (points @ centers[:-1].T * 2 - (centers[:-1] ** 2).sum(axis=1)).argmax(axis=1)
                near[~((points**2).sum(axis=1) < EXACT)] = HUGE
                yield part.assign(cluster=near.astype(np.int32), away=np.sqrt(((points - centers[near]) ** 2).sum(axis=1)))

    stored = scratch.keep(vectors.select("vec_id", "point", dims).mapInPandas(assign, "vec_id long, point array<double>, dims int, cluster int, away double"), "stored")
    # At most ``clusters`` rows for each number of dimensions.
    balls = {(r["dims"], r["cluster"]): (r["radius"], max(1, -(-r["n"] // rows_a_shard))) for r in stored.groupBy("dims", "cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("point").alias("wanted")).withColumn("dims", F.size("wanted"))

    def route(step: int):
        """The shards that a query still has to search in a round, as (cluster, salt): only those whose bound reaches its k-th score."""

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for d, part in rows.groupby("dims"):
                    own = sorted(c for e, c in balls if e == d)
                    if not own:
                        continue
                    points = np.stack(part["wanted"].to_numpy()).reshape(len(part), d)
                    radius = np.array([balls[d, c][0] for c in own])
                    near, lengths = shared.value.get(d, np.zeros((2, d)))[own], np.sqrt((points**2).sum(axis=1))[:, None]
                    bound = points @ near.T + lengths * radius
                    bound += 1e-6 + 1e-9 * lengths * (np.sqrt((near**2).sum(axis=1)) + radius)
                    bound[np.isnan(bound)] = np.inf
                    # HUGE has the highest bounds, but too few vectors to tell a k-th score.
                    best = np.where(np.array(own) == HUGE, -np.inf, bound).argmax(axis=1)
                    out = []
                    for i, (query, floor) in enumerate(zip(part["query_id"].tolist(), part["floor"].tolist(), strict=True)):
                        for j in [best[i]] if step < 2 else np.flatnonzero(bound[i] >= floor):
                            if step == 2 and j == best[i]:
                                continue
                            salts = balls[d, own[j]][1]
                            home = query % salts
                            out += [(i, own[j], s) for s in range(salts) if (s == home) == (step == 0) or step == 2]
                    at = [x[0] for x in out]
                    yield part.iloc[at].assign(cluster=np.array([x[1] for x in out], np.int32), salt=np.array([x[2] for x in out], np.int32))

        return of

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, tree = None, [], None
        for rows in batches:
            for own, part in rows.groupby(["dims", "cluster", "salt", "block"], sort=False):
                if own != key:
                    key, held, tree = own, [], None
                stored_rows, wanted = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(stored_rows):
                    held.append((stored_rows["id"].to_numpy(), np.stack(stored_rows["point"].to_numpy())))
                if not len(wanted) or not held:
                    continue
                tree = tree or BallTree(*(np.concatenate(x) for x in zip(*held, strict=True)))
                ids = wanted["id"].to_numpy()
                scores, found = tree.search(ids, np.stack(wanted["point"].to_numpy()), wanted["floor"].to_numpy(), k)
                there = scores > NOTHING
                yield pd.DataFrame({"query_id": np.repeat(ids, k).reshape(scores.shape)[there], "vec_id": found[there], "score": scores[there]})

    salts = F.array(*[F.lit(balls[key][1]) for key in sorted(balls)]) if balls else F.array(F.lit(1))  # a literal for each cluster
    ball = F.array_position(F.array(*[F.lit(f"{d}-{c}") for d, c in sorted(balls)]) if balls else F.array(F.lit("")), F.concat_ws("-", "dims", "cluster"))
    salt = F.pmod(F.xxhash64("vec_id"), F.element_at(salts, ball.cast("int"))).cast("int").alias("salt")
    columns = ("dims", "cluster", "salt", "block", "kind", "id", "point", "floor")
    best, schema = None, "query_id long, vec_id long, score long"
    for step in range(3):
        floors = asked.withColumn("floor", F.lit(NOTHING)) if best is None else asked.join(best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(NOTHING).alias("floor")), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NOTHING)))
        routed = scratch.keep(floors.mapInPandas(route(step), "query_id long, wanted array<double>, dims int, floor long, cluster int, salt int"), f"routed-{step}")
        reached = routed.groupBy("dims", "cluster", "salt").agg(F.ceil(F.count("*") / queries_a_block).cast("int").alias("blocks"))
        wanted = routed.join(reached, ["dims", "cluster", "salt"]).select("dims", "cluster", "salt", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("wanted").alias("point"), "floor")
        held = stored.select("dims", "cluster", salt, F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "point", F.lit(0).cast("long").alias("floor")).join(reached, ["dims", "cluster", "salt"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = held.select(*columns).unionByName(wanted.select(*columns)).repartition("dims", "cluster", "salt", "block").sortWithinPartitions("dims", "cluster", "salt", "block", "kind")
        found = dealt.mapInPandas(search, schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
        ranked = (found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)).select("*", rank).where(F.col("rank") <= k)
        best = scratch.keep(ranked, f"best-{step}")
    return scratch.last(best.select("query_id", "rank", "vec_id", "score"), "top")
