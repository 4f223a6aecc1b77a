"""Nearest neighbours by inner product from robust-pruned directed graphs, one for each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint

#: Share of the true neighbours that a shard's walk must find on so many of its own points.
GOAL, SAMPLE = 0.97, 128


def lifted(x: np.ndarray, top: float | None = None) -> np.ndarray:
    """Vectors with one more component, so that the nearest by distance has the largest inner product."""
    square = (x.astype(np.float64) ** 2).sum(1)
    top = square.max() if top is None else top
    return np.concatenate([x, np.sqrt(np.maximum(top - square, 0))[:, None]], 1).astype(np.float32)


def scaled(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Components divided by one power of two (one for each row with ``axis=1``), so that none exceeds 1: fit for single precision."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis, keepdims=True))[1])


def as_queries(x: np.ndarray) -> np.ndarray:
    """Queries as the graph's points: scaled each by itself, with nothing in the lifted component."""
    return np.concatenate([scaled(x, 1), np.zeros((len(x), 1))], 1).astype(np.float32)


class Graph:
    """Directed graph over points; greedy beam search walks it, robust pruning keeps its edges diverse."""

    def __init__(self, points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 5):
        self.x, self.degree, self.beam, self.alpha = points, degree, beam, alpha
        self.norm = (points**2).sum(1)
        n = len(points)
        rng = np.random.default_rng(seed)
        self.start = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
        self.edges = np.full((n, 2 * degree), -1, np.int32)
        self.filled = np.zeros(n, np.int64)
        if n <= degree + 1:
            for p in range(n):
                self._set(p, np.delete(np.arange(n), p))
            return
        self.edges[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
        self.filled[:] = degree // 2
        for _ in range(2):
            order = rng.permutation(n)
            for i in range(0, n, 256):
                self._insert(order[i : i + 256])

    def _set(self, p: int, to: np.ndarray) -> None:
        self.edges[p] = -1
        self.edges[p, : len(to)] = to
        self.filled[p] = len(to)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` nearest points met (-1: none) and their distances, nearest first.

        Of a beam a 24th is walked from at once, four points at least.
        """
        expand = max(4, beam // 24)
        n, m = len(self.x), len(queries)
        ids = np.full((m, beam), -1, np.int64)
        far = np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0] = self.start
        far[:, 0] = self.norm[self.start] - 2 * queries @ self.x[self.start]
        done[:, 0] = False
        seen[:, self.start] = True
        live = np.arange(m)
        while len(live):
            score = np.where(done[live], np.inf, far[live])
            pick = np.argpartition(score, min(expand, beam - 1), axis=1)[:, :expand]
            open_ = np.take_along_axis(score, pick, 1) < np.inf
            rows = np.repeat(live, pick.shape[1]).reshape(pick.shape)
            done[rows, pick] = True
            node = np.where(open_, np.take_along_axis(ids[live], pick, 1), -1)
            near = np.where(node[:, :, None] >= 0, self.edges[node], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            to = near[r, c]
            seen[live[r], to] = True
            width = int(fresh.sum(1).max()) if len(r) else 0
            if width:
                place = np.cumsum(fresh, 1)[r, c] - 1
                new_ids = np.full((len(live), width), -1, np.int64)
                new_far = np.full((len(live), width), np.inf, np.float32)
                new_ids[r, place] = to
                new_far[r, place] = self.norm[to] - 2 * np.einsum("ij,ij->i", self.x[to], queries[live[r]])
                all_far = np.concatenate([far[live], new_far], 1)
                keep = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
                far[live] = np.take_along_axis(all_far, keep, 1)
                ids[live] = np.take_along_axis(np.concatenate([ids[live], new_ids], 1), keep, 1)
                done[live] = np.take_along_axis(np.concatenate([done[live], new_ids < 0], 1), keep, 1)
            live = live[(~done[live]).any(1)]
        return ids, far + (queries**2).sum(1)[:, None]

    def _prune(self, p: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Robust pruning: of each row's candidates keep the nearest, drop those it is closer to (relaxed), and so on."""
        near = np.sort(np.where(near == p[:, None], -1, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        v = self.x[near]
        far = ((v - self.x[p][:, None]) ** 2).sum(2)
        far[near < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        norm = (v**2).sum(2)
        gap = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        alive = far < np.inf
        out = np.full((len(p), self.degree), -1, np.int32)
        count = np.zeros(len(p), np.int64)
        row = np.arange(len(p))
        for _ in range(self.degree):
            has = alive.any(1)
            if not has.any():
                break
            first = alive.argmax(1)
            out[row[has], count[has]] = near[row[has], first[has]]
            count[has] += 1
            alive &= ~((self.alpha**2 * gap[row, first] <= far) & has[:, None])
            alive[row[has], first[has]] = False
        return out, count

    def _insert(self, p: np.ndarray) -> None:
        met, _ = self.search(self.x[p], self.beam)
        out, count = self._prune(p, np.concatenate([met, self.edges[p]], 1))
        self.edges[p] = -1
        self.edges[p, : self.degree] = out
        self.filled[p] = count
        src, dst = np.repeat(p, count), out[out >= 0].astype(np.int64)
        there = (self.edges[dst] == src[:, None]).any(1)
        src, dst = src[~there], dst[~there]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        target, first, n = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, n) + np.repeat(self.filled[target], n)
        full = target[self.filled[target] + n > self.edges.shape[1]]
        fits = ~np.isin(dst, full)
        self.edges[dst[fits], place[fits]] = src[fits]
        ok = ~np.isin(target, full)
        self.filled[target[ok]] += n[ok]
        if len(full):
            at = {int(t): k for k, t in enumerate(full)}
            rest = np.flatnonzero(~fits)
            wide = np.full((len(full), int(n[~ok].max())), -1, np.int64)
            offset = np.arange(len(dst)) - np.repeat(first, n)
            wide[[at[int(t)] for t in dst[rest]], offset[rest]] = src[rest]
            for i in range(0, len(full), 256):
                t = full[i : i + 256]
                kept, count = self._prune(t, np.concatenate([self.edges[t].astype(np.int64), wide[i : i + 256]], 1))
                self.edges[t] = -1
                self.edges[t, : self.degree] = kept
                self.filled[t] = count


def fitted_beam(g: Graph, x: np.ndarray, k: int, beam: int, goal: float = GOAL, sample: int = SAMPLE) -> int:
    """The beam at which a walk finds a share of at least ``goal`` of the ``k`` largest inner products.

    Measured on ``sample`` points of the graph, evenly spaced, as queries against an exact comparison with all
    points of the shard; the beam doubles until it does, at most up to the number of points.
    """
    at = np.unique(np.linspace(0, len(x) - 1, min(sample, len(x))).astype(np.int64))
    k = min(k, len(x) - 1)
    if k < 1:
        return beam
    score = x[at] @ x.T
    score[np.arange(len(at)), at] = -np.inf
    least = np.partition(score, -k, axis=1)[:, -k]
    asked = as_queries(x[at])
    while beam < len(x):
        met, _ = g.search(asked, beam)
        hit = (np.take_along_axis(score, np.maximum(met, 0), 1) >= least[:, None]) & (met >= 0)
        if np.minimum(hit.sum(1), k).mean() >= goal * k:
            break
        beam *= 2
    return min(beam, len(x))


def _build(k: int, beam: int):
    def shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first_id")
        x = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        g = Graph(lifted(scaled(x)))
        ids = np.concatenate([np.asarray(i, np.int64) for i in group["ids"]])
        counts = np.array([len(i) for i in group["ids"]], np.int64)
        made = {"dim": int(key[0]), "shard": int(key[1]), "points": x.tobytes(), "edges": g.edges.tobytes(), "start": g.start, "beam": fitted_beam(g, scaled(x), k, beam)}
        return pd.DataFrame([made | {"ids": ids.tobytes(), "counts": counts.tobytes()}])

    return shard


def _search(k: int):
    def rows(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.frombuffer(r.points, np.float64).reshape(-1, r.dim)
                g = Graph.__new__(Graph)
                g.x = lifted(scaled(x))
                g.norm, g.start = (g.x**2).sum(1), int(r.start)
                g.edges = np.frombuffer(r.edges, np.int32).reshape(len(x), -1)
                counts = np.frombuffer(r.counts, np.int64)
                ids, first = np.frombuffer(r.ids, np.int64), np.concatenate([[0], np.cumsum(counts)])
                q_ids = np.asarray(r.query_ids, np.int64)
                q = np.frombuffer(b"".join(r.queries), np.float64).reshape(-1, r.dim)
                for i in range(0, len(q), 256):
                    part = q[i : i + 256]
                    met, _ = g.search(as_queries(part), int(r.beam))
                    at, col = np.nonzero(met >= 0)
                    node = met[at, col]
                    score = np.einsum("ij,ij->i", x[node], part[at])
                    n = counts[node]
                    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[node], n)
                    out = pd.DataFrame({"query_id": np.repeat(q_ids[i : i + 256][at], n), "vec_id": ids[pos], "score": np.repeat(score, n)})
                    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                    yield out.groupby("query_id", sort=False).head(k)

    return rows


def nearest(
    vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20,
    shard_points: int = 8192, query_block: int = 1024, beam: int = 96,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest found, largest inner product first.

    Vectors that are null, zero, or hold a null or non-finite component take no part. Vectors of
    another length than the query's are no candidates. Equal vectors are one point that keeps its
    k + 1 smallest numbers, which is all a query can return, so large groups of copies neither
    crowd the graph nor get lost; their numbers are ranked in salted groups first. Rows of a
    repeated number and vector count once. With fewer candidates than k all found are returned;
    ties go to the smaller number. Points are dealt by hash to shards of about ``shard_points``;
    one task builds a shard's graph, widens the beam from ``beam`` on until walks find enough (fitted_beam), and writes both. Queries travel in blocks of ``query_block``
    and search every shard. Graphs are walked in single precision, on components divided by a power
    of two; the beam's points are scored again on the original vectors in double precision.
    """
    v = F.transform(F.col(embedding), lambda e: e.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("embedding"), is_query.alias("is_query")).where("id is not null and embedding is not null")
    ok = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("embedding", lambda e: e != 0)
    rows = rows.where(ok).withColumn("key", F.xxhash64("embedding")).withColumn("dim", F.size("embedding"))
    salted = rows.dropDuplicates(["id", "key"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy("key", "embedding", "salt").orderBy("id")
    second = Window.partitionBy("key", "embedding").orderBy("id")
    few = salted.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).withColumn("n", F.row_number().over(second)).where(F.col("n") <= k + 1)
    points = few.groupBy("key", "embedding", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("first_id", F.col("ids")[0])
    points = checkpoint(points)
    total = points.count()
    shards = max(1, -(-total // shard_points))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    graphs = checkpoint(
        dealt.groupBy("dim", "shard").applyInPandas(_build(k, beam), "dim int, shard long, points binary, edges binary, start int, beam int, ids binary, counts binary")
    )

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return x.map(lambda e: np.asarray(e, np.float64).tobytes())

    asked = rows.where("is_query").dropDuplicates(["id", "key"])
    n_blocks = max(1, -(-asked.count() // query_block))
    blocks = (
        asked.select("id", "dim", packed("embedding").alias("q"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_blocks)).alias("block"))
        .groupBy("dim", "block").agg(F.collect_list(F.struct("id", "q")).alias("b"))
        .select("dim", F.col("b.id").alias("query_ids"), F.col("b.q").alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    )
    tasks = blocks.join(graphs, ["dim", "shard"]).repartition(max(1, min(n_blocks * shards, 100_000)))
    found = tasks.mapInPandas(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
