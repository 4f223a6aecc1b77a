"""Exact integer k-means over blocks of vectors laid out along a Hilbert curve.

Vectors are sorted by their place on a Hilbert curve through the main directions of the start
centroids and cut into blocks; each block keeps the smallest and largest value of every
component (its box). In a round, the distances from a box to the centroids rule out those that
cannot be nearest to any of its vectors; only the rest are compared, exactly and vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint

#: Vectors of a block, directions of the curve and bits of each (their product is under 63).
BLOCK, AXES, BITS = 128, 8, 7
#: Largest scaled component: distances of 64 components up to it fit a long.
LARGEST = 1 << 27


def scaled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, of vectors with ``dims`` components, none null or non-finite."""
    x = F.col(vector)
    kept = vectors.where(F.size(x) == dims).where(F.forall(x, lambda a: a.isNotNull() & (F.abs(a.cast("double")) < float("inf"))))
    big = F.raise_error(F.lit(f"components must stay within +-{LARGEST // scale}"))
    whole = lambda a: F.when(F.abs(a.cast("double")) <= LARGEST // scale, F.floor(a.cast("double") * scale)).otherwise(big.cast("long"))
    return kept.select(F.col(key).alias("vec_id"), F.transform(x, whole).alias("v"))


def start_centroids(vectors: DataFrame, k: int = 40, salt: str = "2") -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with the smallest sha256 of ``salt:vec_id``; equal numbers by their components."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points``, whole numbers below 2 ** bits.

    From the highest bit down, each cube is turned so that the curve through it joins its
    neighbours (low coordinates reflected or exchanged with the first axis); a Gray code of the bits is the place.
    """
    x = points.astype(np.uint64).T.copy()
    axes, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip = np.where((x[-1] & q) != 0, flip ^ (q - one), flip)
    x ^= flip
    keys = np.zeros(len(points), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            keys = (keys << 1) | ((x[i] >> np.uint64(level)) & one).astype(np.int64)
    return keys


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(vectors: DataFrame, centroids: np.ndarray, n: int | None = None) -> DataFrame:
    """(ids, width, data, low, high): blocks of up to BLOCK vectors that follow each other on the curve.

    The curve runs through the main directions of the start centroids (cut at their spread), so
    the vectors near one centroid share blocks. Equal vectors lie together and spread over
    partitions by number. Only the layout depends on floating point, no result does.
    """
    center = centroids.mean(axis=0)
    axes = np.linalg.svd(centroids - center, full_matrices=False)[2][:AXES].T
    seen = (centroids - center) @ axes
    low, high = seen.min(axis=0), seen.max(axis=0)
    step = np.maximum(high - low, 1.0) / (1 << BITS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = ((_matrix(batch.column(1)) - center) @ axes - low) / step
                keys = hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["vec_id", "v", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                data = _matrix(some.column(1))
                box = data.min(axis=0), data.max(axis=0)
                width = 2 if -(1 << 15) <= box[0].min() and box[1].max() < 1 << 15 else 4
                rows.append((some.column(0).to_pylist(), width, data.astype(f"<i{width}").tobytes(), box[0].astype("<i8").tobytes(), box[1].astype("<i8").tobytes()))
            if rows:
                kinds = pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["ids", "width", "data", "low", "high"])

    placed = vectors.mapInArrow(place, "vec_id bigint, v array<bigint>, place bigint")
    ordered = (placed.repartitionByRange(n, "place", "vec_id") if n else placed.repartitionByRange("place", "vec_id")).sortWithinPartitions("place", "vec_id")
    return ordered.select("vec_id", "v").mapInArrow(cut, "ids array<bigint>, width int, data binary, low binary, high binary")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a point of the box, ascending.

    A centroid whose least distance to the box is more than another's greatest can win nowhere.
    """
    under, over = low - centroids, centroids - high
    gap = np.maximum(np.maximum(under, over), 0).astype(np.float64)
    far = np.maximum(np.abs(under), np.abs(over)).astype(np.float64)
    least, most = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
    return np.flatnonzero(least <= most.min() * (1 + 1e-9))


def nearest(data: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest row of ``centroids`` and its squared distance, exactly; the first of equals.

    Products go through doubles where all sums stay below 2 ** 53, else through whole numbers.
    """
    reach = max(int(np.abs(data).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * reach * reach * data.shape[1] < 1 << 53:
        a, b = data.astype(np.float64), centroids.astype(np.float64)
        away = (b * b).sum(axis=1) - 2 * (a @ b.T)
        best = away.argmin(axis=1)
        return best, (away[np.arange(len(a)), best] + (a * a).sum(axis=1)).astype(np.int64)
    away = np.stack([((data - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = away.argmin(axis=1)
    return best, away[np.arange(len(data)), best]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """(ids, vectors, centroid numbers, distances) of each block."""
    for batch in batches:
        ids, *rest = batch.columns
        for i in range(batch.num_rows):
            width, data, low, high = (c[i].as_py() for c in rest)
            rows = np.frombuffer(data, dtype=f"<i{width}").astype(np.int64).reshape(len(ids[i]), -1)
            some = candidates(np.frombuffer(low, "<i8"), np.frombuffer(high, "<i8"), centroids)
            best, distance = nearest(rows, centroids[some])
            yield ids[i].values, rows, some[best], distance


def _totals(laid: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, distance, sums) of each centroid's vectors; tasks send one row per centroid, at most k come back."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, rows, cluster, distance in _assigned(batches, centroids):
            n += np.bincount(cluster, minlength=k)
            np.add.at(inertia, cluster, distance)
            for c in np.unique(cluster):
                sums[c] += rows[cluster == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(inertia[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "inertia", "sums"],
        )

    parts = laid.mapInArrow(run, "cluster int, n bigint, inertia bigint, sums array<bigint>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    return parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), exact(F.col("inertia")).alias("inertia"), F.array(*[exact(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) after ``rounds`` rounds and one more assignment.

    Components become floor(scale * x); centroids stay whole numbers (floor of sum over count, in
    decimals, so no order of adding matters); ties go to the smaller number, empty centroids stay. Vectors
    that are null, of another length or hold null or non-finite components are left out; components past
    +-2 ** 27 / scale raise an error, as distances would not fit a long. Repeated rows are rows of their own. Fewer
    than k vectors give fewer centroids, none gives no rows. Other columns are not read.
    """
    v = scaled(vectors, key, vector, dims, scale)
    centroids = start_centroids(v, k)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    laid = checkpoint(blocks(v, centroids))
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _totals(laid, centroids):
            moved[r["cluster"]] = [int(s) // int(r["n"]) for s in r["sums"]]
        centroids = moved
    of = {r["cluster"]: int(r["inertia"]) for r in _totals(laid, centroids)}
    whole = sum(of.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, numbers, distance in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = laid.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")
    about = spark.createDataFrame([(c, of.get(c, 0), whole, centroids[c].tolist()) for c in range(len(centroids))], "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
