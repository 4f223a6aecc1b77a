"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint


def _two(x: tuple[str, str], y: tuple[str, str]) -> F.Column:
    """Two edges (u, v) of one row, so that what made the row is computed once."""
    return F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (x, y))))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction round over edges (u, v), u > v: neighbours are re-hung on the smallest one.

    large: every neighbour greater than the centre; else the centre and its smaller ones.
    """
    both = edges.select(_two(("u", "v"), ("v", "u"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    hung = both.join(low, both.u == low.c).select("u", "v", "m")
    out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(_two(("u", "m"), ("v", "m")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node at most, and none hangs on a node that hangs itself."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))))
    per = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least"))
    return per.where("hangs > 1 or (hangs = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest reachable node.

    The number of rounds grows with the logarithm of the longest path. Self loops and
    repeated edges are ignored; edges with a null end are dropped. Nodes without an edge are
    not returned. Each round is written to the checkpoint folder; none is run once every node hangs
    on its component. Given components (node, component) may be fed again as edges, with further ones.
    """
    cur = checkpoint(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _settled(cur):
            break
        cur = checkpoint(_star(_star(cur, True), False))
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
