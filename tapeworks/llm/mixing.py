"""Mixing sources by temperature; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint

NO_SOURCE = "\u0000"


def n_tokens(text: Column) -> Column:
    """Number of words between white space; none in a null or blank text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s++", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(F.rtrim(t), r"\s++"))).cast("long")


def token_shares(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(source_key, n_docs, n_tokens) for each source; a null source is one of its own."""
    key = F.coalesce(F.col(source), F.lit(NO_SOURCE))
    return docs.select(key.alias("source_key"), n_tokens(F.col(text)).alias("n")).groupBy("source_key").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens")
    )


def find_exponent(shares: DataFrame, entropy: float = 0.95, max_repeats: float = 4.0, ways: int = 16, rounds: int = 8) -> float:
    """Exponent in [0, 1] for the shares: the largest that meets the target entropy, or more if it repeats too much.

    Weights are shares ** exponent, normalised. ``entropy`` is a part of the largest possible
    entropy. The least exponent within the repetition limit (the ratio of the most to the least
    often read source) bounds it from below. Both measures fall with the exponent, so each is
    bisected: every round cuts the interval into ``ways`` parts with one aggregate over the
    sources, and only its ``ways`` rows of sums come to the driver. Without tokens, or with one
    source, it is 1.
    """
    live = shares.where("n_tokens > 0")
    total = live.agg(F.sum("n_tokens"), F.count("*")).first()
    if not total[0] or total[1] < 2:
        return 1.0
    p = live.select((F.col("n_tokens") / F.lit(float(total[0]))).alias("p"))
    target = entropy * math.log(total[1])

    def measure(points: list[float]) -> dict[float, tuple[float, float]]:
        rows = (
            p.select("p", F.explode(F.array(*[F.lit(x) for x in points])).alias("e"))
            .groupBy("e").agg(
                F.sum(F.pow("p", "e")).alias("z"), F.sum(F.pow("p", "e") * F.log("p")).alias("s"),
                F.max(F.pow(F.col("p"), F.col("e") - 1)).alias("hi"), F.min(F.pow(F.col("p"), F.col("e") - 1)).alias("lo"),
            ).collect()
        )
        return {r["e"]: (math.log(r["z"]) - r["e"] * r["s"] / r["z"], r["hi"] / r["lo"]) for r in rows}

    def bisect(good) -> tuple[float, float]:
        """The interval whose lower end is good and whose upper end is not."""
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            points = [lo + (hi - lo) * k / ways for k in range(1, ways)]
            got = measure(points)
            best = max([x for x in points if good(*got[x])], default=lo)
            lo, hi = best, min([x for x in points if x > best], default=hi)
        return lo, hi

    h1, _ = measure([1.0])[1.0]
    by_entropy = 1.0 if h1 >= target else bisect(lambda h, r: h >= target)[0]
    _, r0 = measure([0.0])[0.0]
    by_repeats = 0.0 if r0 <= max_repeats else bisect(lambda h, r: r > max_repeats)[1]
    return max(by_entropy, by_repeats)


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", entropy: float = 0.95,
    max_repeats: float = 4.0, budget: int | None = None, block_docs: int = 2000, seed: int = 7,
) -> DataFrame:
    """Every row as often as its source's budget asks, with ``__n_tokens, __weight, __epoch, __block, __place``.

    Weights are the sources' token shares to the power of ``find_exponent``, normalised. The budget
    in tokens (by default the smallest at which every source is read once as a whole, so nothing
    is lost) is split by weight. A source is read in epochs. In each epoch its blocks (hash buckets
    of about ``block_docs`` rows) come in another pseudo-random order and the rows of a block in
    the order of their hashes; the last epoch ends before the first row that would pass the
    budget. ``__place`` (0 to 1) is where the row comes in the source's sequence, so sorting by it
    interleaves the sources evenly.

    Blocks are summed before they are ordered, so no task sorts the rows of a whole source. Rows
    without words take no budget and come once in each epoch. A null source is a source of its
    own. Repeated rows are rows like any other. An empty table gives an empty result. The table's own
    columns travel as one, so none clashes with a helper; those that bear a result's name give way to it.
    """
    new = ["__n_tokens", "__weight", "__epoch", "__block", "__place"]
    shares = checkpoint(token_shares(docs, text, source))
    exponent = find_exponent(shares, entropy, max_repeats)
    sums = shares.where("n_tokens > 0").agg(
        F.sum("n_tokens").cast("double").alias("t"), F.count("*").alias("k")
    ).first()
    total = sums["t"] or 1.0
    power = F.pow(F.col("n_tokens") / F.lit(total), F.lit(exponent))
    z = shares.where("n_tokens > 0").agg(F.sum(power).alias("z"), F.max(F.col("n_tokens") / power).alias("m")).first()
    tokens = float(budget) if budget is not None else float((z["m"] or 0.0) * (z["z"] or 0.0))
    plan = shares.select(
        F.col("source_key").alias("__key"), "n_docs", F.col("n_tokens").alias("__source_tokens"),
        F.when(F.col("n_tokens") > 0, power / F.lit(z["z"] or 1.0)).otherwise(0.0).alias("weight"),
        F.ceil(F.col("n_docs") / F.lit(block_docs)).alias("__n_blocks"),
    )
    plan = plan.withColumn("__asked", F.col("weight") * F.lit(tokens)).withColumn(
        "__epochs", F.when(F.col("__source_tokens") > 0, F.floor(F.col("__asked") / F.col("__source_tokens") + F.lit(1e-9))).otherwise(1)
    ).withColumn("__rest", F.greatest(F.col("__asked") - F.col("__epochs") * F.col("__source_tokens"), F.lit(0.0)))
    plan = checkpoint(plan)
    few = plan.count() <= 10_000
    near = F.broadcast(plan) if few else plan

    kept = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__text"),
        F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("__key"), n_tokens(F.col(text)).alias("__n_tokens"),
    )
    spread = F.xxhash64("__id", F.lit(seed))
    placed = rows.join(near.select("__key", "__n_blocks"), "__key").withColumn("__block", F.pmod(spread, F.col("__n_blocks"))).drop("__n_blocks")
    blocks = placed.groupBy("__key", "__block").agg(F.sum("__n_tokens").alias("__block_tokens"))
    turns = blocks.join(near, "__key").withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__epochs").cast("long"))))
    order = Window.partitionBy("__key", "__epoch").orderBy(F.xxhash64("__block", "__epoch", F.lit(seed)), "__block")
    turns = turns.withColumn("__before", F.sum("__block_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__block_tokens"))
    # a block that begins beyond the rest of the last epoch gives no row there
    turns = turns.where((F.col("__epoch") < F.col("__epochs")) | ((F.col("__source_tokens") > 0) & (F.col("__rest") >= 1) & (F.col("__before") < F.col("__rest"))))
    turns = turns.groupBy("__key", "__block").agg(
        F.collect_list(F.struct("__epoch", "__before")).alias("__turns"), F.first("__epochs").alias("__epochs"), F.first("__rest").alias("__rest"),
        F.first("__source_tokens").alias("__source_tokens"), F.first("__asked").alias("__asked"), F.first("weight").alias("__weight"),
    )
    own = Window.partitionBy("__key", "__block").orderBy(F.xxhash64("__id", F.lit(seed + 1)), "__id", "__text")
    inner = placed.withColumn("__upto", F.sum("__n_tokens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    drawn = inner.join(turns, ["__key", "__block"])
    read = F.filter("__turns", lambda t: (t["__epoch"] < F.col("__epochs")) | (t["__before"] + F.col("__upto") <= F.col("__rest")))
    out = drawn.withColumn("__turn", F.explode(read))
    place = (F.col("__turn.__epoch") * F.col("__source_tokens") + F.col("__turn.__before") + F.col("__upto") - F.col("__n_tokens")) / F.greatest(F.col("__asked"), F.lit(1.0))
    return out.select(*[F.col("__row")[c].alias(c) for c in kept], "__n_tokens", "__weight", F.col("__turn.__epoch").alias("__epoch"), "__block", place.alias("__place"))
