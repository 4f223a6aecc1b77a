"""A trie of conversation prefixes, held in flat arrays behind minimal perfect hashes.

Every prefix of every conversation has a digest: the exclusive or of hashes of (place, role,
text), so digests run along a conversation by block sums and no long one is walked by one
task. One grouping by digest yields the nodes. For sums over subtrees the paths to the leaves
are dealt to shards; a shard gives each distinct digest a slot by a minimal perfect hash, checks
the digest kept there, scatters counts into flat arrays and adds them up through an array of
parent slots, deepest first. Partial sums of a node add up over the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint

#: Turns of one piece of a path, and paths' turns in one shard.
PIECE, SHARD = 4096, 200_000
#: Conversation numbers that are joined into one string at once.
RUN = 8192
NODE = ["depth", "g0", "g1"]


# ---- turns in order
def turn_marks(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, own, words): a digest of each turn's role and text, and the words of its text; texts travel no further.

    Rows without a conversation number are left out; a null role or text is empty.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return conversations.where("conv_id is not null").select("conv_id", "turn", own.alias("own"), words.alias("words"))


def numbered(marks: DataFrame) -> DataFrame:
    """(conv_id, i, own, words): turns numbered from 1 by turn, null first; equal turn numbers by the turn's digest.

    Sorted by range and numbered within partitions; what earlier partitions hold of a
    conversation is added from one row per (conversation, partition), so a conversation
    with a large share of all turns spreads over partitions.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "own"]
    dealt = checkpoint(marks.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    past = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    i = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:]))
    return dealt.withColumn("i", i).join(before, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("i")).alias("i"), "own", "words")


def rebuilt_turns(conversations: DataFrame, period: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, d, own, words): each conversation c starts with the first h turns of c - c % period, then has its own from h + 1 on.

    h is the crc32 of the number in decimal, modulo ``most``. Rows without a number are left
    out. A row d = 0 stands for each conversation, which may have no turn.
    """
    turns = checkpoint(numbered(turn_marks(conversations)))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % period
    sizes = turns.where(F.col("i") <= most).groupBy("conv_id").agg(F.max("i").alias("n"))
    convs = sizes.select("conv_id", h.alias("h"), base.alias("base"))
    heads = turns.where((F.col("i") < most) & (base == F.col("conv_id"))).withColumnRenamed("conv_id", "base")
    lead = convs.join(heads, "base").where("i <= h").select("conv_id", F.col("i").alias("d"), "own", "words")
    held = convs.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left")
    shift = held.select("conv_id", "h", (F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")).alias("shift"))
    rest = turns.join(shift, "conv_id").where("i > h").select("conv_id", (F.col("i") + F.col("shift")).alias("d"), "own", "words")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit("").alias("own"), F.lit(0).cast("long").alias("words"))
    return lead.unionByName(rest).unionByName(roots)


# ---- digests
def _digests(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, g0, g1, p0, p1, own, words): digest of the prefix up to the depth, of its parent, of the turn itself, and its words."""
    placed = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("own")).cast("binary"), 256)
    half = lambda at: F.when(F.col("d") == 0, F.lit(0)).otherwise(F.conv(F.substring("placed", at, 15), 16, 10).cast("long"))
    t = turns.withColumn("placed", placed).select("conv_id", F.col("d").alias("depth"), "own", "words", half(1).alias("t0"), half(16).alias("t1"), F.floor(F.col("d") / PIECE).alias("piece"))
    t = checkpoint(t)
    sums = t.groupBy("conv_id", "piece").agg(F.bit_xor("t0").alias("b0"), F.bit_xor("t1").alias("b1"))
    past = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("conv_id", "piece", *[F.bit_xor(b).over(past).alias(b) for b in ("b0", "b1")]).where("piece > 0")
    run = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"x{k}": F.bit_xor(f"t{k}").over(run) for k in (0, 1)}).join(base, ["conv_id", "piece"], "left")
    t = t.withColumns({f"g{k}": F.col(f"x{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (0, 1)})
    return t.select("conv_id", "depth", "g0", "g1", *[F.col(f"g{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (0, 1)], "own", "words")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per digest; a digest whose members differ in turn or parent (two sequences in one) raises an error.

    Equal last turns under equal parents, all the way down, prove the sequences equal.
    """
    same = lambda c: F.min(c) == F.max(c)
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
        F.first("p0").alias("p0"), F.first("p1").alias("p1"), (same("own") & same("p0") & same("p1")).alias("one"),
    )
    clash = F.raise_error(F.lit("two prefixes share a digest")).cast("long")
    return nodes.withColumn("n_convs", F.when(F.col("one"), F.col("n_convs")).otherwise(clash)).drop("one")


# ---- minimal perfect hash of digests, and sums through parent slots
def _spread(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below ``size`` for each digest (two columns of 64 bits), another one on each level."""
    with np.errstate(over="ignore"):
        x = keys[:, 0].astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(size)).astype(np.int64)


class SlotTable:
    """Distinct digests to slots 0 .. n - 1.

    On each level the digests left choose places; those alone at theirs stay, the others go on to
    the next level. A digest's slot is the number of taken places before its own. The digest
    is kept at its slot, and a look-up compares it.
    """

    def __init__(self, keys: np.ndarray):
        whole = left = np.unique(keys, axis=0)
        self.n, before = len(whole), 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # who is alone at each place, and the slots of the places
        while len(left):
            size = 2 * len(left) + 1
            at = _spread(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + before))
            before += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.zeros((self.n, 2), dtype=np.int64)
        self.keys[self._places(whole)] = whole

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (alone, slots) in enumerate(self.levels):
            at = _spread(keys[left], level, len(alone))
            here = alone[at]
            out[left[here]] = slots[at[here]]
            left = left[~here]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where it is not in the table."""
        out = self._places(keys)
        known = out >= 0
        known[known] = (self.keys[out[known]] == keys[known]).all(axis=1)
        return np.where(known, out, -1)


def subtree_sums(depth: np.ndarray, keys: np.ndarray, parents: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first row of each node, sums over its subtree) of path rows; repeated rows of a node add up.

    ``values``: one column per measure, added to the row's node. A parent that is no row is outside.
    """
    table = SlotTable(keys)
    slot = table.slots(keys)
    if (slot < 0).any():
        raise ValueError("a digest got no slot of its own")
    first = np.full(table.n, len(keys), dtype=np.int64)
    np.minimum.at(first, slot, np.arange(len(keys)))
    total = np.zeros((table.n, values.shape[1]), dtype=np.int64)
    if (depth != depth[first][slot]).any():
        raise ValueError("prefixes of two depths share a digest")
    np.add.at(total, slot, values)
    parent, level = table.slots(parents[first]), depth[first]
    parent[level == level.min(initial=0)] = -1
    order = np.argsort(-level, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        inner = group[parent[group] >= 0]
        np.add.at(total, parent[inner], total[inner])
    return first, total


def _summed(paths: DataFrame, parts: int) -> DataFrame:
    """(depth, g0, g1, n_leaves, saved_tokens): sums of (leaf, saved) over the subtrees, by shards of path pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*[[x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches if b.num_rows])]
        if not columns:
            return
        piece, depth, g0, g1, p0, p1, leaf, saved = columns
        for k in np.unique(piece):
            at = np.flatnonzero(piece == k)
            first, total = subtree_sums(depth[at], np.stack([g0[at], g1[at]], 1), np.stack([p0[at], p1[at]], 1), np.stack([leaf[at], saved[at]], 1))
            rows = at[first]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (depth[rows], g0[rows], g1[rows], total[:, 0], total[:, 1])], names=[*NODE, "n_leaves", "saved_tokens"])

    dealt = paths.repartition(parts, "conv_id", "piece").select("piece", "depth", "g0", "g1", "p0", "p1", "leaf", "saved")
    sums = dealt.mapInArrow(run, "depth bigint, g0 bigint, g1 bigint, n_leaves bigint, saved_tokens bigint")
    return sums.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


# ---- members that end at a node
def _ends(rows: DataFrame) -> DataFrame:
    """(depth, g0, g1, ends_sha256) of nodes at which conversations end.

    Numbers are sorted by range, joined to strings of at most RUN numbers within partitions, and
    the strings of a node go in order through one hash. Only strings meet in that last task, as batches pass by.
    """
    import hashlib

    order = [*NODE, "conv_id"]
    dealt = rows.select(*NODE, "conv_id").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*NODE, "part").orderBy("conv_id"))
    runs = dealt.withColumn("run", F.floor((place - 1) / RUN)).groupBy(*NODE, "part", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        done: list[tuple] = []
        kinds = [pa.int64()] * 3 + [pa.string()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[*NODE, "ends_sha256"])
        for batch in batches:
            for *key, text in zip(*[c.to_pylist() for c in batch.columns]):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if len(done) > 50_000:
                yield pack()
                done = []
        if node is not None:
            done.append((*node, state.hexdigest()))
        if done:
            yield pack()

    sorted_ = runs.repartition(*NODE).sortWithinPartitions(*NODE, "part", "run")
    return sorted_.select(*NODE, "text").mapInArrow(digest, "depth bigint, g0 bigint, g1 bigint, ends_sha256 string")


def trie_nodes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each prefix.

    ``turns``: (conv_id, d, own, words) with d = 0 for each conversation and then 1, 2, ... without gaps
    (see rebuilt_turns). A node is a distinct sequence of first turns, ``conv_id`` its smallest member.
    ``saved_tokens``: words of last turns that need not be stored twice, over the subtree. Repeated rows of a
    turn count as turns of their own before this step. No conversations give no nodes, not even the root.
    """
    rows = checkpoint(_digests(turns))
    nodes = checkpoint(_nodes(rows))
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("e")).select("conv_id", "e.*")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("g0"), F.col("p1").alias("g1")).agg(F.count("*").alias("n_children"))
    leaves = nodes.join(children, NODE, "left_anti").select("conv_id", F.col("depth").alias("end"))
    paths = checkpoint(rows.join(leaves, "conv_id").select("conv_id", *NODE, "p0", "p1", (F.col("depth") == F.col("end")).cast("long").alias("leaf")))
    # what a node saves is counted once, on the first of the leaf paths through it
    first = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"))
    saving = first.join(nodes.select(*NODE, ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), NODE).select("conv_id", "depth", "saved")
    paths = paths.join(saving, ["conv_id", "depth"], "left").withColumns({"saved": F.coalesce("saved", F.lit(0)), "piece": F.floor(F.col("depth") / PIECE)})
    paths = checkpoint(paths)
    # what the later pieces of a long path hold is added at the last turn of the piece before
    rest = Window.partitionBy("conv_id").orderBy(F.col("piece").desc())
    later = paths.where("piece > 0").groupBy("conv_id", "piece").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    later = later.select("conv_id", (F.col("piece") * PIECE - 1).alias("depth"), F.sum("s").over(rest).alias("s"), F.sum("l").over(rest).alias("l"))
    paths = paths.join(later, ["conv_id", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("l", F.lit(0))})
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), paths.count() // SHARD + 1)
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("g0").alias("p0"), F.col("g1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return (
        nodes.join(children, NODE, "left").join(_summed(paths, parts), NODE).join(_ends(last), NODE, "left").join(parent, ["depth", "p0", "p1"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", n("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    )
