"""Near-duplicate documents: a Jaccard join filtered by prefixes under several token orders."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint
from tapeworks.llm.hashing import mix, ranges, shingle_sets
from tapeworks.operators.components import connected_components

ORDERS = 3
DRAWS = (1, 16, 32)  # in each leader round, the groups of tokens that draw their leaders apart
TILE = 1024  # classes of a component that meet as many others in one task
HEAD = 16  # tokens at the start of a prefix that tell whether a pair has already met
PIECE = 1 << 18  # bytes of text that are shingled at once
GROUP = 32  # pieces in which shingles are counted together
FEW = 200_000  # classes whose numbers may be broadcast
WORDS = 4  # 64-bit words of a parity bitmap
FILTER_BITS = 1 << 24


def _pieces(column: pa.Array):
    """(first, last, texts) of about ``PIECE`` bytes each, so that never all texts of a batch are copied."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for i, j in ranges(size, PIECE):
        yield i, j, [t or b"" for t in column.slice(i, j - i).cast(pa.large_binary()).to_pylist()]


def _frequent(batches):
    """Shingles that several different texts of a group of pieces share, counted."""
    for batch in batches:
        pieces = (shingle_sets(texts)[1] for _, _, texts in _pieces(pc.unique(batch.column("text"))))
        while found := list(islice(pieces, GROUP)):
            token = np.concatenate(found)
            del found
            token.sort()
            token, n = np.unique(token[1:][token[1:] == token[:-1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64) + 1)], ["token", "n"])


def frequent_shingles(docs: DataFrame, most: int = 1_000_000) -> np.ndarray:
    """At most ``most`` shingles that many documents share, the most frequent last.

    Counted are shingles that come twice in a group of pieces (8 MB of text). They only shape the token orders (frequent
    shingles last), never what is found; the bound keeps what is broadcast small at any size: of
    the counts from 2 up, the least is taken from which on no more than ``most`` are there.
    """
    counts = checkpoint(docs.select("text").mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    sizes = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.col("n").desc()).collect()
    least, total = 1 << 62, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["n"]
    rows = counts.where(F.col("n") >= least).toArrow()
    token, n = rows.column("token").to_numpy(), rows.column("n").to_numpy()
    return token[np.lexsort((token, n))].view(np.uint64).copy()


def _prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens of which one is shared with any set that has 80 % in common."""
    return n - (4 * n + 4) // 5 + 1


def _parities(first: np.ndarray, has: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each set, the parity of its tokens that fall on each of 256 bits.

    Two bitmaps differ in no more bits than the sets differ in tokens.
    """
    out = np.zeros((len(has), WORDS), np.uint64)
    if len(h):
        bit = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
        word, one = (bit >> np.uint64(6)) & np.uint64(WORDS - 1), np.uint64(1) << (bit & np.uint64(63))
        for k in range(WORDS):
            out[has, k] = np.bitwise_xor.reduceat(np.where(word == k, one, np.uint64(0)), first[has])
    return out


def _fine_parities(own: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over a power of two of at least twice as many bits as the set has tokens (256 at least): words and their number per set.

    A bit is a token's hash in its lowest places, so the two halves of a bitmap, put together
    by xor, are the bitmap of half the size.
    """
    size = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(n, 1) / 32)).astype(np.int64).clip(0))
    first = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    bit = mix(h ^ np.uint64(0x6A09E667F3BCC909)) & (size[own].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    np.bitwise_xor.at(words, first[own] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return words, size


def _fine_near(x: str, y: str) -> str:
    """SQL test as ``_near`` over bitmaps that fit the sets' sizes; the longer one is folded."""
    fold = lambda a, b: f"if(size({a}.fine) > size({b}.fine), zip_with(slice({a}.fine, 1, size({b}.fine)), slice({a}.fine, size({b}.fine) + 1, size({b}.fine)), (p, q) -> p ^ q), {a}.fine)"
    apart = f"aggregate(zip_with({fold(x, y)}, {fold(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return f"9 * {apart} <= {x}.n_shingles + {y}.n_shingles"


def _near(bits: str, other: str, n: str, m: str) -> str:
    """SQL test that no linked pair fails: at 80 % in common, sets differ in at most a ninth of their sizes."""
    return "9 * (" + " + ".join(f"bit_count({bits}[{k}] ^ {other}[{k}])" for k in range(WORDS)) + f") <= {n} + {m}"


def _lists(values: np.ndarray, owner: np.ndarray, n_docs: int, kind) -> pa.Array:
    offsets = np.zeros(n_docs + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n_docs), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))


class _Orders:
    """The token orders: frequent tokens last, the others by a hash that differs for each order."""

    def __init__(self, heavy: np.ndarray):
        self.by = np.argsort(heavy)
        self.heavy = heavy[self.by]

    def rank(self, h: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(h), np.uint64)
        if len(self.heavy) and len(h):
            at = np.minimum(np.searchsorted(self.heavy, h), len(self.heavy) - 1)
            hit = self.heavy[at] == h
            rank[hit] = self.by[at[hit]].astype(np.uint64) + np.uint64(1)
        return rank

    def prefixes(self, own: np.ndarray, h: np.ndarray, n: np.ndarray, orders) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the owner and token of each prefix place, in order."""
        rank = self.rank(h) << np.uint64(46)
        place = np.arange(len(h)) - (np.cumsum(n) - n)[own]
        keep = place < _prefix_length(n)[own]
        out = []
        for k in orders:
            order = np.lexsort((rank | (mix(h + np.uint64(0x9E3779B9 * (k + 7))) >> np.uint64(18)), own))
            out.append((own[keep], h[order][keep]))
        return out


def _sums(first: np.ndarray, has: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set that, with its size, tell sets apart."""
    out = [np.zeros(len(has), np.uint64) for _ in range(2)]
    for k in range(2 if len(h) else 0):
        out[k][has] = np.add.reduceat(mix(h + np.uint64(0x1234567 * (k + 1))), first[has])
    return out


def _signatures(shared):
    def rows(batches):
        orders = _Orders(shared.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, texts in _pieces(batch.column("text")):
                m = j - i
                own, h = shingle_sets(texts)
                n = np.bincount(own, minlength=m)
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                has = n > 0
                sums = _sums(first, has, h)
                fine, size = _fine_parities(own, h, n)
                ((who, token),) = orders.prefixes(own, h, n, [0])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, m), pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums),
                     _lists(token.view(np.int64), who, m, np.int64),
                     _lists(_parities(first, has, h).ravel().view(np.int64), np.repeat(np.arange(m), WORDS), m, np.int64),
                     _lists(fine.view(np.int64), np.repeat(np.arange(m), size), m, np.int64)],
                    ["doc_id", "n_shingles", "s1", "s2", "prefix", "bits", "fine"],
                )

    return rows


def _members(batches, words: np.ndarray):
    """Ids and shingle sets of the documents that the bit map lets pass."""
    for batch in batches:
        bit = batch.column("bit").to_numpy()
        batch = batch.filter(pa.array((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1))
        ids = batch.column("doc_id")
        for i, j, texts in _pieces(batch.column("text")):
            yield ids.slice(i, j - i), j - i, *shingle_sets(texts)


def _sides(shared, heavy):
    """The sets and their prefixes under the second and third order, as 32-bit parts of the tokens."""

    def rows(batches):
        orders = _Orders(heavy.value)
        for ids, m, own, h in _members(batches, shared.value):
            n = np.bincount(own, minlength=m)
            s1, s2 = (pa.array(x.view(np.int64)) for x in _sums(np.concatenate([[0], np.cumsum(n)[:-1]]), n > 0, h))
            cols = [_lists((t >> np.uint64(32)).astype(np.uint32).view(np.int32), w, m, np.int32) for w, t in orders.prefixes(own, h, n, range(1, ORDERS))]
            yield pa.RecordBatch.from_arrays([ids, s1, s2, _lists(h.view(np.int64), own, m, np.int64), *cols], ["doc_id", "s1", "s2", "tokens", "p2", "p3"])

    return rows


def _bit_map(needed: DataFrame):
    """Broadcast bit map of fixed size, filled from the document numbers in ``needed``.

    It tells a scan which documents are needed; where it has filled up it lets more pass,
    never less.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    found = (
        needed.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.pmod("bit", F.lit(64)).cast("int").alias("at"))
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).toArrow()
    )
    words = np.zeros(FILTER_BITS >> 6, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return needed.sparkSession.sparkContext.broadcast(words)


def sides(docs: DataFrame, needed: DataFrame, heavy, repeated: bool = True) -> DataFrame:
    """(doc_id, tokens, p2, p3) of the documents whose numbers are in ``needed`` (and few others).

    ``repeated``: a number may come in several rows; the greatest set stands for it.
    """
    scan = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
    schema = "doc_id long, s1 long, s2 long, tokens array<long>, p2 array<int>, p3 array<int>"
    found = scan.mapInArrow(_sides(_bit_map(needed), heavy), schema)
    if repeated:
        best = F.max(F.struct(F.size("tokens").alias("n"), "s1", "s2", "tokens", "p2", "p3")).alias("s")
        found = found.groupBy("doc_id").agg(best).select("doc_id", "s.*")
    return found.select("doc_id", "tokens", "p2", "p3")


def meeting(of: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share a token under the second and under the third order, with both sets (ta, tb)."""
    side = lambda k: of.select(F.col("doc_id").alias(k), F.col("tokens").alias(f"t{k}"), F.col("p2").alias(f"{k}2"), F.col("p3").alias(f"{k}3"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return both.where("arrays_overlap(a2, b2)").where("arrays_overlap(a3, b3)").select("a", "b", "ta", "tb")


def verified(met: DataFrame) -> DataFrame:
    """Of the pairs with their sets, those (a, b) whose sets have 80 % or more in common."""
    held = met.withColumn("common", F.size(F.array_intersect("ta", "tb"))).where("100 * common >= 80 * (size(ta) + size(tb) - common)")
    return held.select("a", "b").distinct()


def _links(docs: DataFrame, own: DataFrame, first: DataFrame, heavy, repeated: bool) -> DataFrame:
    """Of the pairs that meet under the first order, those that meet under all others and then hold.

    Bitmaps that fit the sets' sizes first tell most pairs that cannot link, so that few whole sets travel.
    """
    fine = own.select("doc_id", "n_shingles", "fine")
    apart = first.join(fine.alias("x"), F.expr("a = x.doc_id")).join(fine.alias("y"), F.expr("b = y.doc_id"))
    first = checkpoint(apart.where(_fine_near("x", "y")).select("a", "b"))
    of = sides(docs, first.select(F.explode(F.array("a", "b")).alias("doc_id")), heavy, repeated)
    return checkpoint(verified(meeting(of, first)))


def _within_components(placed: DataFrame, joined: DataFrame | None) -> DataFrame:
    """``placed`` with the component of each class so far (its own number at first)."""
    if joined is None:
        return placed.withColumn("comp", F.col("doc_id"))
    return placed.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


_FIT = "5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) and 9 * least(x.n - x.at, y.n - y.at) >= 4 * (x.n + y.n)"


def _with_leaders(shared: DataFrame, joined: DataFrame | None, turn: int) -> DataFrame:
    """Pairs of a class and the leader of a posting list of the first order.

    Each list draws its leader by hash, another one in each turn and each group of
    tokens (see ``DRAWS``). Only lists whose classes lie in
    several components so far, only pairs of different components whose sizes, places in the
    list's prefixes and bitmaps allow a link.
    """
    rows = _within_components(shared, joined)
    drawn = F.struct(F.xxhash64("doc_id", F.pmod("token", F.lit(DRAWS[turn])), F.lit(turn)).alias("draw"), "doc_id", "comp", "n", "at", "bits")
    lead = rows.groupBy("token").agg(F.min(drawn).alias("y"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "y")
    pairs = rows.alias("x").join(lead, "token").where(f"x.comp <> y.comp and {_FIT} and " + _near("x.bits", "y.bits", "x.n", "y.n"))
    return pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _across_components(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """All pairs of classes of different components that share a prefix token of the first order and may link."""
    rows = _within_components(shared, joined)
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    rows = rows.join(mixed, "token", "left_semi")
    heads = rows.where(F.col("at") < HEAD).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "token"))).alias("head"))
    rows = checkpoint(rows.join(heads, "doc_id", "left"))
    # the smaller set of a linked pair shares 8/9 of its tokens, so its prefix can be shorter
    x, y = rows.where("at < n - (8 * n + 8) div 9 + 1").alias("x"), rows.alias("y")
    # of the tokens that a pair shares, the first makes the pair; those after one of both heads are passed over
    before = lambda k: f"map_values(map_filter({k}.head, (at, t) -> at < {k}.at))"
    test = f"x.token = y.token and x.comp <> y.comp and (x.n < y.n or (x.n = y.n and x.doc_id < y.doc_id)) and {_FIT} and " + _near("x.bits", "y.bits", "x.n", "y.n")
    test += f" and not coalesce(arrays_overlap({before('x')}, {before('y')}), false)"
    return x.join(y, F.expr(test)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def _overlaps(own: np.ndarray, h: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, step: int = 2048) -> np.ndarray:
    """Tokens that each set of ``left`` shares with each of ``right``, as products of incidence blocks."""
    out = np.zeros((len(left), len(right)), np.float32)
    column = np.unique(h, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + step, step))
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        block = np.zeros((n, step), np.float32)
        block[own[i:j], column[i:j] - k * step] = 1
        out += block[left] @ block[right].T
    return out


def _tile_links(heavy):
    """Number of links of each class to the classes of the other side of its tile (all of the tile on the diagonal)."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        orders = _Orders(heavy.value)
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        n = np.array([len(t) for t in pdf["tokens"]])
        own, h = np.repeat(np.arange(len(n)), n), np.concatenate(list(pdf["tokens"])).view(np.uint64)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = np.flatnonzero(pdf["block"] == i), np.flatnonzero(pdf["block"] == j)
        sizes = n[left][:, None], n[right][None, :]
        may = 5 * np.minimum(*sizes) >= 4 * np.maximum(*sizes)
        if i == j:
            may &= left[:, None] < right[None, :]
        for who, token in orders.prefixes(own, h, n, range(ORDERS)):
            may &= _overlaps(who, token, left, right, len(n)) > 0
        links = np.zeros(len(n), np.int64)
        rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if len(rows):
            common = _overlaps(own, h, left[rows], right[cols], len(n))
            hold = may[np.ix_(rows, cols)] & (100 * common >= 80 * (n[left[rows]][:, None] + n[right[cols]][None, :] - common))
            np.add.at(links, left[rows], hold.sum(1))
            np.add.at(links, right[cols], hold.sum(0))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n": links})

    return count


def count_links(docs: DataFrame, linked: DataFrame, heavy, repeated: bool = True) -> DataFrame:
    """(node, n_links): for each class of ``linked`` (node, component), the classes that it links with.

    A component of two has one link. Larger ones are dealt out in tiles of two blocks of about
    ``TILE`` classes; a task compares the two blocks of its tile, by prefixes under all orders and
    then by whole sets, and returns sums only.
    """
    sizes = linked.groupBy("component").agg(F.count("*").alias("k"))
    placed = checkpoint(linked.join(sizes, "component"))
    many = placed.where("k > 2").select("component", F.col("node").alias("doc_id"), F.ceil(F.col("k") / TILE).cast("int").alias("blocks"))
    of = sides(docs, many.select("doc_id"), heavy, repeated).select("doc_id", "tokens")
    block = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks")).cast("int")
    near = F.broadcast(many) if many.count() <= FEW else many
    tiles = (
        of.join(near, "doc_id").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", "doc_id", "tokens", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    counted = checkpoint(tiles.groupBy("component", "i", "j").applyInPandas(_tile_links(heavy), "doc_id long, n long"))
    return placed.where("k = 2").select("node", F.lit(1).cast("long").alias("n_links")).unionByName(
        counted.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n").alias("n_links"))
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links) for each document number.

    A document's set holds its distinct five-word shingles (words lower-cased A-Z, cut at
    white space); with fewer words the whole sequence; without words nothing. Two documents
    link when 100 x intersection >= 80 x union. ``class_id`` is the smallest number with the same
    set, ``component_id`` the smallest number reachable over links, ``n_links`` the number of other
    classes that the class links with. Null and empty texts are linked with nothing. Rows with a
    null number are left out; repeated rows of a number count once, and where a number bears
    several texts one of them (the greatest) stands for it.

    1. Documents of equal set become one class. 2. The tokens of each class are put in three global
    orders (frequent ones last); a linked pair shares a token among the first 20 % under each of
    them. Pairs that share one under the first order, early enough for the rest to hold the needed
    tokens, are candidates; their prefixes under the second and third order must meet as well;
    only what passes all three is verified on the whole sets. 3. So that a large group of near
    copies costs few pairs, each posting list of the first order is first asked only for the
    pairs of one drawn leader, twice; then all pairs of classes that are still in different
    components follow, so no component is missed. 4. Within the components all links are counted
    in tiles, through the same three orders (not without ``counts``; ``n_links`` is then absent).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    sc = docs.sparkSession.sparkContext
    heavy = sc.broadcast(frequent_shingles(rows))
    schema = "doc_id long, n_shingles long, s1 long, s2 long, prefix array<long>, bits array<long>, fine array<long>"
    marked = checkpoint(rows.mapInArrow(_signatures(heavy), schema))
    once = marked.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "s1", "s2")).alias("s")).select("doc_id", "s.*")
    filled = once.where("n_shingles > 0")
    classes = checkpoint(filled.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("class_id")))
    members = checkpoint(once.join(classes, ["n_shingles", "s1", "s2"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), "s1", "s2"))
    repeated = marked.count() > members.count()
    leaders = members.where("doc_id = class_id and n_shingles > 0").select(F.col("doc_id").alias("leader"), F.col("s1").alias("l1"), F.col("s2").alias("l2"))
    # one row for each class, with its prefix
    own = marked.join(leaders, F.expr("doc_id = leader and s1 = l1 and s2 = l2"), "left_semi").dropDuplicates(["doc_id"])

    posting = own.select(F.posexplode("prefix").alias("at", "token"), "doc_id", "n_shingles").select(
        "token", "doc_id", F.expr("shiftleft(n_shingles, 30) + at").alias("size")
    )
    often = posting.withColumn("m", F.count("*").over(Window.partitionBy("token"))).where("m > 1")
    placed = often.select("token", "doc_id", F.expr("shiftright(size, 30)").alias("n"), F.expr("size & 1073741823").alias("at"))
    shared = checkpoint(placed.join(own.select("doc_id", "bits"), "doc_id"))

    joined = None
    for turn in range(len(DRAWS) + 1):
        first = _with_leaders(shared, joined, turn) if turn < len(DRAWS) else _across_components(shared, joined)
        more = _links(rows, own, first, heavy, repeated)
        # components found so far stand for the links that made them
        joined = checkpoint(connected_components(more if joined is None else more.union(joined.where("node <> component"))))
    linked = joined.select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    out = members.join(linked, "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    if not counts:
        return out
    degree = count_links(rows, joined, heavy, repeated).withColumnRenamed("node", "class_id")
    return out.join(degree, "class_id", "left").select(*out.columns, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are not the smallest number of their component.

    All columns stay. Rows that repeat both number and text of a kept document become one row (the
    one of smallest content). Of a number that bears different texts the greatest set is compared,
    so its copies under other numbers go, while its own rows all stay; so do rows with a null number.
    """
    key = F.col(doc_id).cast("long")
    own = "__id"
    while own in {c.lower() for c in docs.columns}:  # a name that no column of the table bears
        own += "_"
    per = docs.where(key.isNotNull()).select(key.alias(own), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h"))
    often = checkpoint(per.groupBy(own).agg(F.count("*").alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi")).where("n > 1"))
    unclear = often.where("lo <> hi").select(own)
    gone = near_duplicates(docs, doc_id, text, counts=False).where("doc_id <> component_id").select(F.col("doc_id").alias(own))
    rows = docs.join(gone.join(unclear, own, "left_anti"), key == F.col(own), "left_anti")
    if often.isEmpty():
        return rows
    again = often.where("lo = hi").select(own)
    once = rows.join(again, key == F.col(own), "left_anti")
    first = rows.join(again, key == F.col(own), "left_semi").select(F.struct(*docs.columns).alias("__row"))
    return once.unionByName(first.groupBy(F.col(f"__row.{doc_id}")).agg(F.min("__row").alias("__row")).select("__row.*"))
