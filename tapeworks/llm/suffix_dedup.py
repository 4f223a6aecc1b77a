"""Removing byte strings that already occur earlier in the corpus, by hash-compared suffix sorting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint
from tapeworks.llm.hashing import PrefixHash, chunks, mix

SEED = 32  # bytes of an anchor
PART = 17  # windows of a grid place around an anchor
START = "cast(shiftright(place, 7) as int) as start"


def _encode(texts) -> list[bytes]:
    return [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]


class Buffer:
    """Texts one after another, with prefix hashes for any slice of them."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.first[1:])
        self.hash = PrefixHash(self.buf)

    def window_starts(self, width: int) -> np.ndarray:
        """Starts of all windows that lie inside one text."""
        n = np.maximum(np.diff(self.first) - width + 1, 0)
        skip = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.arange(n.sum()) + skip

    def slices(self, start, end) -> np.ndarray:
        """Two independent finalised hashes of slices; the length counts."""
        return mix(self.hash.slices(start, end) + (end - start).astype(np.uint64))

    def same(self, a: np.ndarray, b: np.ndarray, length: int, step: int = 200_000) -> np.ndarray:
        """Byte by byte: whether the strings at a and b are equal (this is what settles hash matches)."""
        out = np.zeros(len(a), bool)
        reach = np.arange(length)
        for i in range(0, len(a), step):
            out[i : i + step] = (self.buf[a[i : i + step, None] + reach] == self.buf[b[i : i + step, None] + reach]).all(1)
        return out

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of suffixes a and b, up to ``limit``, by binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            hit = self.hash.slices(a, a + mid) == self.hash.slices(b, b + mid)
            low, high = np.where(hit, mid, low), np.where(hit, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Whether suffix a (cut at ``limit`` bytes) sorts before suffix b."""
        n = self.common(a, b, limit)
        at = np.minimum(n, limit - 1)
        return (n < limit) & (self.buf[a + at] < self.buf[b + at])

    def sort(self, suffixes: np.ndarray, limit: int) -> np.ndarray:
        """The suffixes in order of their first ``limit`` bytes; ties keep their order.

        Bottom-up mergesort: in each pass, all runs are merged at once. The place of a suffix in
        the merged run is its own place plus its rank in the sister run, found by binary search
        whose comparisons are hash-compared.
        """
        cur, run = suffixes, 1
        n = len(cur)
        at = np.arange(n)
        while run < n:
            pair = at // (2 * run) * (2 * run)
            left = at - pair < run
            lo = np.where(left, np.minimum(pair + run, n), pair)
            base = lo.copy()
            hi = np.where(left, np.minimum(pair + 2 * run, n), pair + run)
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                mine, other, is_left = cur[live], cur[mid], left[live]
                # equal suffixes: those of the left run come first
                below = np.empty(len(live), bool)
                below[is_left] = self.before(other[is_left], mine[is_left], limit)
                below[~is_left] = ~self.before(mine[~is_left], other[~is_left], limit)
                lo[live] = np.where(below, mid + 1, lo[live])
                hi[live] = np.where(below, hi[live], mid)
                live = live[lo[live] < hi[live]]
            to = np.where(left, at, at - run) + lo - base
            out = np.empty_like(cur)
            out[to] = cur
            cur, run = out, 2 * run
        return cur


def _anchors(b: Buffer, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts and, for each, the place of its anchor: its ``SEED``-byte string of least hash, leftmost on ties.

    Equal windows have equal anchors at equal distance, so only strings around equal anchors
    need to be compared.
    """
    if len(b.buf) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(b.buf) - SEED + 1
    rank = mix(b.hash.slices(np.arange(n), np.arange(n) + SEED))
    best, reach, span = np.arange(n), 1, width - SEED + 1
    while reach < span:
        step = min(reach, span - reach)
        a, c = best[: len(best) - step], best[step:]
        best = np.where(rank[c] < rank[a], c, a)
        reach += step
    starts = b.window_starts(width)
    return starts, best[starts]


def _cells(width: int):
    """Runs of windows with a common anchor: (anchor hash, hash of the run's bytes with its number of windows, document, place).

    ``place`` is the run's start times 128 plus the distance from there to the anchor.

    Within a task, only the first of equal runs is looked up further; later ones are known to be
    repeats at once (``known``) where the first belongs to a smaller document or lies earlier.
    """

    def rows(batches):
        for pdf in batches:
            pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id")
            ids, texts = pdf["doc_id"].to_numpy(), _encode(pdf["text"])
            for i, j in chunks(texts):
                b = Buffer(texts[i:j])
                starts, anchor = _anchors(b, width)
                if not len(starts):
                    continue
                doc = np.searchsorted(b.first, starts, side="right") - 1
                new = np.ones(len(starts), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                count = np.diff(np.concatenate([head, [len(starts)]]))
                s, d = starts[head], doc[head]
                k = b.slices(anchor[head], anchor[head] + SEED)
                u = b.slices(s, s + count + width - 1)
                known = np.ones(len(s), bool)
                known[_first_of(k, u)] = False
                # 56 bits of the run's hash with the number of its windows, negative if known
                run = ((u >> np.uint64(8)).view(np.int64) << 7 | count) * np.where(known, -1, 1)
                yield pd.DataFrame({"k": k.view(np.int64), "run": run, "doc_id": ids[i:j][d], "place": (s - b.first[d]) << 7 | (anchor[head] - s)})

    return rows


def _first_of(*keys: np.ndarray):
    """Indexes of the first row of each distinct key."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    first = np.full(group[-1] + 1 if len(order) else 0, len(order))
    np.minimum.at(first, group, order)
    return first


def _repeated(h: np.ndarray) -> np.ndarray:
    """Where a value comes more than once."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _parts(width: int):
    """The open runs cut at a grid of ``PART`` bytes around their anchors, each part with its bytes.

    All windows of one grid place hold the bytes from its last window's start to its first
    window's end. Equal windows lie at one grid place of equal anchors, so parts that share
    these bytes with no other are done.
    """

    def rows(batches):
        for pdf in batches:
            pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id")
            ids, texts = pdf["doc_id"].to_numpy(), _encode(pdf["text"])
            runs = [(np.asarray(p, np.int64), np.asarray(n, np.int64)) for p, n in zip(pdf["places"], pdf["counts"])]
            for i, j in chunks(texts):
                b = Buffer(texts[i:j])
                d = np.repeat(np.arange(j - i), [len(p) for p, _ in runs[i:j]])
                place, n = (np.concatenate([r[k] for r in runs[i:j]]) for k in (0, 1))
                # distances of the run's first and last window to the anchor, and their grid places
                far = place & 127
                near = far - n + 1
                times = far // PART - near // PART + 1
                own = np.repeat(np.arange(len(n)), times)
                grid = (far // PART)[own] - (np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times))
                first, last = np.minimum(far[own], grid * PART + PART - 1), np.maximum(near[own], grid * PART)
                d, anchor = d[own], ((place >> 7) + far)[own] + b.first[d[own]]
                s, z = anchor - first, anchor - last + width
                k = mix(b.slices(anchor - grid * PART, anchor - grid * PART - PART + 1 + width) ^ mix(grid.astype(np.uint64) + np.uint64(1)))
                run = (b.slices(s, z) >> np.uint64(8)).view(np.int64) << 7 | (first - last + 1)
                raw = b.buf.tobytes()
                yield pd.DataFrame({"k": k.view(np.int64), "run": run, "doc_id": ids[i:j][d], "place": (s - b.first[d]) << 7, "piece": [raw[x:y] for x, y in zip(s, z)]})

    return rows


def _windows(width: int):
    """Single windows of the open parts; those that repeat an earlier one of the same batch are settled here.

    The suffixes at the windows are sorted with hash-compared merging; neighbours in the sorted
    order that agree in ``width`` bytes (and are then compared byte by byte) are equal windows.
    """

    def rows(batches):
        for pdf in batches:
            pdf = pdf.sort_values(["doc_id", "start"])
            ids, begins, texts = pdf["doc_id"].to_numpy(), pdf["start"].to_numpy(), pdf["piece"].tolist()
            for i, j in chunks(texts):
                b = Buffer(texts[i:j])
                at = b.window_starts(width)
                h = b.slices(at, at + width)
                # only windows whose hash comes twice can be equal; these are sorted
                known = np.zeros(len(at), bool)
                often = at[_repeated(h)]
                if len(often):
                    ranked = b.sort(often, width)
                    equal = np.flatnonzero(b.common(ranked[:-1], ranked[1:], width) >= width)
                    equal = equal[b.same(ranked[equal], ranked[equal + 1], width)]
                    # the sort is stable, so the first of equal suffixes is the earliest
                    known[np.searchsorted(at, ranked[equal + 1])] = True
                doc = np.searchsorted(b.first, at, side="right") - 1
                second = mix(h ^ b.slices(at, at + width // 2))
                start = at - b.first[doc] + begins[i:j][doc]
                more = ((second >> np.uint64(33)) << np.uint64(32)).view(np.int64) | start
                # settled windows travel as runs, each under a key of its own
                new = known.copy()
                new[1:] &= ~(known[:-1] & (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1]))
                head = np.flatnonzero(new)
                n = np.bincount(np.cumsum(new)[known] - 1, minlength=len(head))
                more[head] = -1 - (start[head] << 31 | n)
                h[head] = mix(h[head] ^ mix(at[head].astype(np.uint64) + np.uint64(i)))
                send = ~known | new
                yield pd.DataFrame({"w": h[send].view(np.int64), "more": more[send], "doc_id": ids[i:j][doc[send]]})

    return rows


def _sifted(cells: DataFrame) -> DataFrame:
    """(doc_id, place, n, open, ...): runs that share their key; ``open`` is false where an equal run is earlier.

    Left out are runs alone with their key and the first of runs that are all equal: nothing
    earlier can repeat them.
    """
    of_key = Window.partitionBy("k")
    of_run = Window.partitionBy("k", "u").orderBy("doc_id", "place")
    rows = (
        cells.withColumn("u", F.abs("run")).withColumn("m", F.count("*").over(of_key)).where("m > 1")
        .withColumn("at", F.rank().over(of_run)).withColumn("lo", F.min("u").over(of_key)).withColumn("hi", F.max("u").over(of_key))
        .where("at > 1 or lo < hi")
    )
    more = [F.expr("if(at = 1, piece, null) as piece")] if "piece" in cells.columns else []
    return checkpoint(rows.select("doc_id", "place", F.expr("cast(u & 127 as int) as n"), F.expr("at = 1 as open"), *more))


def repeated_windows(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, start, n): runs of n windows (strings of ``width`` bytes) that occur earlier too.

    Expects (doc_id, text) with one text for each number. 1. Windows are
    grouped in runs with a common anchor; only runs whose anchor occurs twice go on. 2. A run
    whose whole string equals that of an earlier run repeats it. 3. The runs that are left (the
    seams of repeated passages) are cut at a grid and sifted in the same way. 4. The windows of
    what is left then are suffix-sorted within tasks and their survivors matched over the corpus.
    """
    cells = docs.select("doc_id", "text").mapInPandas(_cells(width), "k long, run long, doc_id long, place long")
    again = _sifted(cells)
    runs = again.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("r")).select(
        "doc_id", F.col("r.place").alias("places"), F.col("r.n").alias("counts")
    )
    parts = docs.select("doc_id", "text").join(runs, "doc_id").mapInPandas(_parts(width), "k long, run long, doc_id long, place long, piece binary")
    again2 = _sifted(parts)
    windows = again2.where("open").select("doc_id", F.expr(START), "piece").mapInPandas(_windows(width), "w long, more long, doc_id long")
    first = Window.partitionBy("w", F.expr("more >> 32")).orderBy("doc_id", "more")
    late = windows.withColumn("at", F.rank().over(first)).where("more < 0 or at > 1")
    start = F.expr("cast(if(more < 0, shiftright(-1 - more, 31), more & 4294967295) as int)").alias("start")
    n = F.expr("cast(if(more < 0, (-1 - more) & 2147483647, 1) as int)").alias("n")
    settled = again.where("not open").select("doc_id", "place", "n").unionByName(again2.where("not open").select("doc_id", "place", "n"))
    return settled.select("doc_id", F.expr(START), "n").unionByName(late.select("doc_id", start, n))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) for each row, over UTF-8 bytes.

    A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document
    of smaller number, or earlier in its own. ``spans`` lists the removed runs as (start, end).
    Strings are judged on the input. A null text is empty. Matches never cross documents.
    Repeated rows of one number are one document and each gets its result. A number that bears
    different texts has no defined place: its rows, and rows with a null number, are left
    whole and match nothing.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    mark = rows.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    unclear = checkpoint(mark.where("doc_id is not null and lo <> hi").select("doc_id"))
    clear = rows.where("doc_id is not null")
    if not unclear.isEmpty():
        clear = clear.join(unclear, "doc_id", "left_anti")
    runs = repeated_windows(clear, width)
    gone = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("r")).select(
        "doc_id", F.col("r.start").alias("starts"), F.col("r.n").alias("counts")
    )
    marked = rows.join(gone, "doc_id", "left")

    def cut(batches):
        for pdf in batches:
            out = []
            for doc, raw, starts, counts in zip(pdf["doc_id"], _encode(pdf["text"]), pdf["starts"], pdf["counts"]):
                size, spans = len(raw), []
                if starts is not None:
                    edge = np.zeros(size + 1, np.int64)
                    s, n = np.asarray(starts, np.int64), np.asarray(counts, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + width - 1, -1)
                    on = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]]).astype(np.int8)
                    turn = np.diff(on)
                    spans = list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()))
                kept, at = [], 0
                for a, z in spans:
                    kept.append(raw[at:a])
                    at = z
                kept.append(raw[at:])
                out.append((doc, size, sum(z - a for a, z in spans), len(spans), b"".join(kept), [{"start": a, "end": z} for a, z in spans]))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return marked.select("doc_id", "text", "starts", "counts").mapInPandas(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>"
    )
