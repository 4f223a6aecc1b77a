"""Removing lines that many documents share."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
FOLD = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    """The line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANK).translate(FOLD)


def _hash(key: str) -> tuple[int, int]:
    d = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _keys(min_length: int):
    def rows(batches):
        for pdf in batches:
            out = []
            for doc, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"]):
                own: dict[str, list[int]] = {}
                for at, line in enumerate((text or "").split("\n")):
                    if len(line) >= min_length and len(key := line_key(line)) >= min_length:
                        own.setdefault(key, []).append(at)
                out += [(*_hash(k), doc, row, np.array(v, ">u4").tobytes()) for k, v in own.items()]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["h1", "h2", "doc_id", "row", "at"])
                    out = []
            yield pd.DataFrame(out, columns=["h1", "h2", "doc_id", "row", "at"])

    return rows


def _stream(min_docs: int):
    """Over rows sorted by key and falling document: which rows of a key's run lose their lines.

    The first document of a run keeps its lines. A run that begins or ends the partition may go
    on in the next one; its rows leave with ``open`` and the caller settles them.
    """

    def settle(run: pd.DataFrame, open_: bool) -> pd.DataFrame:
        top = run["doc_id"].iloc[0]
        many = open_ or run["doc_id"].nunique() >= min_docs
        return run.assign(open=open_, drop=(run["doc_id"] != top) & many)

    def rows(batches):
        held, first, edge = [], True, False
        for pdf in batches:
            if not len(pdf):
                continue
            if held and edge and (pdf["h1"].iloc[0] == held[0]["h1"].iloc[0]) and (pdf["h2"].iloc[0] == held[0]["h2"].iloc[0]):
                yield settle(held.pop(), True)  # the partition's first run is settled later anyway: no need to hold it
            part = pd.concat([*held, pdf], ignore_index=True)
            new = (part["h1"] != part["h1"].shift()) | (part["h2"] != part["h2"].shift())
            starts = np.flatnonzero(new.to_numpy())
            last = starts[-1]
            done = part.iloc[:last]
            if len(done):
                run = np.cumsum(new.to_numpy()[:last])
                grouped = done.groupby(run)["doc_id"]
                out = done.assign(open=False, drop=(done["doc_id"] != grouped.transform("first")) & (grouped.transform("nunique") >= min_docs))
                if first or edge:
                    out.loc[run == 1, "open"] = True
                yield out
            edge = last == 0 and (first or edge)
            held, first = [part.iloc[last:]], False
        if held:
            yield settle(held[0], True)

    return rows


def shared_line_rows(docs: DataFrame, min_length: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """(doc_id, row, at): the line positions that each document row loses; ``at`` is packed uint32.

    Hashes of the line keys are range-partitioned together with the falling document number, so
    even one very frequent key is cut over many partitions; each partition streams its sorted
    rows and settles every key that lies inside it. For keys that touch a partition's edge (two
    a partition at most) documents are counted by a combining aggregate.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: the draw of range bounds would run over all texts a second time
    keys = checkpoint(docs.mapInPandas(_keys(min_length), "h1 long, h2 long, doc_id long, row long, at binary"))
    ranged = keys.repartitionByRange(n, F.col("h1"), F.col("h2"), F.col("doc_id").desc()).sortWithinPartitions(
        "h1", "h2", F.col("doc_id").desc(), "row"
    )
    streamed = checkpoint(
        ranged.mapInPandas(_stream(min_docs), "h1 long, h2 long, doc_id long, row long, at binary, open boolean, drop boolean")
    )
    edge = streamed.where("open")
    # a document lies in several rows only where its number is repeated; those are merged first
    totals = edge.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.max("doc_id").alias("top")
    ).where(F.col("n_docs") >= min_docs)
    late = edge.join(F.broadcast(totals), ["h1", "h2"]).where(F.col("doc_id") < F.col("top"))
    return streamed.where("not open and drop").select("doc_id", "row", "at").unionByName(late.select("doc_id", "row", "at"))


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, row, dropped): for each document row that loses lines, a compressed bitmap.

    ``dropped`` is a zlib-compressed bit string (most significant bit first), bit i set where
    line i goes. A document is split at newlines; a null or empty text is one empty line. A
    line's key (blanks stripped at both ends, A-Z lowered) of ``min_length`` code points or more
    found in ``min_docs`` documents or more goes everywhere except in the largest document
    number that holds it. Rows of equal number count as one document and each gets its own
    bitmap (``row`` is a hash of the text); exact repeats of a row share one. Rows whose number
    is null are documents of no known place: they are left alone.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text")).where("doc_id is not null")
    lost = shared_line_rows(rows, min_length, min_docs)

    @F.pandas_udf("binary")
    def pack(parts: pd.Series) -> pd.Series:
        def one(p):
            at = np.concatenate([np.frombuffer(x, ">u4") for x in p]).astype(np.int64)
            bits = np.zeros(int(at.max()) + 1, dtype=np.uint8)
            bits[at] = 1
            return zlib.compress(np.packbits(bits).tobytes(), 6)

        return parts.map(one)

    return lost.groupBy("doc_id", "row").agg(F.collect_list("at").alias("at")).select("doc_id", "row", pack("at").alias("dropped"))


def kept_lines(lines: list[str], dropped: bytes | None) -> list[str]:
    """The lines that a bitmap of ``line_bitmaps`` keeps."""
    if dropped is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), dtype=np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(bits).tolist())
    return [x for i, x in enumerate(lines) if i not in gone]


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``doc_id, n_lines, n_dropped, kept_text`` after its bitmap is applied."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches):
        for pdf in batches:
            out = []
            for doc, text_, dropped in zip(pdf["doc_id"], pdf["text"], pdf["dropped"]):
                lines = text_.split("\n")
                kept = kept_lines(lines, dropped)
                out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "kept_text"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return rows.join(bitmaps, ["doc_id", "row"], "left").select("doc_id", "text", "dropped").mapInPandas(
        cut, "doc_id long, n_lines long, n_dropped long, kept_text string"
    )
