"""Benchmark decontamination by canonical templates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint
from tapeworks.llm.names import unused

# Unit words, recognised after a number.
UNITS = [
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "ml", "l", "s", "sec", "seconds", "min",
    "minutes", "h", "hours", "days", "weeks", "months", "years", "miles", "meters", "metres", "inches", "feet", "grams",
    "pounds", "liters", "litres", "dollars", "euros", "cents", "usd", "eur", "gbp", "percent", "degrees", "km/h",
]
TOKEN = r"\p{N}++(?:[.,]\p{N}++)*+|\p{L}[\p{L}\p{M}]*+"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
SHORTEST = 4  # tokens of a whole item that is joined by its template


def tokens(text: Column) -> Column:
    """Words and numbers of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _once(x: Column, f) -> Column:
    """f(x) with x evaluated once for all its uses, as a lambda's variable."""
    return F.element_at(F.transform(F.array(x), f), 1)


def is_number(w: Column) -> Column:
    """Whether a token is a number of any script; tokens begin with a digit or a letter, and ASCII digits come first."""
    return (w < ":") | ((w >= "\u0080") & w.rlike(r"^\p{N}"))


def template(words: Column) -> Column:
    """Numbers, names (words with a capital letter) and units become typed placeholders."""
    units = F.array(*[F.lit(u) for u in UNITS])

    def of(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            after_number = F.when(i > 0, is_number(F.get(ws, i - 1))).otherwise(False)
            return (
                F.when(is_number(w), NUMBER)
                .when(F.lower(w) != w, NAME)
                .when(after_number & F.array_contains(units, w), UNIT)
                .otherwise(w)
            )

        return F.transform(ws, one)

    return _once(words, of)


def _plain(w: Column) -> Column:
    return ~F.startswith(w, F.lit("<"))


def folded(words: Column) -> Column:
    """The template with runs of one placeholder as one: structs of the token and its first word's place."""

    def of(t: Column) -> Column:
        again = lambda w, i: F.when(i > 0, F.startswith(w, F.lit("<")) & (F.get(t, i - 1) == w)).otherwise(False)
        marked = F.transform(t, lambda w, i: F.when(~again(w, i), F.struct(w.alias("w"), i.alias("at"))))
        return F.filter(marked, lambda z: z.isNotNull())

    return _once(template(words), of)


def _values(words: Column, f: Column) -> Column:
    """The words of each folded token, in small letters."""

    def of(at: Column) -> Column:  # bound: a field of all structs is copied at each use, which is quadratic in the text
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(words))
        return F.transform(at, lambda i, k: F.lower(F.array_join(F.slice(words, i + 1, end(k) - i), " ")))

    return _once(f["at"], of)


def _windows(x: Column, width: int, keep=None) -> Column:
    """(start, key) of every window of ``width`` elements that ``keep`` holds for."""
    cut = lambda i: F.slice(x, i + 1, width)
    at = F.when(F.size(x) >= width, F.sequence(F.lit(0), F.size(x) - width)).otherwise(F.array().cast("array<int>"))
    at = at if keep is None else F.filter(at, lambda i: keep(cut(i)))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.xxhash64(F.lit(width), cut(i)).alias("key")))


def _small(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    width: int = 7, min_literals: int = 3, coverage: float = 0.6, max_clashes: float = 0.2, broadcast_rows: int = 500_000,
) -> DataFrame:
    """(doc_id, item_id, start, n_matched, coverage, n_slots, n_changed): benchmark items found in documents.

    Documents and items are cut into words, and words become a template: numbers, names and
    units turn into typed placeholders, a run of one placeholder into one token, other words stay.
    Every window of ``width`` template tokens of a document is hash-joined with all windows of the
    items; an item of fewer tokens (four at least) is joined as one window of its own length. Each
    meeting fixes an alignment: a shift of the item along the document. Shifts fall into stretches
    as long as the item, and those of each three neighbouring stretches are joined into the longest chain of
    agreeing tokens in the order of both texts (of chains equally long, the one that ends first), so words put
    in or left out do not split an item, and the work grows with the document's length however often the item
    repeats itself or is repeated. It counts as found if ``coverage`` of its tokens agree and
    ``min_literals`` of them in their very words. The slots must agree as well: a value of the
    item stands for one value of the document and back, but for a share of ``max_clashes`` of the
    pairs. ``start`` is the word of the document at which the item begins; ``n_changed`` counts slots with
    another value, so a re-parameterised question shows as found with n_changed > 0.

    A window without a plain word tells nothing apart and is not joined. Items without any window
    to join (under four tokens, or placeholders only) are found where all their words stand in a
    row, capitals aside. Null and empty texts hold and match nothing. Rows with a null number are
    left out; repeated rows give one result; texts that share a number are judged one by one and the
    best find is reported. The item windows are broadcast only if they are
    counted to be ``broadcast_rows`` at most.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(text)).alias("item_words")).where("item_id is not null").where(F.size("item_words") > 0)
    items = items.select("item_id", "item_words", folded(F.col("item_words")).alias("f"))
    items = checkpoint(items.select("item_id", "item_words", F.col("f.w").alias("a"), _values(F.col("item_words"), F.col("f")).alias("x")).distinct())
    shape = F.least(F.size("a"), F.lit(width))
    tall = sorted(r["w"] for r in items.where(F.size("a") >= min(SHORTEST, width)).select(shape.alias("w")).distinct().collect())
    parts = [items.where(shape == w).select("item_id", F.size("a").alias("n"), F.inline(_windows(F.col("a"), w, lambda c: F.exists(c, _plain)))) for w in tall]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("version")).where("doc_id is not null")
    windows = items.select("item_id", F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("key")).limit(0)
    for part in parts:
        windows = windows.unionByName(part)
    windows = checkpoint(windows.select("item_id", "n", F.col("start").alias("offset"), "key").distinct())
    joined = windows.select("item_id").distinct()
    bare = checkpoint(items.join(joined, "item_id", "left_anti").select("item_id", F.transform("item_words", F.lower).alias("item_words")))
    exact = sorted(r["w"] for r in bare.select(F.least(F.size("item_words"), F.lit(width)).alias("w")).distinct().collect())

    found = _chained(rows, windows, items, tall, broadcast_rows, coverage, max_clashes, min_literals)
    return found.unionByName(_verbatim(rows, bare, exact, width, broadcast_rows)) if exact else found


def _met(rows: DataFrame, x, of, widths: list[int], windows: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc_id, version, item_id, n, shift) where a window of a document meets one of an item of n tokens."""
    keys = rows.select("doc_id", "version", F.inline(_once(x, lambda t: F.concat(*[of(t, w) for w in widths]))))
    near = F.broadcast(windows) if _small(windows, broadcast_rows) else windows
    return keys.join(near, "key").select("doc_id", "version", "item_id", "n", (F.col("start") - F.col("offset")).alias("shift"))


def _held(rows: DataFrame, met: DataFrame) -> DataFrame:
    ids = met.select("doc_id", "version").distinct()
    return rows.join(F.broadcast(ids) if _small(ids, 500_000) else ids, ["doc_id", "version"], "left_semi")


def _chained(rows, windows, items, widths, broadcast_rows, coverage, max_clashes, min_literals) -> DataFrame:
    met = _met(rows, folded(tokens(F.col("text")))["w"], _windows, widths or [1], windows, broadcast_rows)
    own = ["doc_id", "version", "item_id"]
    stretch = F.floor(F.col("shift") / F.col("n"))
    met = met.select(*own, "shift", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    met = met.groupBy(*own, "stretch").agg(F.reverse(F.array_sort(F.collect_set("shift"))).alias("shifts"))
    met = checkpoint(met.groupBy(*own).agg(F.collect_set("shifts").alias("sets")))
    found = _held(rows, met).select("doc_id", "version", tokens(F.col("text")).alias("words")).select("doc_id", "version", "words", folded(F.col("words")).alias("f"))
    found = found.select("doc_id", "version", F.col("f.w").alias("t"), F.col("f.at").alias("at"), _values(F.col("words"), F.col("f")).alias("y"))
    pairs = met.join(found, ["doc_id", "version"]).join(items.select("item_id", "a", "x"), "item_id")
    return _aligned(pairs, coverage, max_clashes, min_literals)


def _verbatim(rows, bare, widths, width, broadcast_rows) -> DataFrame:
    """Items of which no window is joined, where all their words stand in a row."""
    shape = F.least(F.size("item_words"), F.lit(width))
    windows = None
    for w in widths:
        part = bare.where(shape == w).select("item_id", F.size("item_words").alias("n"), F.lit(0).alias("offset"), F.xxhash64(F.lit(w), F.slice("item_words", 1, w)).alias("key"))
        windows = part if windows is None else windows.unionByName(part)
    words = F.transform(tokens(F.col("text")), F.lower)
    met = _met(rows, words, _windows, widths, windows, broadcast_rows).groupBy("doc_id", "version", "item_id")
    met = checkpoint(met.agg(F.array_sort(F.collect_set("shift")).alias("shifts")))
    found = _held(rows, met).select("doc_id", "version", words.alias("words"))
    n = F.size("item_words")
    stands = F.filter("shifts", lambda s: F.slice("words", s + 1, n) == F.col("item_words"))
    same = met.join(found, ["doc_id", "version"]).join(bare, "item_id")
    same = same.select("doc_id", "item_id", "item_words", F.get(stands, F.lit(0)).alias("shift")).where("shift is not null")
    return same.groupBy("doc_id", "item_id").agg(
        F.min("shift").cast("long").alias("start"), F.max(n).cast("long").alias("n_matched"), F.lit(1.0).alias("coverage"),
        F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed"),
    )


def _chain(points: Column) -> Column:
    """The longest chain of (i, j) that rises in both; ``points`` are in order of i, then of falling j.

    For every length the chain that ends at the smallest j so far is kept, so each point takes the place of
    the first one that ends at its j or later. A fold copies its state at every step, all but binary values:
    chains are binary lists of the points' places. Names are bound by a fold over one element.
    """
    kind = "struct<js:array<int>,chains:array<binary>>"
    none = F.struct(F.array().cast("array<int>").alias("js"), F.array().cast("array<binary>").alias("chains"))
    bound = lambda x, of: F.aggregate(F.array(x), none.cast(kind), lambda _, v: of(v))

    def add(ends: Column, z: Column) -> Column:
        def put(k: Column) -> Column:
            chain = F.concat(F.coalesce(F.get(ends["chains"], k - 1), F.lit("").cast("binary")), F.concat(z["at"].cast("string"), F.lit(",")).cast("binary"))
            into = lambda x, v: F.concat(F.slice(x, F.lit(1), k), F.array(v), F.slice(x, k + 2, F.size(x)))
            return F.struct(into(ends["js"], z["j"]).alias("js"), into(ends["chains"], chain).alias("chains"))

        return bound(F.size(F.filter(ends["js"], lambda j: j < z["j"])), put)

    places = F.transform(points, lambda z, at: F.struct(z["j"].alias("j"), at.alias("at")))
    best = F.aggregate(places, none.cast(kind), add, lambda ends: F.get(ends["chains"], F.size(ends["chains"]) - 1).cast("string"))
    return F.transform(F.split(F.rtrim(best, F.lit(",")), ","), lambda at: F.get(points, at.cast("int")))


def _aligned(pairs: DataFrame, coverage: float, max_clashes: float, min_literals: int) -> DataFrame:
    n = F.size("a")
    lines = pairs.select("*", F.explode("sets").alias("near")).drop("sets")
    fits = lambda i: F.filter("near", lambda s: F.get("t", i + s) == F.get("a", i))
    points = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(fits(i), lambda s: F.struct(i.alias("i"), (i + s).alias("j")))))
    lines = lines.withColumn("points", points)
    lines = lines.withColumn("chain", F.when(F.size("near") == 1, F.col("points")).otherwise(_chain(F.col("points"))))

    # at the item's ends a run of one placeholder may hold words of the document around it
    def other(z: Column) -> Column:
        x, y = F.get("x", z["i"]), F.get("y", z["j"])
        more = ((z["i"] == 0) & F.endswith(y, F.concat(F.lit(" "), x))) | ((z["i"] == n - 1) & F.startswith(y, F.concat(x, F.lit(" "))))
        return F.when(more, x).otherwise(y)

    both = F.transform("chain", lambda z: F.struct(F.get("a", z["i"]).alias("a"), F.get("x", z["i"]).alias("x"), other(z).alias("y")))
    lines = lines.withColumn("both", both)
    slot = F.transform(
        F.filter("both", lambda z: ~_plain(z["a"])),
        lambda z: F.struct(F.concat_ws(" ", z["a"], z["x"]).alias("x"), F.concat_ws(" ", z["a"], z["y"]).alias("y")),
    )
    head = F.get("chain", F.lit(0))
    begin = F.greatest(head["j"] - head["i"], F.lit(0))
    before = F.get("y", begin)
    lead = F.when((head["i"] == 0) & F.endswith(before, F.concat(F.lit(" "), F.get("x", F.lit(0)))), F.size(F.split(before, " ")) - F.size(F.split(F.get("x", F.lit(0)), " "))).otherwise(0)
    got = lines.select("doc_id", "item_id", n.alias("n"), (F.get("at", begin) + lead).cast("long").alias("start"), "both", slot.alias("slot"))
    # a generated row: the limits below do not move past it, so no chain is found again for each of them
    judged = F.struct(
        "start", F.size("both").cast("long").alias("n_matched"), (F.size("both") / F.col("n")).alias("coverage"),
        F.size(F.filter("both", lambda z: z["x"] == z["y"])).alias("same"),
        F.size("slot").cast("long").alias("n_slots"),
        F.size(F.filter("slot", lambda s: s["x"] != s["y"])).cast("long").alias("n_changed"),
        F.size(F.array_distinct("slot")).alias("p"),
        F.size(F.array_distinct(F.transform("slot", lambda s: s["x"]))).alias("px"),
        F.size(F.array_distinct(F.transform("slot", lambda s: s["y"]))).alias("py"),
    )
    got = got.select("doc_id", "item_id", F.inline(F.array(judged)))
    good = got.where((F.col("coverage") >= coverage) & (F.col("same") >= min_literals) & (F.col("p") - F.least("px", "py") <= max_clashes * F.col("p")))
    names = ["n_matched", "coverage", "start", "n_slots", "n_changed"]
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(*names)).alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.n_matched", "b.coverage", "b.n_slots", "b.n_changed")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose document holds no benchmark item. Rows with a null number stay."""
    own = unused(docs, "gone")
    gone = checkpoint(contaminated(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(own)).distinct())
    gone = F.broadcast(gone) if _small(gone, 500_000) else gone
    return docs.join(gone, docs[doc_id].cast("long") == gone[own], "left_anti")
