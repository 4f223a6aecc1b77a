"""Decontamination on repeated texts, digits of other scripts and clashing names; chains against plain Python."""

import random
import time

from pyspark.sql import functions as F

from tapeworks.llm import decontaminate

TEN = "one two three four five six seven eight nine ten"


def longest(points):
    """Length of the longest chain rising in both, and the smallest last j of such a chain, by comparing all pairs."""
    best = {}
    for i, j in sorted(points):
        best[i, j] = 1 + max((n for (a, b), n in best.items() if a < i and b < j), default=0)
    n = max(best.values(), default=0)
    return n, min((j for (_, j), m in best.items() if m == n), default=None)


def test_chains_are_the_longest_and_end_first(spark):
    rnd = random.Random(5)
    sets = [[(i, j) for i in range(h) for j in range(w) if rnd.random() < p] for h, w, p in [(6, 9, 0.3), (9, 20, 0.5), (12, 30, 0.15), (5, 40, 0.9), (20, 60, 0.1)] * 12]
    rows = spark.createDataFrame([(k, sorted(s, key=lambda z: (z[0], -z[1]))) for k, s in enumerate(sets)], "k int, points array<struct<i:int,j:int>>")
    for r in rows.select("k", decontaminate._chain(F.col("points")).alias("chain")).collect():
        chain = [tuple(z) for z in r["chain"] or []]
        assert set(chain) <= set(sets[r["k"]])
        assert all(a < c and b < d for (a, b), (c, d) in zip(chain, chain[1:], strict=False))
        assert (len(chain), chain[-1][1] if chain else None) == longest(sets[r["k"]])


def test_items_repeated_in_documents_that_repeat_them(spark):
    item = " ".join([TEN] * 8)
    bench = spark.createDataFrame([(1, item), (2, "la " * 90)], "item_id long, text string")
    texts = [" ".join([item] * k) for k in (1, 2, 4, 50)] + ["la " * 1500, " ".join([TEN] * 4), "begin " + item.replace("six", "6") + " end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(rows, bench).collect()}
    # 40 of the 80 words are too few; an item broken at every tenth word holds windows between the breaks
    assert set(got) == {(k, 1) for k in (0, 1, 2, 3, 6)} | {(4, 2)}
    assert all(got[k, 1]["coverage"] == 1.0 for k in range(4)) and got[6, 1]["n_matched"] == 72
    assert time.time() - began < 120


def test_an_item_broken_by_words_put_in_is_one(spark):
    words = [f"w{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(40)]
    cut = words[:15] + ["x"] * 11 + words[15:28] + ["y"] * 14 + words[28:]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    leads = (0, 1, 29, 30, 39, 40, 41)
    rows = spark.createDataFrame([(k, " ".join(["z"] * k + cut)) for k in leads], "doc_id long, text string")
    got = decontaminate.contaminated(rows, bench).collect()
    assert sorted((r["doc_id"], r["start"], r["n_matched"]) for r in got) == [(k, k, 40) for k in leads]


def test_digits_of_any_script(spark):
    item = "a tank holds {} litres of water and loses {} litres every hour until it is dry"
    bench = spark.createDataFrame([(1, item.format("１２", "٣"))], "item_id long, text string")
    rows = spark.createDataFrame([(1, item.format("12", "3")), (2, item.format("५", "7,5")), (3, item.format("few", "some"))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_changed"] for r in decontaminate.contaminated(rows, bench).collect()}
    assert set(got) >= {1, 2} and got[1] == 2


def test_texts_that_share_a_number_are_judged_one_by_one(spark):
    words = [f"{a}{b}" for a in "abcd" for b in "efghij"]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    halves = [" ".join(words[:12]), "q " + " ".join(words[12:])]
    rows = spark.createDataFrame([(1, halves[0]), (1, halves[1]), (1, halves[1]), (2, " ".join(words)), (2, None), (2, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["n_matched"]) for r in decontaminate.contaminated(rows, bench).collect()] == [(2, 24)]


def test_columns_of_clashing_names_stay(spark):
    bench = spark.createDataFrame([(1, TEN)], "item_id long, text string")
    names = "__gone long, doc_id long, text string, item_id long, shifts string, version int, __GONE_ string, key string"
    rows = spark.createDataFrame([(7, 1, f"say {TEN} now", 3, "s", 4, "g", "k"), (7, 2, "clean", 3, "s", 4, "g", "k"), (None, None, TEN, None, None, None, None, None)], names)
    assert decontaminate.drop_contaminated(rows, bench).collect() == [r for r in rows.collect() if r["doc_id"] != 1]


def test_values_of_long_texts_grow_with_the_text(spark):
    """200,000 words; with the places of all tokens copied at each of them this does not end in time."""
    words = " ".join(["in 3 km", "Anna Maria", "walks"] * 33_334)
    d = spark.createDataFrame([(words,)], "text string").select(decontaminate.tokens(F.col("text")).alias("words"))
    d = d.select("words", decontaminate.folded(F.col("words")).alias("f"))
    began = time.monotonic()
    got = d.select(decontaminate._values(F.col("words"), F.col("f")).alias("v")).first()["v"]
    assert got == ["in", "3", "km", "anna maria", "walks"] * 33_334
    assert time.monotonic() - began < 30
