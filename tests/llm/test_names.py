"""Columns of the user's table whose names helpers or results bear."""

from collections import Counter

from tapeworks.llm import mixing, sharding

NAMES = ["__key", "__row", "__id", "__text", "__turns", "__rest", "__bucket", "__n", "n", "key", "row", "bucket", "before", "a.b", "weight"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES)


def table(spark, more="", values=()):
    rows = [(i, t, s, *[f"{c}{i}" for c in NAMES], *values) for i, t, s in [(1, "a b", "x"), (2, "c d", "x"), (3, None, None), (4, "", "y"), (None, "e", "y"), (1, "a b", "x")]]
    return spark.createDataFrame(rows, SCHEMA + more)


def test_mixing_keeps_them(spark):
    docs = table(spark)
    got = mixing.mix_sources(docs)
    assert got.columns == [*docs.columns, "__n_tokens", "__weight", "__epoch", "__block", "__place"]
    rows = got.collect()
    assert {tuple(r)[: len(docs.columns)] for r in rows} == {tuple(r) for r in docs.collect()}
    taken = mixing.mix_sources(table(spark, ", __WEIGHT string, __place int", ("w", 1)))
    assert Counter(map(tuple, taken.collect())) == Counter(map(tuple, rows)) and taken.columns == got.columns


def test_sharding_keeps_them(spark):
    docs = table(spark)
    got = sharding.assign_shards(docs, 3)
    assert got.columns == [*docs.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    assert Counter(tuple(r)[: len(docs.columns)] for r in rows) == Counter(map(tuple, docs.collect()))
    taken = sharding.assign_shards(table(spark, ", SLOT string", ("s",)), 3)
    assert Counter(map(tuple, taken.collect())) == Counter(map(tuple, rows)) and taken.columns == got.columns
