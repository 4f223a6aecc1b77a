"""Each stage of the corpus pipeline on its own input, against plain Python."""

import random
import zlib
from collections import Counter

import pytest
from test_brute_force import mixed, plain_jump
from test_jaccard import brute, shingles

import corpus_pipeline
from tapeworks.llm import line_crf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, shard int, score double"
ITEM = "if Tom buys 12 pencils at the corner shop and then gives 5 pencils to a friend how many pencils are left over"
REPEATED = "and here comes a question If Anna buys 40 pencils at the corner shop and then gives 7 pencils to a friend how many pencils are left over yes"


def document(rnd, good):
    words = [f"w{rnd.randint(0, 900)}" for _ in range(45)]
    return "\n".join(" ".join(words[k : k + 9]) + "." if good else "!! $$ " + " ## ".join(words[k : k + 9]).upper() for k in range(0, 45, 9))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad documents, exact and near copies, a benchmark item, nulls, empties, repeats, clashing column names."""
    rnd = random.Random(11)
    texts = [document(rnd, i % 3 != 0) for i in range(90)]
    texts += [texts[1], texts[1] + " tail", texts[4].replace("w", "W"), REPEATED, None, "", "   "]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 1, 7, 3, 0.5) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (5, texts[7] + " and more", "en", "a", 1, 7, 3, 0.5), (None, texts[8], "en", "a", 1, 7, 3, 0.5)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(90)], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def seen(spark, folder, tmp_path_factory):
    """Input and output rows of every stage; each result is written and read again."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    at = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{at}/{name}")
        after = spark.read.parquet(f"{at}/{name}")
        if name != "shard":
            assert after.columns == docs.columns
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def test_quality_keeps_what_the_chain_scores_high(spark, folder, seen):
    before, after = seen["quality"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = line_crf.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = [r for r in before if model.score([(r["text"] or "").encode()])[0] >= 0.3]
    assert Counter(good) == Counter(after)
    ids = {r["doc_id"] for r in after}
    assert all((i in ids) == (i % 3 != 0) for i in range(90))


def test_one_of_each_group_of_near_copies_stays(seen):
    before, after = seen["near_duplicates"]
    texts = {}
    for r in before:
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    # of a number's texts the one with most shingles is compared; rows of a number with several texts stay
    component = {i: v[2] for i, v in brute([(i, max(ts, key=lambda t: len(shingles(t)))) for i, ts in texts.items() if i is not None]).items()}
    stay = {r for r in before if r["doc_id"] is None or len(texts[r["doc_id"]]) > 1 or component[r["doc_id"]] == r["doc_id"]}
    assert set(after) == stay and len(after) == len(stay)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {90, 91, 92} & {r["doc_id"] for r in before} <= gone


def test_benchmark_items_go_and_the_rest_stays(seen):
    before, after = seen["decontaminate"]
    assert Counter(after) == Counter(r for r in before if r["text"] != REPEATED)


def test_mixing_repeats_and_loses_nothing(seen):
    before, after = seen["mix"]
    assert set(before) == set(after)
    words, read = Counter(), Counter()
    for r in before:
        words[r["source"]] += len((r["text"] or "").split())
    for r in after:
        read[r["source"]] += len((r["text"] or "").split())
    # the source with the largest ratio of tokens to weight is read once, none more often than four times as much
    assert min(read[s] / words[s] for s in words) == 1 and max(read[s] / words[s] for s in words) <= 4


def test_shards_follow_the_scalar_hash(seen):
    before, after = seen["shard"]
    assert Counter((r["doc_id"], r["text"]) for r in before) == Counter((r["doc_id"], r["text"]) for r in after)
    for r in after:
        key = -(1 << 62) if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == plain_jump(mixed(key), 24)
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
    for s in {r["shard"] for r in after}:
        slots = sorted(r["slot"] for r in after if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_run_gives_the_rows_of_its_stages(spark, folder, seen):
    key = lambda r: (r["doc_id"], r["text"], r["shard"])
    assert Counter(map(key, corpus_pipeline.run(spark, folder).collect())) == Counter(map(key, seen["shard"][1]))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
