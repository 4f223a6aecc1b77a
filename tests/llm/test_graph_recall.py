"""Recall of the graph search against exact comparison, on tables of two shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm.graph_search import nearest


def clustered(draw):
    homes = draw.normal(size=(60, 64)) * 2
    return (homes[draw.integers(0, 60, 12_000)] + draw.normal(size=(12_000, 64)) * 0.7) * draw.lognormal(0, 0.7, (12_000, 1))


@pytest.mark.parametrize("make", [clustered, lambda draw: draw.normal(size=(12_000, 128))], ids=["uneven norms", "128 components"])
def test_recall_of_two_shards(spark, tmp_path, make):
    x = make(np.random.default_rng(8))
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/v")
    asked = np.arange(0, len(x), 60)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {int(q): {int(v) for v in np.argsort(-s, kind="stable")[:20]} for q, s in zip(asked, score)}
    got = {}
    for r in nearest(spark.read.parquet(f"{tmp_path}/v"), F.col("vec_id") % 60 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert np.isclose(r["score"], x[r["query_id"]] @ x[r["vec_id"]])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len(got[q] & v) / 20 for q, v in want.items()])
    assert recall >= 0.95, recall
