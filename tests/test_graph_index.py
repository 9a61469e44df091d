from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebrook.catalogue import QUERIES
from sagebrook.operators import graph_index
from sagebrook.operators.dense import nearest
from sagebrook.operators.graph_index import GraphIndex, indexed_nearest

ROWS = "id long, vector array<double>"


def recall(found, exact):
    of = lambda df: {(r.query_id, r.id) for r in df.collect()}
    want = of(exact)
    return len(of(found) & want) / len(want)


@pytest.mark.parametrize("shard", [graph_index.SHARD, 1500])
def test_recall_and_comparisons(spark, tmp_path, shard):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 48))
    x[3000:] = x[:3000] + rng.normal(size=(3000, 48)) * 0.4  # half of them are near another one
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS)
    queries = corpus.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = GraphIndex.create(spark, corpus, f"file://{tmp_path}/i", shard=shard)
    assert index.shards == -(-6000 // shard)
    beam = 40 if index.shards == 1 else 30
    found = index.nearest(queries, 30, beam=beam)
    assert recall(found, nearest(spark, corpus, queries, 30)) >= 0.95
    if index.shards == 1:
        compared = index.found(queries, 30, beam=beam).agg(F.sum("compared")).first()[0]
        assert compared < 0.25 * 6000 * queries.count()
    ranks = found.groupBy("query_id").agg(F.collect_list("rank").alias("r"), F.collect_list(F.struct(-F.col("score"), "id")).alias("s")).collect()
    assert all(sorted(r.r) == list(range(1, 31)) for r in ranks)
    assert recall(GraphIndex(spark, index.folder).nearest(queries, 30, beam=400), nearest(spark, corpus, queries, 30)) >= 0.999


def test_unsound_vectors_copies_and_thresholds(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(300)]  # many copies
    rows += [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [1.0]), (1003, [float("nan"), 1.0, 1.0]), (1004, []), (None, [1.0, 1.0, 1.0])]
    corpus = spark.createDataFrame(rows, ROWS)
    queries = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, 2.0])], "query_id long, vector array<double>")
    index = GraphIndex.create(spark, corpus, f"file://{tmp_path}/a", shard=100)
    found = index.nearest(queries, 5).collect()
    assert {r.query_id for r in found} == {1} and len(found) == 5 and {r.score for r in found} == {1.0}
    assert GraphIndex.create(spark, corpus, f"file://{tmp_path}/b", threshold=10_000) is None
    exact = indexed_nearest(spark, corpus.where("id < 1000"), queries.where("query_id = 1"), 5, f"file://{tmp_path}/c", threshold=10_000)
    assert [r.score for r in exact.orderBy("rank").collect()] == [1.0] * 5
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], ROWS)
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, vector array<double>")
    assert [r.id for r in indexed_nearest(spark, few, asked, 3, f"file://{tmp_path}/d", threshold=1).orderBy("rank").collect()] == [1, 2]


def test_registered_query_finds_nearly_all(spark, sf_dir):
    exact = QUERIES["knn_cosine_topk"](spark, sf_dir)
    assert recall(QUERIES["knn_graph_topk"](spark, sf_dir), exact) >= 0.95
