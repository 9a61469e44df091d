"""What workers hold and what is written doesn't grow faster than the input."""

from __future__ import annotations

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sagebrook import catalogue
from sagebrook.operators import dense, sparse, text_index
from sagebrook.operators.keyed_table import KeyedTable
from sagebrook.operators.text_index import TextIndex
from sagebrook.plans import search
from sagebrook.session import BATCH_BYTES, with_checkpoints


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_a_scan_holds_small_blocks(metric):
    """Many queries at once don't make a worker's products larger."""
    x = np.random.default_rng(1).normal(size=(4096, 8))
    column = pa.array(x.tolist(), pa.list_(pa.float64()))

    class Sent:
        value = dense._Batch(pa.table({"query_id": np.arange(4096), "vector": column}), metric, None, 0)

    tracemalloc.start()
    out = list(dense._best(Sent, 3)([pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), column], names=["id", "vector"])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 3 * 4096 and peak < 60 << 20


def test_batches_of_long_texts(spark):
    """Workers get so many bytes, not so many rows; also in pandas functions."""
    rows = with_checkpoints(spark).range(0, 600, 1, 1).select("id", F.repeat(F.lit("x"), 50_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 1.1 * BATCH_BYTES
    many = F.pandas_udf(lambda t: t.map(lambda _: len(t)), "long")
    assert rows.select(many("text").alias("n")).agg(F.max("n")).first()[0] < 100


def test_files_of_a_keyed_table(spark, tmp_path):
    """A bucket has files by its size, not one of every task."""
    rows = spark.range(0, 4000, 1, 16).select("id", (F.col("id") % 3).alias("n"))
    stored = KeyedTable(spark, f"file://{tmp_path}/t", "id long, n long", "id", buckets=8)
    stored.append(rows)
    assert len(list(Path(tmp_path).rglob("*.parquet"))) <= 8
    gone = rows.where("id % 50 = 0").select("id")
    stored.change(gone, lambda old: old.join(gone, "id", "left_anti"))
    assert stored.read().count() == 3920 and len(list(Path(tmp_path).rglob("*.parquet"))) <= 8


def test_only_the_best_are_deduplicated(spark, sf_dir, monkeypatch):
    """Of all matches those go through the rounds that can be among a query's results."""
    seen, of = [], catalogue.fusion.greedy_dedup
    monkeypatch.setattr(catalogue.fusion, "greedy_dedup", lambda rows, *a, **b: (seen.append(rows.groupBy("query_id").count().agg(F.max("count")).first()[0]), of(rows, *a, **b))[1])
    monkeypatch.setattr(catalogue, "S", catalogue.Settings(candidates=2))
    monkeypatch.setattr(catalogue, "_asked", lambda s, d: s.createDataFrame([(1, ["th"]), (2, ["the"])], "query_id long, terms array<string>"))
    assert catalogue.hybrid_rrf_single_sided(spark, sf_dir).count() == 4 and seen == [2]


def test_hybrid_search_by_an_index(spark, tmp_path, monkeypatch):
    texts = with_checkpoints(spark).createDataFrame([(i, f"tree w{i % 7} " + "river " * (i % 3)) for i in range(60)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, [3.0, 1.0], ["tree", "river"]), (2, None, ["tr", "w1"]), (3, [1.0, 0.0], [])], "query_id long, vector array<double>, terms array<string>")
    wanted = sorted(map(tuple, search.hybrid(spark, vectors, texts, queries, candidates=5).collect()))
    index = TextIndex.build(spark, texts, f"file://{tmp_path}/i")
    monkeypatch.setattr(search, "search", lambda *_: pytest.fail("a scan of all texts"))
    assert sorted(map(tuple, search.hybrid(spark, vectors, texts, queries, candidates=5, index=index).collect())) == wanted and len(wanted) == 13


@pytest.fixture
def saved(monkeypatch):
    """Rows of what a search of the index checkpoints."""
    seen, of = [], text_index.kept
    monkeypatch.setattr(text_index, "kept", lambda df: (out := of(df), seen.append(out.count()))[0])
    return seen


def _frequent(spark, n):
    """Documents that all hold all terms, and queries of two of these."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 13:02} w{k:02}" for k in range(12)) + " x" * (i % 29), "en" if i % 2 else "de") for i in range(n)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(a * 100 + b, [f"w{a:02}", f"w{b:02}"]) for a in range(8) for b in range(8) if a != b], "query_id long, terms array<string>")


def test_short_questions_without_pairs_of_blocks(spark, tmp_path, monkeypatch, saved):
    """Frequent terms: no row is made for each query and each block, nor for each of their documents."""
    monkeypatch.setattr(text_index, "BLOCK", 2)
    docs, queries = _frequent(spark, 400)
    index = TextIndex.build(spark, docs, f"file://{tmp_path}/i")
    found = index.search(queries, 3).collect()
    assert len(found) == 56 * 3 and max(saved) <= 56 * 3 * 8 + 8
    assert sorted(map(tuple, found)) == sorted(map(tuple, sparse.search(docs, queries, 3).select("query_id", "id", "score", "rank").collect()))


def test_filtered_search_passes_on_the_best(spark, tmp_path, monkeypatch, saved):
    """With a filter, too, a task passes on no more than a query's best rows."""
    docs, queries = _frequent(spark, 400)
    index = TextIndex.build(spark, docs, f"file://{tmp_path}/i")
    only = docs.where("lang = 'en'")
    found = index.search(queries, 3, among=only).collect()
    assert len(found) == 56 * 3 and max(n for n in saved if n != 200) <= 56 * 3 * 8 + 8
    assert sorted(map(tuple, found)) == sorted(map(tuple, sparse.search(only, queries, 3).select("query_id", "id", "score", "rank").collect()))


def _bytes(folder, name):
    return sum(f.stat().st_size for f in Path(folder, name).rglob("*.parquet"))


def test_an_index_is_smaller_than_its_texts(spark, sf_dir, tmp_path):
    """What a build writes and shuffles: tokens once for a block, without positions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    TextIndex.build(spark, docs.select("doc_id", "text").coalesce(1), f"file://{tmp_path}/i")
    parts = {p.name for p in (tmp_path / "i").iterdir() if p.is_dir()}
    assert sum(_bytes(tmp_path / "i", p) for p in parts - {"texts"}) < _bytes(tmp_path / "i", "texts")


def test_prompts_get_what_is_within_the_budget(spark, sf_dir, monkeypatch):
    """Texts that a prompt has no room for aren't joined to it."""
    seen, of = [], search.prompts
    monkeypatch.setattr(catalogue.search, "prompts", lambda rows, *a, **b: (seen.extend(rows.groupBy("query_id").agg(F.sum(F.length("text")).alias("all"), F.count("*").alias("n")).collect()), of(rows, *a, **b))[1])
    monkeypatch.setattr(catalogue, "S", catalogue.Settings(context_chars=500))
    catalogue.answer_prompts(spark, sf_dir).collect()
    assert seen and all(r["all"] <= 500 or r.n == 1 for r in seen)


def test_texts_of_candidates_stay_in_their_task(spark, tmp_path):
    """A whole text as a query is compared where the documents are; only what is found leaves the task."""
    docs = spark.createDataFrame([(i, f"tree w{i % 3} river house " + "x " * (i % 2)) for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, ["tree", "w1", "river", "house"]), (2, ["tr", "w2", "ri"])], "query_id long, terms array<string>")
    found = TextIndex.build(spark, docs, f"file://{tmp_path}/i").scored(queries)
    assert "split(words" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sparse.scored(docs, queries).select("query_id", "id", "score").collect()))
