from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sagebrook.models import FirstPassage, HashEmbedder, OverlapReranker, reranker
from sagebrook.operators.catalog import Collections, insert_absent, upsert
from sagebrook.plans import ingest, search
from sagebrook.session import with_checkpoints
from sagebrook.sources import files


def test_files_to_chunks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello there.\n\n7\n\nMore text.")
    (tmp_path / "b.csv").write_text('name,note\nx,"1, 2"\ny,\n')
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.pdf").write_bytes(b"one|two||four")
    pages = lambda content: [(i + 1, t, False) for i, t in enumerate(content.decode().split("|"))]
    records = files.with_metadata(files.load_text(spark, str(tmp_path)).unionByName(files.load_csv(spark, str(tmp_path))).unionByName(files.load_pdf(spark, str(tmp_path), pages)))
    rows = sorted((r.file_name, r.source_type, r.page, r.text) for r in records.na.fill({"page": 0}).collect())
    assert rows == [("a.txt", "txt", 0, "Hello there.\n\n7\n\nMore text."), ("b.csv", "csv", 0, "name: x\nnote: 1, 2"), ("b.csv", "csv", 0, "name: y\nnote: "), ("d.pdf", "pdf", 1, "one"), ("d.pdf", "pdf", 2, "two"), ("d.pdf", "pdf", 4, "four")]
    chunks = ingest.numbered(ingest.split(records), "file_name", "page", "row")
    found = sorted((r.file_name, r.chunk_order, r.chunk_text) for r in chunks.collect())
    assert ("a.txt", 1, "Hello there.\nMore text.") in found and ("d.pdf", 3, "four") in found


def test_csv_in_splits(spark, tmp_path):
    """What csv makes of each file whole, however it is split; no file is one row."""
    import csv
    import io

    body = "".join(f"{i},a{i}{',more,yet' * (i % 7 == 0)}\r\n" + "\n" * (i % 5 == 0) for i in range(3000))
    made = {"plain a+b%25.csv": "\ufeffid,x\r\n" + body, "quoted.csv": 'id,"x\ny"\n' + body + '7,"two\nlines, ""so"""\n8,"open\n', "blank.csv": "\n" + body[:90], "named.csv": "only,names\n", "none.csv": "", "few.csv": "a,b,a\n1\n2,3,4"}
    for name, text in made.items():
        (tmp_path / name).write_bytes(text.encode() + b"9,\xff\xc3\n" * (len(text) > 9000))
    for size in ("1g", "5000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = sorted((r.path.rsplit("/", 1)[1], r.row, r.text) for r in files.load_csv(spark, str(tmp_path)).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        wanted = []
        for name in made:
            table = csv.DictReader(io.StringIO((tmp_path / name).read_bytes().decode("utf-8-sig", errors="replace")))
            wanted += [(name, i, "\n".join(f"{(k or '').strip()}: {(v if isinstance(v, str) else ', '.join(v or [])).strip()}" for k, v in r.items())) for i, r in enumerate(table)]
        assert len(found) > 6000 and found == sorted(wanted)
    plan = files.load_csv(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "MapInArrow" in plan


def test_collections(spark, tmp_path):
    store, model = Collections(spark, f"{tmp_path}/store"), HashEmbedder(8)
    chunks = spark.createDataFrame([(1, "red apples"), (2, "green pears"), (3, "")], "chunk_id long, chunk_text string")
    assert not store.exists(8, 5) and store.info(8, 5) is None
    ingest.index(chunks.where("chunk_id < 3"), store, model, 5)
    ingest.index(chunks, store, model, 5)
    assert store.info(8, 5) == {"name": "collection_8_5", "records": 3} and [r.name for r in store.names().collect()] == ["collection_8_5"]
    assert ingest.pending(chunks, store.indexed_ids(8, 5)).isEmpty()
    one = store.read(8, 5).where("id = 1").select("id", "text", "vector", "metadata", "chunk_id").checkpoint() if spark.sparkContext.getCheckpointDir() else with_checkpoints(spark) and store.read(8, 5).where("id = 1").select("id", "text", "vector", "metadata", "chunk_id").checkpoint()
    store.insert(one, 8, 5, reset=True)
    assert store.read(8, 5).count() == 1
    with pytest.raises(ValueError):
        store.insert(one, 9, 5)
    store.drop(8, 5)
    assert not store.exists(8, 5)


def test_upsert_and_insert_absent(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k long, en string, ar string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "k long, en string")
    assert sorted(map(tuple, upsert(t, n, "k").collect())) == [(1, "a", "x"), (2, "c", None), (3, "d", None)]
    assert insert_absent(t, t.withColumn("k", F.col("k") + 1), ["k"]).count() == 3


def test_answering(spark):
    with_checkpoints(spark)
    texts = spark.createDataFrame([(1, "red apples grow"), (2, "green pears grow"), (3, "blue sea")], "doc_id long, text string")
    model = HashEmbedder(64)
    vectors = ingest.embedded(texts.toDF("chunk_id", "chunk_text"), model).select(F.col("chunk_id").alias("id"), "vector")
    asked = "green pears"
    queries = spark.createDataFrame([(7, model.embed([asked])[0], asked.split())], "query_id long, vector array<double>, terms array<string>")
    found = search.hybrid(spark, vectors, texts, queries, candidates=3)
    assert found.orderBy("rank").first().key == 2
    rows = found.join(texts.withColumnRenamed("doc_id", "key"), "key").withColumns({"query": F.lit(asked), "file_name": F.lit("f.txt"), "page": F.lit(None).cast("int")})
    top = search.cross_encoded(rows, OverlapReranker(), top=2)
    assert [r.key for r in top.orderBy("rank").collect()][0] == 2 and top.count() == 2
    prompt = search.prompts(top, 1000)
    answer = search.answers(prompt, FirstPassage()).first()
    assert answer.answer == "f.txt" and answer.asks is False
    extra = spark.createDataFrame([(7, 3, "blue sea", 0.9)], "query_id long, id long, text string, score double")
    both = search.expanded(rows.select("query_id", F.col("key").alias("id"), "text", "score"), extra, F.lit(asked), F.lit(10))
    assert {r.id for r in both.collect()} == {1, 2, 3} and both.orderBy("rank").first().id == 2


def test_unknown_reranker_keeps_order():
    assert reranker("no such").scores("q", ["a", "b"]) == [0.0, -1.0]
