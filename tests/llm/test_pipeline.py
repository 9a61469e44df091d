from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F

from sagebrook.llm import decontaminate, mixing, pii, quality


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    before, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        after = after.checkpoint()
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        sizes.append(after.count())
        if name == "quality classifier":
            bad = quality.score(spark, before, labels).where("predicted = 0")
            assert bad.join(after, "doc_id").isEmpty() and sizes[-1] == before.count() - bad.count()
        if name == "benchmark decontamination":
            assert decontaminate.contained_items(spark, after, benchmark).isEmpty()
            assert sizes[-1] == before.count() - decontaminate.contained_items(spark, before, benchmark).select("doc_id").distinct().count()
        if name == "PII":
            assert sizes[-1] == before.count() and after.where("n_chars <> length(text)").isEmpty()
            assert pii.find(spark, after).where("n_email + n_ip + n_card + n_phone > 0").isEmpty()
        before = after
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    want = sorted(map(tuple, mixing.mix(spark, before).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before.collect()}
    assert {i: n for i, n, *_ in want} == words and all(t <= 3 * n for _, n, _, _, t in want)


def test_one_of_each_group_stays(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, "en", "s", 1), (1, text.upper(), "en", "s", 1), (1, text.upper(), "en", "s", 1), (2, "other", None, None, None), (None, None, None, None, None)]
    rows += [(None, text, "en", "s", 1), (7, "alone", "en", "s", 1), (7, "one thing and another that is said", "en", "s", 1), (8, "one thing and another that is said", "en", "s", 1)]
    rows += [(None, "nameless copies of one text", None, None, None)] * 3
    kept = corpus_pipeline.unique(spark, spark.createDataFrame(rows, schema), sf_dir)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        [("1", text.upper()), ("2", "other"), ("None", "None"), ("7", "alone"), ("7", "one thing and another that is said"), ("None", "nameless copies of one text")]
    )
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 100").first().text
    rows = [(1, f"some words and {passage}", "en", "s", 1), (1, "clean text of the same name", "en", "s", 1), (None, f"{passage} and more", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0)]
    clean = corpus_pipeline.uncontaminated(spark, spark.createDataFrame(rows, schema).withColumns({"row": F.lit("x"), "doc": F.lit(1)}), sf_dir)
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == [("1", "clean text of the same name"), ("2", ""), ("None", "None")] and clean.columns[-2:] == ["row", "doc"]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, sf_dir).collect() == []
    assert corpus_pipeline.good_quality(spark, empty.withColumn("extra", F.lit(1)), sf_dir).columns[-1] == "extra"
