from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sagebrook.functions import questions as Q
from sagebrook.functions import text as T
from sagebrook.operators import catalog, enrich, fusion, sparse, state
from sagebrook.plans import ingest, search


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], column.alias("out")).first()["out"]


def of(spark, f, *values):
    return spark.range(1).select(f(*[F.lit(v) for v in values]).alias("out")).first()["out"]


def test_match_form(spark):
    assert of(spark, T.match_form, "ﷲ  Ab-c ١٢۳ ة") == of(spark, T.match_form, "الله اb c 123 ه")
    assert of(spark, T.match_form, "مَكْتَبـَة") == "مكتبه"
    assert of(spark, T.match_form, None) == ""


def test_query_terms(spark):
    assert set(of(spark, T.query_terms, 'The the art of 12 "two words" 12345')) == {"The", "the", "art", "12345", "12", "two", "words", "two words"}
    assert of(spark, T.query_terms, None) == []


def test_lexical_recall(spark):
    assert of(spark, T.lexical_recall, "An article on trees", "trees grow 12") == pytest.approx(1 / 3)
    assert of(spark, T.lexical_recall, "", "trees") == 0 and of(spark, T.lexical_recall, "x", "") == 0


def test_clean_extracted(spark):
    assert of(spark, T.clean_extracted, "Line one\r\nline two.\n 12 \n\n\n\nÉnd   here") == "Line one line two.\nÉnd here"
    assert of(spark, T.clean_extracted, "in a wor d, yes") == "in awor d, yes" and of(spark, T.clean_extracted, " x yz. w") == "xyz. w"
    assert of(spark, T.clean_extracted, None) == ""


def test_numbered_segments_and_focus(spark):
    text = "1. apples are red 2. pears are green 3. plums"
    assert of(spark, T.numbered_segments, text) == ["1. apples are red", "2. pears are green", "3. plums"]
    assert of(spark, T.numbered_segments, "1. only one") == ["1. only one"] and of(spark, T.numbered_segments, " ") == []
    assert of(spark, T.focused, text, "green pears") == "2. pears are green"
    assert of(spark, T.focused, text, "yellow bananas everywhere") == text


@pytest.mark.parametrize("n,want", [(0, (800, 120)), (200, (200, 0)), (201, (201, 0)), (600, (480, 72)), (601, (600, 90)), (1501, (800, 120)), (4001, (920, 138)), (12001, (1000, 156))])
def test_chunk_params(spark, n, want):
    size, over = T.chunk_params(F.lit(n), 800, 120)
    assert tuple(spark.range(1).select(size, over).first()) == want


def test_halves_round_to_even(spark):
    assert spark.range(1).select(T.chunk_params(F.lit(3000), 250, 1000)[1]).first()[0] == 45
    assert spark.range(1).select(T.chunk_params(F.lit(1000), 300, 1000)[0]).first()[0] == 225


def test_continuation_header(spark):
    for text, want in [("First:", True), ("step 2:", True), ("see 1. title:", True), ("note:", False), ("أولا:", True), ("first", False), (None, False)]:
        assert of(spark, T.needs_continuation, text) is want


def test_labels_and_names(spark):
    assert of(spark, T.source_label, "a/b/abc_report.pdf", "3", "en") == "report.pdf — page 3"
    assert of(spark, T.source_label, None, None, "ar") == "مصدر غير معروف"
    assert of(spark, T.source_label, "x", "0", "en") == "x" and of(spark, T.source_label, "x", "p", "en") == "x"
    assert of(spark, T.human_file_name, "averyveryverylongprefix_x") == "averyveryverylongprefix_x"


def test_answers(spark):
    for raw, want in [("clarification_needed: - Which?", ("Which?", True)), ("CLARIFICATION_NEEDED", ("CLARIFICATION_NEEDED", True)), ("  ", (None, False)), (None, (None, False)), (" ok ", ("ok", False))]:
        assert tuple(spark.range(1).select(*T.parsed_answer(F.lit(raw))).first()) == want


@pytest.mark.parametrize(
    "q,want",
    [("", "unknown"), ("What is in article 5?", "structural"), ("difference between tea and coffee", "comparison"), ("list all conditions", "detail"), ("list conditions", "exhaustive_list"),
     ("what are the steps", "detail"), ("Who is she", "factual"), ("ما الفرق بين القط و الكلب", "comparison"), ("مادة 12", "structural"), ("اذكر شروط", "exhaustive_list")],
)
def test_query_type(spark, q, want):
    assert of(spark, Q.query_type, q) == ("exhaustive_list" if q == "list all conditions" else want)


def test_targets_and_expansions(spark):
    assert of(spark, Q.article_numbers, "article 5 and article 7, or 12") == ["5", "7", "12"]
    assert of(spark, Q.chapter_labels, "chapter 3 of section 4") == ["3", "4"]
    assert of(spark, Q.comparison_expansions, "difference between tea and coffee?") == ["tea", "coffee"]
    assert of(spark, Q.section_expansions, "what are the steps?") == ["steps"]
    assert of(spark, Q.structural_expansions, "article 5") == ["مادة 5", "( مادة5"]
    assert of(spark, Q.expansions, "Who is she") == []


def test_citations(spark):
    assert of(spark, Q.cites_article, "( مادة 5 ) ...", "5") and not of(spark, Q.cites_article, "مادة 55", "5")
    assert of(spark, Q.cites_chapter, "see Chapter 3.", "3") and of(spark, Q.starts_other_article, "مادة 6 ...", "5")
    assert of(spark, Q.structural_boost, "مادة 5", "article 5") == pytest.approx(0.35)
    assert of(spark, Q.structural_boost, "مادة 6", "article 5") == pytest.approx(-0.2)


def test_structural_parts():
    text = "Opening words that are long enough to stand alone, well beyond eighty characters in all. Chapter 1 begins here and goes on. Article 2 follows."
    assert [p[:9] for p in T.structural_parts(text)] == ["Opening w", "Chapter 1", "Article 2"]
    assert T.structural_parts("short") == ["short"] and T.structural_parts(None) == []


def test_recursive_split():
    text = "\n\n".join("Sentence number one. Another one follows it here" + " word" * 30 for _ in range(5)) + "x" * 500
    chunks = T.recursive_split(text, 120, 30)
    assert all(0 < len(c) <= 120 for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))
    assert len("".join("".join(T.recursive_split(text, 120, 0)).split())) == len("".join(text.split()))
    assert T.recursive_split("", 10, 0) == []


def test_line_chunks():
    assert ingest.line_chunks("ab\nc\ncdef\n", 4) == ["ab\ncdef", ""] and ingest.line_chunks("", 4) == [""]


def test_covers():
    assert sparse.covers([[1, 5, 9]]) == pytest.approx(0.3)
    assert sparse.covers([[1], [2]]) == pytest.approx(0.1)
    assert sparse.covers([[1, 10], [4, 11]]) == pytest.approx(0.1 / 3 + 0.1 / 6 + 0.1)
    assert sparse.covers([[1], []]) == 0


def test_greedy_dedup_chain(spark):
    rows = spark.createDataFrame([(1, "A", 3.0, "k1", "p1"), (1, "B", 2.0, "k1", "p2"), (1, "C", 1.0, "k2", "p2"), (1, "D", 0.5, None, ""), (1, "E", 0.4, None, "")], "query_id long, id string, score double, k string, p string")
    kept = fusion.greedy_dedup(rows, ["k", "p"], order=[-F.col("score"), F.col("id")])
    assert [r.id for r in kept.orderBy("kept_rank").collect()] == ["A", "C", "D", "E"]
    assert fusion.greedy_dedup(rows, ["k", "p"], order=[-F.col("score"), F.col("id")], limit=2).count() == 2


def test_rrf(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3), (1, "", 4)], "query_id long, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, key string, rank int")
    out = [(r.key, r.score) for r in fusion.reciprocal_rank_fusion(a, b).orderBy("rank").collect()]
    assert out == [("y", round(1 / 62 + 1 / 61, 9)), ("z", round(1 / 62, 9)), ("x", round(1 / 63, 9))]


def test_source_keys(spark):
    for values, want in [(("f", 1, 2), "f|1|2"), (("f", 1, None), "f|1"), (("f", None, 2), "f"), ((None, 1, 2), None)]:
        cols = [F.lit(values[0]).cast("string"), F.lit(values[1]).cast("int"), F.lit(values[2]).cast("int")]
        assert spark.range(1).select(fusion.source_key(*cols)).first()[0] == want
    assert spark.range(1).select(fusion.source_key(F.lit("f"), F.lit(None).cast("int"), F.lit(2), "chunk")).first()[0] == "f|2"


def test_article_runs(spark):
    texts = ["intro", "see مادة 5", "مادة 5 : start", "middle", "مادة 6 : other", "end"]
    chunks = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "asset_id long, chunk_order int, text string")
    wanted = spark.createDataFrame([(1, 1, "5", 12)], "query_id long, asset_id long, number string, most int")
    # the chunk that cites it in passing also cites it first, so the run begins there
    assert [r.chunk_order for r in enrich.article_runs(wanted, chunks).orderBy("chunk_order").collect()] == [2, 3, 4]


def test_runs_stop_at_gaps(spark):
    chunks = spark.createDataFrame([(1, i, "t") for i in (1, 2, 4)], "asset_id long, chunk_order int, text string")
    seeds = spark.createDataFrame([(1, 1, 1)], "query_id long, asset_id long, chunk_order int")
    assert [r.chunk_order for r in enrich.runs(seeds, chunks, F.lit(False)).collect()] == [1, 2]


def test_should_execute(spark):
    rows = [(None, None, True), ("SUCCESS", 0, False), ("FAILURE", 0, True), ("STARTED", 10, False), ("STARTED", 120, False), ("STARTED", 121, True), ("RETRY", None, False)]
    df = spark.createDataFrame([(s, w) for s, w, _ in rows], "s string, w int")
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    out = df.select(state.should_execute(F.col("s"), now - F.make_dt_interval(secs=F.col("w")), now)).collect()
    assert [r[0] for r in out] == [x for _, _, x in rows]


def test_stuck_to_the_part_of_a_second(spark):
    rows = [("00:00:00.100000", "00:02:00.100000"), ("00:00:00.100000", "00:02:00.100001"), ("00:00:00.900000", "00:02:01.100000"), ("00:00:00.900000", "00:02:00.950000")]
    df = spark.createDataFrame([(f"2024-01-01 {a}", f"2024-01-01 {b}") for a, b in rows], "a string, b string")
    out = df.select(state.should_execute(F.lit("STARTED"), F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("run")).collect()
    assert [r.run for r in out] == [False, True, True, True]


def test_args_hash_is_ascii_json(spark):
    import hashlib
    import json

    args = {"name": 'é "x" \U0001f600', "id": 5}
    want = hashlib.sha256(json.dumps({**args, "task_name": "t"}, sort_keys=True).encode()).hexdigest()
    assert of(spark, lambda n: state.args_hash(F.lit("t"), {"name": state.json_text(n), "id": F.lit(5)}), args["name"]) == want


def test_contains(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2}',), ("{}",), (None,)], "j string")
    assert [df.where(catalog.contains(F.col("j"), w)).count() for w in ({}, {"a": 1}, {"b": {"c": "x"}}, {"a": "1", "b": {"c": "y"}})] == [4, 1, 1, 0]


def test_names():
    assert catalog.valid_name("a_1") == "a_1" and catalog.collection_name(64, 3) == "collection_64_3"
    for bad in ("1a", "a-b", "", "a;b", None):
        with pytest.raises(ValueError):
            catalog.valid_name(bad)


def test_budget_keeps_first(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 5), (2, 1, 5), (2, 2, 5), (2, 3, 1)], "query_id long, rank int, n int")
    assert sorted((r.query_id, r.rank) for r in fusion.within_budget(rows, F.col("n"), 10).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_filled(spark):
    assert spark.range(1).select(search.filled(F.lit("a $x b $x"), x=F.lit("1"))).first()[0] == "a 1 b 1"


def test_runs_of_several_chapters_in_a_file(spark):
    texts = {1: "opening", 2: "الفصل الأول\nbegins", 3: "goes on", 4: "الفصل الثاني\nbegins", 5: "goes on"}
    chunks = spark.createDataFrame([(7, n, t, 1) for n, t in texts.items()] + [(8, 1, "other file", 1)], "asset_id long, chunk_order int, text string, page int")
    seeds = [(1, 7, 1, "الأول", 0.5), (1, 7, 4, "الثاني", 0.97), (1, 7, 4, "الثاني", 0.5), (2, 7, 1, "الثاني", 0.5)]
    found = enrich.chapter_runs(spark.createDataFrame(seeds, "query_id long, asset_id long, chunk_order int, chapter string, score double"), chunks)
    rows = sorted((r.query_id, r.chapter, r.chunk_order, round(r.score, 2)) for r in found.collect())
    assert rows == [(1, "الأول", 1, 0.95), (1, "الأول", 2, 0.94), (1, "الأول", 3, 0.93), (1, "الثاني", 4, 0.97), (1, "الثاني", 5, 0.97), (2, "الثاني", 1, 0.95)]
    context = enrich.structural_context(
        spark.createDataFrame([(1, "قارن الفصل الأول و الفصل الثاني", 7, n, None, texts[n], 0.5, r) for r, n in enumerate((2, 4), 1)], "query_id long, query string, asset_id long, chunk_order int, page int, text string, score double, rank int"),
        chunks.withColumn("page", F.lit(None).cast("int")),
    )
    assert sorted((r.chunk_order, round(r.score, 2)) for r in context.collect()) == [(3, 0.94), (5, 0.94)]
