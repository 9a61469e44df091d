"""Every query with SQL gives the same rows as DuckDB; the others run and have rows."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from compare import by_spark, by_sql
from pyspark.sql import functions as F

from sagebrook.catalogue import ORACLE_SQL, QUERIES
from sagebrook.functions import patterns as P
from sagebrook.functions import text as T
from sagebrook.operators import sparse


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = by_spark(QUERIES[name](spark, sf_dir))
    if name in ORACLE_SQL:
        assert found == by_sql(ORACLE_SQL[name], sf_dir)
    else:
        assert found[1]


def test_index_recall(spark, sf_dir):
    exact = {(r.query_id, r.id) for r in QUERIES["knn_cosine_topk"](spark, sf_dir).collect()}
    found = {(r.query_id, r.id) for r in QUERIES["knn_index_topk"](spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_whole_texts_are_looked_for(spark, tmp_path):
    """Against brute force: all words of a query count, the last ones too."""
    rng = random.Random(9)
    texts = {i: " ".join(rng.choices(["the", "a1", "then", "sea", "see", "red", "dog"], k=rng.choice([3, 8, 20]))) for i in range(1, 50)}
    texts |= {50: "the the sea", 100: "the sea red do x", 150: "the zebra", 200: "", 51: "The, sea! red dog " * 3}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for q in (50, 100, 150, 200):
        terms = [w for w in dict.fromkeys(texts[q].split()) if len(w) > 1]
        for i, t in texts.items():
            places = [[p for p, w in enumerate(re.findall(r"\w+", t.lower())) if w.startswith(x)] for x in terms]
            if terms and all(places):
                want.add((q, i, round(sparse.covers(places), 6)))
    best = {q: sorted((x for x in want if x[0] == q), key=lambda x: (-x[2], x[1]))[:30] for q in (50, 100, 150)}
    found = QUERIES["fts_cover_rank"](spark, str(tmp_path)).collect()
    assert len({x[1] for x in best[100]}) > 3 and sorted((r.query_id, r["rank"], r.id, r.score) for r in found) == sorted((q, n, i, s) for q, of in best.items() for n, (_, i, s) in enumerate(of, 1))


def test_whole_texts_are_the_questions(spark, tmp_path):
    """What stands behind the first 200 characters counts in re-ranking and in prompts."""
    long = "filler " * 40
    texts = [(50, long + "zebra article 5 مادة"), (51, "zebra"), (52, "filler 5"), (53, "Article 5 of it")]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'f.txt' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i % 7)], 0) for i, _ in texts], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.id: r.lexical for r in QUERIES["rerank_rrf_lexical"](spark, str(tmp_path)).collect()}
    assert found == {i: pytest.approx(n / 5) for i, n in {51: 1, 52: 2, 53: 2, 50: 5}.items() if i in found} and {51, 52, 53} <= set(found)
    prompt = QUERIES["answer_prompts"](spark, str(tmp_path)).collect()
    assert len(prompt) == 1 and f"السؤال: {texts[0][1]}" in prompt[0].prompt


def plain_params(n, size=800, overlap=120):
    scale = next((f for most, f in ((600, 0.6), (1500, 0.75), (4000, 1.0), (12_000, 1.15)) if n <= most), 1.3)
    own = max(200, min(1000, round(size * scale)))
    if n <= 200 or own >= n:
        return n, 0
    return own, max(20, min(round(own * (0.15 if n <= 1500 else 0.18)), own // 3, int(overlap * scale)))


def test_chunks_match_plain_python(spark, sf_dir):
    """Cleaning, cutting and numbering of all documents, one after the other."""
    cleaned = {r.doc_id: r.text for r in QUERIES["clean_text"](spark, sf_dir).collect()}
    raw = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for i, text in raw.items():
        out = re.sub(r"^\s*\d{1,3}\s*$", "", re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", text)), flags=re.M)
        out = re.sub(r"(?<=[A-Za-z0-9])[\r\n]+(?=[A-Za-z0-9])", " ", out)
        out = re.sub(r"(?<=\s[A-Za-z]) (?=[A-Za-z]{1,3}(?:\s|$|[,.:;)]))", "", out)
        lines = (x.strip() for x in re.sub(r"[^\S\n]+", " ", re.sub(r"\n{3,}", "\n\n", out)).split("\n"))
        assert cleaned[i] == "\n".join(x for x in lines if x), i
    want = {}
    for i, text in cleaned.items():
        made = [c for p in T.structural_parts(text) for c in T.recursive_split(p, *plain_params(len(text)))] if text else []
        want |= {(i, n): c for n, c in enumerate(made, 1)}
    found = QUERIES["chunk_documents"](spark, sf_dir).collect()
    assert {(r.asset_id, r.chunk_order): r.chunk_text for r in found} == want and all(r.char_count == len(r.chunk_text) for r in found)
    parts = {(r.doc_id, r.part): r.text for r in QUERIES["structural_split"](spark, sf_dir).collect()}
    assert parts == {(i, n): p for i, t in raw.items() for n, p in enumerate(T.structural_parts(t))}
    lines = {(r.doc_id, r.part): r.text for r in QUERIES["line_chunks"](spark, sf_dir).collect()}
    whole = {}
    for (i, _), t in sorted(lines.items()):
        whole[i] = whole.get(i, "") + "".join(t.split())
    assert whole == {i: "".join("".join(x.split()) for x in t.split("\n") if len(x.strip()) > 1) for i, t in raw.items()}


def plain_form(text, compose=True):
    out = unicodedata.normalize("NFKC", text) if compose else text
    out = re.sub(P.DIACRITICS, "", out)
    for old, new in (P.DIGITS, P.CONFUSED, P.UNIFIED):
        out = out.translate(str.maketrans(old, new))
    return " ".join(re.sub(r"[^\w\s]", " ", out).split()).lower()


def test_reranking_matches_plain_python(spark, sf_dir):
    """Lexical recall and fused ranks of all nearest rows, computed one by one."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    near = [r for r in QUERIES["knn_cosine_topk"](spark, sf_dir).collect() if r.query_id in texts and r.id in texts]

    def recall(text, q):
        words = [w for w in re.sub(r"[^\w\s]", " ", q).split() if len(w) >= 3]
        terms = dict.fromkeys([*words, *re.findall(r"\b(\d{1,4})\b", q), *filter(None, (x.strip() for x in re.findall("[«\"']([^»\"']{4,})[»\"']", q)))])
        form = plain_form(text)
        held = sum(plain_form(t, False) in form or t.isdigit() and t in text for t in terms)
        return round(held / len(terms), 9) if terms and text else 0.0

    lexical = {(r.query_id, r.id): recall(texts[r.id], texts[r.query_id]) for r in near}
    found = QUERIES["rerank_rrf_lexical"](spark, sf_dir).collect()
    assert {(r.query_id, r.id): r.lexical for r in found} == pytest.approx(lexical)
    for q in {r.query_id for r in near}:
        of = sorted((r for r in near if r.query_id == q), key=lambda r: r["rank"])
        by_lexical = {r.id: n for n, r in enumerate(sorted(of, key=lambda r: (-lexical[q, r.id], r["rank"])), 1)}
        fused = {r.id: round(1 / (60 + n) + 1 / (20 + by_lexical[r.id]) + lexical[q, r.id] * 1e-4, 9) for n, r in enumerate(of, 1)}
        got = {r.id: r for r in found if r.query_id == q}
        assert {i: r.combined for i, r in got.items()} == pytest.approx(fused, abs=2e-9)
        order = [r.id for r in sorted(got.values(), key=lambda r: r.new_rank)]
        assert all(got[a].combined >= got[b].combined for a, b in zip(order[:-1], order[1:], strict=True))


def test_recall_of_terms_that_are_there(spark):
    pairs = [("An article on trees, 12", "trees grow 12"), ("", "x"), (None, "tree"), ("x", ""), ("Über 7 «long words»", "uber 7 «long words» 123"), ("a", None)]
    rows = spark.createDataFrame(pairs, "text string, q string")
    both = rows.select(T.recall_of(F.col("text"), T.recall_terms(F.col("q"))).alias("a"), T.lexical_recall(F.col("text"), F.col("q")).alias("b")).collect()
    assert all(r.a == r.b for r in both)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
