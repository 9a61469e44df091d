"""Queries on forms of texts, derived questions and structural citations, and their SQL.

Where the given texts have no such parts, texts are made of a row's own columns: articles are
numbered by doc_id or turn, items and names are built from what the row has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import questions as Q
from .functions import text as T
from .operators import enrich, fusion
from .plans import ingest, search
from .registry import query, table

_FORM = "lower(trim(regexp_replace(regexp_replace(translate(nfc_normalize({}), 'iIoOaAeErR', 'ييووااههرر'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def _of(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"SELECT conv_id, turn, {_FORM.format("coalesce(text, '')")} AS form FROM conversations")
def match_form(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", T.match_form(F.col("text")).alias("form"))


@query("SELECT doc_id, ['1. ' || lang, '2. ' || source] AS items, 1::INT AS whole FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def numbered_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where("lang is not null and source is not null")
    whole = F.size(T.numbered_segments(_of("3. ", F.col("lang"))))
    return rows.select("doc_id", T.numbered_segments(_of("1. ", F.col("lang"), "\n2. ", F.col("source"))).alias("items"), whole.alias("whole"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '2. second number ' || (1000 + doc_id % 7000)::VARCHAR ELSE '1. first word alpha 2. second number ' || (1000 + doc_id % 7000)::VARCHAR END AS focus FROM documents")
def focused_text(spark: SparkSession, d: str) -> DataFrame:
    number = 1000 + F.col("doc_id") % 7000
    text = _of("1. first word alpha 2. second number ", number)
    asked = F.when(F.col("doc_id") % 2 == 0, _of("second number ", number)).otherwise("nothing like it")
    return _documents(spark, d).select("doc_id", T.focused(text, asked).alias("focus"))


@query("SELECT doc_id, doc_id % 4 < 2 AS goes_on FROM documents")
def needs_continuation(spark: SparkSession, d: str) -> DataFrame:
    ends = F.when(F.col("doc_id") % 4 == 0, "and step 3:").when(F.col("doc_id") % 4 == 1, " the second:").when(F.col("doc_id") % 4 == 2, "so they say:").otherwise("step 3")
    return _documents(spark, d).select("doc_id", T.needs_continuation(_of("x ", ends)).alias("goes_on"))


@query("""
SELECT doc_id, regexp_replace(left(coalesce(text, ''), 100), '^\\s+|\\s+$', '', 'g') AS cut_first, left(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), 100) AS stripped_first FROM documents""")
def cut_and_strip(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _documents(spark, d).select("doc_id", T.cut_then_strip(text, 100).alias("cut_first"), T.strip_then_cut(text, 100).alias("stripped_first"))


@query("""
SELECT doc_id, CASE WHEN lang = 'de' THEN 'Question: ' ELSE 'Question: ' END || coalesce(source, '') AS filled, lang || ' of ' || source || ' costs $price' AS own FROM documents""")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    own = search.filled(F.lit("$lang of $source costs $price"), lang=F.col("lang"), source=F.col("source"))
    return _documents(spark, d).select("doc_id", search.filled(search.template(F.col("lang"), 1), question=F.coalesce("source", F.lit(""))).alias("filled"), own.alias("own"))


@query("SELECT doc_id, list_filter([lang, source], lambda x: x IS NOT NULL) AS kept, ['lang=xx', 'n=' || doc_id::VARCHAR, 'source=' || coalesce(source, 'null')] AS merged FROM documents")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    own = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    more = F.create_map(F.lit("lang"), F.lit("xx"), F.lit("n"), F.col("doc_id").cast("string"))
    both = T.merged(own, more)
    listed = F.transform(F.array_sort(F.map_keys(both)), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(both, k), F.lit("null"))))
    return _documents(spark, d).select("doc_id", F.map_values(T.without_nulls(own)).alias("kept"), listed.alias("merged"))


@query("SELECT page_id, substr(sha256(page_id::VARCHAR || '/' || url), 1, 12) || '_' || regexp_replace(trim(url), '[^\\p{L}\\p{M}\\p{N}_.]', '', 'g') AS name, ['document', 'text', 'untagged'] AS tags FROM pages")
def upload_names(spark: SparkSession, d: str) -> DataFrame:
    name = T.unique_file_name(F.col("url"), F.col("page_id").cast("string"), F.col("url"))
    return table(spark, d, "pages").select("page_id", name.alias("name"), T.tags_or_fallback(F.lit(None).cast("string")).alias("tags"))


@query("""
WITH p AS (SELECT conv_id, string_agg(text, E'\\n' ORDER BY turn) AS sample FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, regexp_replace(left(coalesce(sample, ''), 5000), '^\\s+|\\s+$', '', 'g') AS t FROM p)
SELECT conv_id, CASE WHEN length(t) >= 10 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 3 THEN 'en' WHEN conv_id % 2 = 0 THEN 'ar' ELSE 'en' END AS language FROM a""")
def recognition_language(spark: SparkSession, d: str) -> DataFrame:
    pages = _turns(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages"))
    stated = F.when(F.col("conv_id") % 2 == 0, "ar").otherwise("fr")
    return pages.select("conv_id", T.recognised_language(F.col("pages"), stated, "en").alias("language"))


# Derived questions and citations.


@query("""
SELECT doc_id, ['rules of ' || source] AS sections, ['مادة ' || n, '( مادة' || n] AS articles, [n] AS numbers FROM (SELECT doc_id, source, (doc_id % 90 + 1)::VARCHAR AS n FROM documents WHERE source IS NOT NULL) a""")
def derived_questions(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("doc_id") % 90 + 1).cast("string")
    rows = _documents(spark, d).where("source is not null")
    asked = _of("what is article ", n)
    return rows.select("doc_id", Q.section_expansions(_of("What are the rules of ", F.col("source"), "?")).alias("sections"), Q.structural_expansions(asked).alias("articles"), Q.article_numbers(asked).alias("numbers"))


@query("""
SELECT doc_id, CASE WHEN source IS NULL THEN [] ELSE ['rules of ' || source] END AS every FROM documents""")
def all_expansions(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("source").isNotNull(), _of(" What are the rules of ", F.col("source"), "? ")).otherwise("hello")
    return _documents(spark, d).select("doc_id", Q.expansions(asked).alias("every"))


@query("""
SELECT doc_id, n = 3 AS cites, c = 2 AS cites_chapter, n <> 3 AS other, c <> 2 AS other_chapter, CASE WHEN n = 3 THEN ['3', '7'] WHEN n = 7 THEN ['7'] ELSE [n::VARCHAR, '7'] END AS cited
FROM (SELECT doc_id, doc_id % 9 AS n, doc_id % 5 AS c FROM documents) a""")
def structural_citations(spark: SparkSession, d: str) -> DataFrame:
    n, c = F.col("doc_id") % 9, F.col("doc_id") % 5
    text = _of("الفصل ", c, " مادة (", n, "): it says so, see مادة (7).")
    return _documents(spark, d).select(
        "doc_id", Q.cites_article(text, F.lit("3")).alias("cites"), Q.cites_chapter(text, F.lit("2")).alias("cites_chapter"), Q.starts_other_article(text, F.lit("3")).alias("other"),
        Q.starts_other_chapter(text, F.lit("2")).alias("other_chapter"), Q.cited_articles(text).alias("cited"),
    )


@query("""
WITH a AS (SELECT doc_id, doc_id % 10 = 9 AS plain, doc_id % 9 AS m, unnest(list_distinct([doc_id % 4, 2])) AS n FROM documents)
SELECT doc_id, round(sum(CASE WHEN plain THEN 0.0::DOUBLE WHEN m = n THEN 0.35 ELSE -0.2 END) + max(CASE WHEN NOT plain AND doc_id % 5 = 2 THEN 0.25::DOUBLE ELSE 0.0 END), 6) AS boost FROM a GROUP BY doc_id""")
def structural_boost(spark: SparkSession, d: str) -> DataFrame:
    """Every number in a question about articles is one that it asks for."""
    text = F.when(F.col("doc_id") % 10 == 9, "plain").otherwise(_of("chapter ", F.col("doc_id") % 5, ", مادة (", F.col("doc_id") % 9, ")"))
    asked = _of("article ", F.col("doc_id") % 4, " in chapter 2")
    return _documents(spark, d).select("doc_id", F.round(Q.structural_boost(text, asked), 6).alias("boost"))


@query("""
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY 1.0 / (turn % 4 + 1) DESC, turn) AS n FROM conversations)
SELECT conv_id, turn FROM c WHERE n <= 5""")
def top_seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), (1 / (F.col("turn") % 4 + 1)).alias("score"))
    return enrich.top_seeds(rows).select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"))


@query("""
WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT conv_id, min(turn) AS start FROM c WHERE turn % 6 = 1 GROUP BY conv_id)
SELECT conv_id AS asset_id, turn::INT AS chunk_order, round(0.98::DOUBLE - 0.005 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1), 6) AS score
FROM c JOIN s USING (conv_id) WHERE turn >= start AND turn < start + 5""")
def article_context(spark: SparkSession, d: str) -> DataFrame:
    """Turns 1, 7, ... head article 3, turns 6, 12, ... article 4; others go on with what is before."""
    head = F.when(F.col("turn") % 6 == 1, "مادة (3): ").when(F.col("turn") % 6 == 0, "مادة (4): ").otherwise("")
    chunks = _turns(spark, d).groupBy(F.col("conv_id").alias("asset_id"), F.col("turn").cast("int").alias("chunk_order")).agg(F.min(_of(head, "so it goes")).alias("text"))
    wanted = chunks.select(F.lit(1).alias("query_id"), "asset_id", F.lit("3").alias("number"), F.lit(12).alias("most")).distinct()
    return enrich.article_runs(wanted, chunks).select("asset_id", "chunk_order", F.round("score", 6).alias("score"))


@query("""
WITH asked AS (SELECT DISTINCT conv_id FROM conversations), best AS (SELECT conv_id, max(1.0::DOUBLE / (turn + 1)) AS s FROM conversations WHERE turn % 7 = 3 GROUP BY conv_id)
SELECT conv_id, round(coalesce(s, 0.0), 6) AS top_score FROM asked LEFT JOIN best USING (conv_id)""")
def top_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select(F.col("conv_id").alias("query_id"), "turn", (1 / (F.col("turn") + 1)).alias("score"))
    best = fusion.top_scores(rows.select("query_id").distinct(), rows.where("turn % 7 = 3"))
    return best.select(F.col("query_id").alias("conv_id"), F.round("top_score", 6).alias("top_score"))


@query("SELECT conv_id, count(*) AS n, sum(turn)::BIGINT AS turns FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0) u GROUP BY conv_id")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select("conv_id", "turn", "role")
    both = fusion.concatenated(rows.where("role = 'user'").drop("role"), rows.where("turn % 2 = 0").drop("role"))
    return both.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn % 3, turn) AS place FROM (SELECT DISTINCT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL) c WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) FROM (SELECT DISTINCT conv_id, turn FROM conversations) c WHERE conv_id % 2 = 1")
def document_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).groupBy(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank")).agg(F.min("role").alias("file_name"))
    rows = rows.withColumns({"page": F.col("rank") % 3, "chunk_order": F.col("rank").cast("string")})
    out = fusion.in_document_order(rows, F.col("query_id") % 2 == 0)
    return out.select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"), F.col("prompt_rank").alias("place"))


@query()
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = F.pandas_udf(lambda texts: texts.map(lambda t: ingest.line_chunks(t or "", 400)), "array<string>")
    return _documents(spark, d).select("doc_id", F.posexplode(cut("text")).alias("part", "text"))
