"""The registered queries and their SQL for DuckDB.

The given tables stand in for the engine's own: ``documents`` for assets and for chunks (doc_id as
asset, source as project), ``embeddings`` for a collection, ``conversations`` for chats and for
assets of ordered chunks (conv_id as asset, turn as order), ``events`` for the task ledger and for
request metrics. As queries, searches take every row whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import questions as Q
from .functions import text as T
from .operators import catalog, dense, enrich, fusion, sparse, state
from .operators.common import kept, small
from .operators.graph_index import indexed_nearest
from .operators.text_index import TextIndex
from .plans import ingest, search
from .registry import EVERY, ORACLE_SQL, QUERIES, query, table
from .session import Settings, own_folder
from .streaming import gate, incremental, retention

__all__ = ["ORACLE_SQL", "QUERIES"]

S = Settings()
NOW = "2024-06-01 00:00:00"


# Dense search.


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))
    return rows, rows.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id")


def _knn_sql(score: str, where: str = "true", limit: int = 30) -> str:
    return f"""
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS id, round({score}, 6) AS score
    FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0 AND {where}) s) r
WHERE rank <= {limit}"""


_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@query(_knn_sql(_COSINE))
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _vectors(spark, d)
    return dense.nearest(spark, corpus, queries, S.candidates)


@query(_knn_sql("list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"))
def knn_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _vectors(spark, d)
    return dense.nearest(spark, corpus, queries, S.candidates, metric="dot")


@query(_knn_sql(_COSINE, "q.label = c.label"))
def knn_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _vectors(spark, d)
    return dense.nearest(spark, corpus, queries, S.candidates, by_group=True)


@query()
def knn_index_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _vectors(spark, d)
    return dense.InvertedFile(corpus).nearest(spark, corpus, queries, S.candidates, probes=24)


@query()
def knn_graph_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _vectors(spark, d)
    return indexed_nearest(spark, corpus, queries, S.candidates, own_folder(spark, "graph"), threshold=S.index_threshold, beam=40)


# Full text. The words of a document whose id is divisible by 50 are looked for in all documents: all
# of its words, but for fts_single_term_rank, which is about the first one.

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _index(spark: SparkSession, d: str) -> TextIndex:
    return TextIndex.of(spark, _documents(spark, d), f"{d}/documents.parquet")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where(F.col("doc_id") % EVERY == 0)
    # Checkpointed: a plan that asks for the terms twice would split the text of every document.
    return kept(rows.select(F.col("doc_id").alias("query_id"), sparse.query_tokens(F.col("text")).alias("terms"))).where("size(terms) > 0")


def _fts_sql(select: str, where: str = "true", terms: str = "w") -> str:
    return f"""
WITH RECURSIVE asked AS (
  SELECT doc_id AS query_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: length(w) >= 2) AS w
  FROM documents WHERE doc_id % {EVERY} = 0
), terms AS (
  SELECT query_id, len(list_distinct({terms})) AS n, unnest(list_distinct({terms})) AS term FROM asked
), words AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE {where}) t
), begun AS MATERIALIZED (
  SELECT term, token FROM (SELECT DISTINCT term FROM terms) t JOIN (SELECT DISTINCT token FROM words) v ON left(token, 2) = left(term, 2) AND starts_with(token, term)
), each AS (
  SELECT query_id, doc_id, n, term, list(pos ORDER BY pos) AS p FROM terms JOIN begun USING (term) JOIN words USING (token) GROUP BY ALL
), hit AS MATERIALIZED (
  SELECT query_id, doc_id, sum(len(p))::BIGINT AS hits, list(p) AS places FROM each GROUP BY query_id, doc_id, n HAVING count(*) = n
), step AS (
  SELECT query_id, doc_id, places, 0::BIGINT AS start, 0.0::DOUBLE AS total FROM hit WHERE len(places) > 1
  UNION ALL
  SELECT query_id, doc_id, places, first, total + 0.1::DOUBLE / greatest(1, 1 + (last - first) - (len(places) - 1)) FROM (
    SELECT *, list_min(list_transform(places, lambda p: list_max(list_filter(p, lambda x: x <= last)))) AS first FROM (
      SELECT *, list_max(list_transform(places, lambda p: list_min(list_filter(p, lambda x: x > start)))) AS last FROM step
      WHERE list_min(list_transform(places, lambda p: p[-1])) > start) a) b
), scored AS MATERIALIZED (
  SELECT query_id, doc_id AS id, round(0.1::DOUBLE * hits, 6) AS score FROM hit WHERE len(places) = 1
  UNION ALL SELECT query_id, doc_id, round(max(total), 6) FROM step GROUP BY query_id, doc_id
)
{select}"""


@query(_fts_sql("SELECT query_id, doc_id, hits FROM hit"))
def fts_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).matches(_asked(spark, d))


_RANKED = "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) r WHERE rank <= 30"


@query(_fts_sql(_RANKED, terms="w[1:1]"))
def fts_single_term_rank(spark: SparkSession, d: str) -> DataFrame:
    first = _asked(spark, d).withColumn("terms", F.slice("terms", 1, 1))
    return _index(spark, d).search_one_term(first, S.candidates)


@query(_fts_sql(_RANKED, "lang = 'en'"))
def fts_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_asked(spark, d), S.candidates, among=_documents(spark, d).where(F.col("lang") == "en"))


@query(_fts_sql(_RANKED))
def fts_cover_rank(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_asked(spark, d), S.candidates)


# A short question: the first two words of a document, answered from postings.


@query(_fts_sql(_RANKED, terms="list_filter(w, lambda x, i: list_position(w, x) = i)[1:2]"))
def fts_short_questions(spark: SparkSession, d: str) -> DataFrame:
    first = _asked(spark, d).withColumn("terms", F.slice("terms", 1, 2))
    return _index(spark, d).search(first, S.candidates)


# Fusion and re-ranking.

_DENSE_KEYS = _knn_sql(_COSINE)


@query(f"""
WITH dense AS ({_DENSE_KEYS}), sparse AS ({_fts_sql(_RANKED)}),
shared AS (SELECT query_id FROM dense INTERSECT SELECT query_id FROM sparse),
fused AS (SELECT query_id, id AS key, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score
  FROM (SELECT * FROM dense WHERE query_id IN (FROM shared)) d FULL JOIN (SELECT * FROM sparse WHERE query_id IN (FROM shared)) s USING (query_id, id))
SELECT query_id, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM fused) r WHERE rank <= 30""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _vectors(spark, d)
    near = dense.nearest(spark, corpus, queries, S.candidates).withColumnRenamed("id", "key").checkpoint()
    worded = _index(spark, d).search(_asked(spark, d), S.candidates).withColumnRenamed("id", "key").checkpoint()
    both = near.select("query_id").distinct().join(worded.select("query_id").distinct(), "query_id")
    near, worded = (x.join(both, "query_id", "left_semi") for x in (near, worded))
    return fusion.reciprocal_rank_fusion(near, worded, k=S.rrf_k, limit=S.candidates)


_PREFIX = "left(trim(coalesce(text, ''), E' \\t\\n\\r\\x0b\\x0c'), 240)"


@query(_fts_sql(f"""
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS kept_rank FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id, CASE WHEN {_PREFIX} = '' THEN id::VARCHAR ELSE 'p' || {_PREFIX} END ORDER BY score DESC, id) AS n
  FROM scored h JOIN documents d ON d.doc_id = h.id) s WHERE n = 1
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30"""))
def hybrid_rrf_single_sided(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    keys = docs.select(F.col("doc_id").alias("id"), fusion.text_key(F.col("text")).alias("prefix"))
    # Equal keys go by digest here; of a query's rows of one key only the first can be kept.
    digest = F.when(F.col("prefix") != "", F.sha2("prefix", 256)).otherwise(F.concat(F.lit("id "), F.col("id").cast("string")))
    worded = _index(spark, d).scored(_asked(spark, d)).join(keys.select("id", digest.alias("key")), "id")
    first = worded.groupBy("query_id", "key").agg(F.min(F.struct((-F.col("score")).alias("last"), "id")).alias("x")).select("query_id", F.col("x.id").alias("id"), (-F.col("x.last")).alias("score"))
    best = dense.top_rows(first, "query_id", S.candidates, F.desc("score"), F.asc("id")).drop("rank")
    kept = fusion.greedy_dedup(best.join(keys, "id"), ["id", "prefix"], order=[-F.col("score"), F.col("id")], limit=S.candidates)
    return kept.select("query_id", "id", "score", "kept_rank")


@query(f"""
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS kept_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, CASE WHEN {_PREFIX} = '' THEN doc_id::VARCHAR ELSE 'p' || {_PREFIX} END ORDER BY n_chars DESC, doc_id) AS n FROM documents) s
WHERE n = 1""")
def dedup_retrieved(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("lang", "doc_id", "n_chars", fusion.text_key(F.col("text")).alias("prefix"))
    kept = fusion.greedy_dedup(rows, ["doc_id", "prefix"], by="lang", order=[-F.col("n_chars"), F.col("doc_id")])
    return kept.select("lang", "doc_id", "kept_rank")


@query("""
SELECT doc_id, CASE WHEN source IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN source ELSE source || '|' || (doc_id % 7)::VARCHAR ||
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '|' || (doc_id % 11)::VARCHAR END END AS source_key FROM documents""")
def source_key(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7)
    order = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 11)
    return _documents(spark, d).select("doc_id", fusion.source_key(F.col("source"), page, order).alias("source_key"))


# The forms of texts and questions. A question is a user's turn, its text the reply to it.

_ASKS = "SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations WHERE role = 'user'"
_FORM = "lower(trim(regexp_replace(regexp_replace(translate({}, 'iIoOaAeErR', 'ييووااههرر'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def _asks(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"))


@query(f"""
WITH pairs AS (SELECT a.conv_id, a.turn, q, r.text AS reply FROM ({_ASKS}) a JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1),
terms AS (SELECT *, list_distinct(list_concat(
    list_filter(regexp_split_to_array(regexp_replace(q, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3),
    regexp_extract_all(q, '\\b(\\d{{1,4}})\\b', 1),
    list_filter(list_transform(regexp_extract_all(q, '[«"'']([^»"'']{{4,}})[»"'']', 1), lambda p: trim(p)), lambda p: p <> ''))) AS t FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(t) = 0 OR coalesce(reply, '') = '' THEN 0.0::DOUBLE ELSE len(list_filter(t, lambda x:
  contains({_FORM.format("coalesce(reply, '')")}, {_FORM.format("x")}) OR (regexp_full_match(x, '\\d+') AND contains(reply, x))))::DOUBLE / len(t) END, 6) AS recall FROM terms""")
def lexical_recall(spark: SparkSession, d: str) -> DataFrame:
    replies = _turns(spark, d).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = _asks(spark, d).join(replies, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(T.lexical_recall(F.col("reply"), F.col("q")), 6).alias("recall"))


@query()
def rerank_rrf_lexical(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _vectors(spark, d)
    near = dense.nearest(spark, corpus, queries, S.candidates)
    docs = _documents(spark, d).select("doc_id", "text")
    asked = docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("q"), T.recall_terms(F.col("text")).alias("terms")).checkpoint()
    rows = near.join(docs.withColumnRenamed("doc_id", "id"), "id").join(asked, "query_id")
    ranked = fusion.rerank(rows, T.recall_of(F.col("text"), F.col("terms")), Q.structural_boost(F.col("text"), F.col("q")))
    return ranked.select("query_id", "id", "lexical", "combined", "new_rank")


def _kind_sql(q: str) -> dict[str, str]:
    article = f"(regexp_matches({q}, '(?i){P.ARTICLE_ASKED}') OR regexp_matches({q}, '(?i){P.ARTICLE_ASKED_EN}') OR ((contains({q}, 'مادة') OR contains(lower({q}), 'article')) AND regexp_matches({q}, '\\b\\d{{1,3}}\\b')))"
    return {
        "structural": f"({article} OR regexp_matches({q}, '(?i){P.CHAPTER_ASKED}'))",
        "comparison": P.any_of_sql(q, P.COMPARISON),
        "exhaustive": P.any_of_sql(q, P.EXHAUSTIVE),
        "detail": P.any_of_sql(q, P.DETAIL),
        "narrow": P.any_of_sql(q, P.NARROW),
        "specific": P.any_of_sql(q, P.SPECIFIC),
        "follow_up": P.any_of_sql(q, P.FOLLOW_UP),
    }


_STRIPPED = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
_K = _kind_sql("t")
_ALL_TURNS = f"(SELECT conv_id, turn, {_STRIPPED} AS t FROM conversations) c"


@query(f"""SELECT conv_id, turn, CASE WHEN t = '' THEN 'unknown' WHEN {_K["structural"]} THEN 'structural' WHEN {_K["comparison"]} THEN 'comparison'
  WHEN {_K["exhaustive"]} THEN 'exhaustive_list' WHEN {_K["detail"]} THEN 'detail' ELSE 'factual' END AS query_type FROM {_ALL_TURNS}""")
def query_type(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", Q.query_type(F.col("text")).alias("query_type"))


@query(f"""SELECT conv_id, turn, {_K["follow_up"]} AS follow_up, {_K["specific"]} AS specific, {_K["narrow"]} AS narrow,
  ({_K["detail"]} AND NOT {_K["comparison"]} AND NOT {_K["narrow"]} AND NOT {_K["structural"]}) AS focus FROM {_ALL_TURNS}""")
def history_intent(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("text")
    return _turns(spark, d).select("conv_id", "turn", Q.is_follow_up(q).alias("follow_up"), Q.is_specific(q).alias("specific"), Q.is_narrow(q).alias("narrow"), Q.wants_focus(q).alias("focus"))


@query(f"""SELECT conv_id, turn, greatest(10, CASE WHEN {_K["exhaustive"]} THEN 30 WHEN {_K["structural"]} THEN 24 WHEN {_K["detail"]} THEN 20 ELSE 10 END)::INT AS max_rows,
  (CASE WHEN {_K["exhaustive"]} THEN 18 ELSE 12 END)::INT AS article_chunks FROM {_ALL_TURNS}""")
def adaptive_limit(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("text")
    return _turns(spark, d).select("conv_id", "turn", Q.retrieval_limit(q, 10).alias("max_rows"), Q.article_context_limit(q).alias("article_chunks"))


@query(f"""SELECT conv_id, turn, greatest(12, 90 // (CASE WHEN {_K["detail"]} OR {_K["comparison"]} OR {_K["structural"]} THEN 5 ELSE 3 END))::INT AS fetch FROM {_ALL_TURNS}""")
def expansion_fetch_limit(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", Q.expansion_limit(F.col("text"), 90, 3).alias("fetch"))


@query("""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: length(x) >= 4 AND x NOT IN ('with', 'and')) AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN w[1] = w[2] THEN w[1] ELSE w[1] || ' / ' || w[2] END AS sides FROM w WHERE len(w) >= 2""")
def comparison_expansion(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda x: (F.length(x) >= 4) & ~x.isin("with", "and"))
    rows = _turns(spark, d).withColumn("w", words).where("size(w) >= 2")
    asked = F.concat(F.lit("What is the difference between "), F.get("w", 0), F.lit(" and "), F.get("w", 1), F.lit("?"))
    return rows.select("conv_id", "turn", F.array_join(Q.comparison_expansions(asked), " / ").alias("sides"))


# Neighbours of found chunks. Turns whose number is divisible by 3 are found.


def _chat_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select(F.col("conv_id").alias("asset_id"), F.col("turn").cast("int").alias("chunk_order"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("page", F.floor(F.col("chunk_order") / 4).cast("int"))


def _found_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_order % 3 = 0").select(F.lit(1).alias("query_id"), "asset_id", "chunk_order", "page", "text", (1 / (F.col("chunk_order") + 1)).alias("score"))


@query("""
WITH f AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 = 0)
SELECT DISTINCT f.conv_id AS asset_id, (f.turn + 1)::INT AS chunk_order, round(greatest(1.0::DOUBLE / (f.turn + 1), 0.95::DOUBLE), 6) AS score
FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.turn + 1 WHERE (f.turn + 1) % 3 <> 0""")
def continuation_chunk(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chat_chunks(spark, d)
    rows = enrich.continuations(_found_chunks(chunks), chunks.dropDuplicates(["asset_id", "chunk_order"]), F.lit(True))
    return rows.select("asset_id", "chunk_order", F.round("score", 6).alias("score"))


@query("""
WITH c AS (SELECT DISTINCT conv_id, turn, turn // 4 AS page FROM conversations),
f AS (SELECT conv_id, page, max(1.0::DOUBLE / (turn + 1)) AS score FROM c WHERE turn % 3 = 0 GROUP BY ALL)
SELECT c.conv_id AS asset_id, c.page::INT AS page, c.turn::INT AS chunk_order, round(greatest(f.score, 0.96::DOUBLE), 6) AS score FROM c JOIN f USING (conv_id, page) WHERE c.turn % 3 <> 0""")
def page_siblings(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chat_chunks(spark, d).dropDuplicates(["asset_id", "chunk_order"])
    rows = enrich.page_siblings(_found_chunks(chunks), chunks)
    return rows.select("asset_id", "page", "chunk_order", F.round("score", 6).alias("score"))


@query("""
WITH c AS (SELECT DISTINCT conv_id, turn, any_value(role) AS role FROM conversations GROUP BY ALL),
s AS (SELECT conv_id, turn AS start FROM c WHERE turn % 3 = 0),
r AS (SELECT s.conv_id, start, turn, turn - start AS off, row_number() OVER w AS n,
    max((role = 'system' AND turn > start)::INT) OVER w AS stopped
  FROM s JOIN c ON c.conv_id = s.conv_id AND turn BETWEEN start AND start + 11
  WINDOW w AS (PARTITION BY s.conv_id, start ORDER BY turn))
SELECT conv_id AS asset_id, start::INT AS start, turn::INT AS chunk_order, off::INT AS "offset" FROM r WHERE off = n - 1 AND stopped = 0""")
def chapter_run(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).groupBy(F.col("conv_id").alias("asset_id"), F.col("turn").cast("int").alias("chunk_order")).agg(F.min("role").alias("text"))
    seeds = rows.where("chunk_order % 3 = 0").select(F.lit(1).alias("query_id"), "asset_id", "chunk_order")
    return enrich.runs(seeds, rows, F.col("text") == "system").select("asset_id", "start", "chunk_order", "offset")


# Every second turn begins a chapter, the first and the second in turns; a file's seeds are of both.

_CHAPTERS = ("الأول", "الثاني")


@query(f"""
WITH c AS (SELECT conv_id, turn FROM conversations WHERE turn IS NOT NULL GROUP BY ALL),
s AS (SELECT conv_id, turn AS start, unnest(['{_CHAPTERS[0]}', '{_CHAPTERS[1]}']) AS chapter FROM c WHERE turn % 3 = 0),
r AS (SELECT s.conv_id, start, chapter, turn, turn - start AS off, row_number() OVER w AS n,
    max((turn > start AND (turn % 4 = 1 AND chapter <> '{_CHAPTERS[0]}' OR turn % 4 = 3 AND chapter <> '{_CHAPTERS[1]}'))::INT) OVER w AS stopped
  FROM s JOIN c ON c.conv_id = s.conv_id AND turn BETWEEN start AND start + 11
  WINDOW w AS (PARTITION BY s.conv_id, start, chapter ORDER BY turn))
SELECT conv_id AS asset_id, chapter, start::INT AS start, turn::INT AS chunk_order, round(greatest(1.0::DOUBLE / (start + 1), 0.95::DOUBLE - 0.01::DOUBLE * off), 6) AS score
FROM r WHERE off = n - 1 AND stopped = 0""")
def chapter_runs(spark: SparkSession, d: str) -> DataFrame:
    order = F.col("turn").cast("int")
    header = F.when(order % 4 == 1, f"الفصل {_CHAPTERS[0]}\n").when(order % 4 == 3, f"الفصل {_CHAPTERS[1]}\n").otherwise("")
    rows = _turns(spark, d).where("turn is not null").groupBy(F.col("conv_id").alias("asset_id"), order.alias("chunk_order"), header.alias("header")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select("asset_id", "chunk_order", F.concat("header", "text").alias("text"))
    labels = F.array(*[F.lit(c) for c in _CHAPTERS])
    seeds = rows.where("chunk_order % 3 = 0").select(F.lit(1).alias("query_id"), "asset_id", "chunk_order", F.explode(labels).alias("chapter"), (1 / (F.col("chunk_order") + 1)).alias("score"))
    return enrich.chapter_runs(seeds, rows).select("asset_id", "chapter", "start", "chunk_order", F.round("score", 6).alias("score"))


# Chunking and cleaning.


@query("""
WITH a AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) <= 600 THEN 0.6 WHEN length(text) <= 1500 THEN 0.75 WHEN length(text) <= 4000 THEN 1.0 WHEN length(text) <= 12000 THEN 1.15 ELSE 1.3 END AS s FROM documents),
b AS (SELECT *, greatest(200, least(1000, round_even(800 * s, 0)))::INT AS c FROM a)
SELECT doc_id, (CASE WHEN n <= 0 THEN 800 WHEN n <= 200 OR c >= n THEN n ELSE c END)::INT AS chunk_size,
  (CASE WHEN n <= 0 THEN 120 WHEN n <= 200 OR c >= n THEN 0 ELSE greatest(20, least(round_even(c * (CASE WHEN n <= 1500 THEN 0.15 ELSE 0.18 END), 0)::INT, c // 3, trunc(120 * s)::INT)) END)::INT AS chunk_overlap FROM b""")
def chunk_params(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = T.chunk_params(F.length("text"), S.chunk_size, S.chunk_overlap)
    return _documents(spark, d).select("doc_id", size.alias("chunk_size"), overlap.alias("chunk_overlap"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    records = _documents(spark, d).select(F.col("doc_id").alias("asset_id"), "text")
    return ingest.numbered(ingest.split(records, S.chunk_size, S.chunk_overlap)).select("asset_id", "chunk_order", "char_count", "chunk_text")


@query()
def structural_split(spark: SparkSession, d: str) -> DataFrame:
    parts = F.pandas_udf(lambda texts: texts.map(T.structural_parts), "array<string>")
    return _documents(spark, d).select("doc_id", F.posexplode(parts("text")).alias("part", "text"))


@query()
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.clean_extracted(F.col("text")).alias("text"))


@query("""
WITH a AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
b AS (SELECT *, length(regexp_replace(t, '[^\\x{0600}-\\x{06ff}\\x{0750}-\\x{077f}]', '', 'g')) AS ar, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS la FROM a)
SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[\\x{0600}-\\x{06ff}]') THEN 'ar' ELSE 'en' END AS question_language,
  CASE WHEN length(t) < 10 THEN NULL WHEN ar >= 3 AND ar >= la THEN 'ar' WHEN ar >= 1 AND la = 0 THEN 'ar' WHEN la >= 3 AND la > ar THEN 'en' WHEN ar > la THEN 'ar' END AS text_language FROM b""")
def text_language(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.question_language(F.col("text")).alias("question_language"), T.text_language(F.col("text")).alias("text_language"))


# Labels and names.


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN base || (CASE WHEN page_id % 5 = 0 THEN '' ELSE ' — page ' || (page_id % 5)::VARCHAR END)
  ELSE base || (CASE WHEN page_id % 5 = 0 THEN '' ELSE ' — صفحة ' || (page_id % 5)::VARCHAR END) END AS label
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN last ELSE regexp_replace(last, '^[A-Za-z0-9]{1,16}_(.+)$', '\\1') END AS base
  FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id::VARCHAR ELSE 'x' || page_id::VARCHAR || '_' || (page_id * 7)::VARCHAR || '.txt' END AS last FROM pages) a) b""")
def source_label(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("in\\dir/p"), i)).otherwise(F.concat(F.lit("/files/x"), i, F.lit("_"), (F.col("page_id") * 7).cast("string"), F.lit(".txt")))
    lang = F.when(F.col("page_id") % 2 == 0, "en").otherwise("ar-EG")
    return table(spark, d, "pages").select("page_id", T.source_label(name, F.col("page_id") % 5, lang).alias("label"))


@query("SELECT page_id, regexp_replace(trim(url), '[^\\p{L}\\p{M}\\p{N}_.]', '', 'g') AS clean_name FROM pages")
def clean_file_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.clean_file_name(F.col("url")).alias("clean_name"))


@query("""
SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:5] AS tags FROM documents""")
def tag_parse(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.tags(F.col("text")).alias("tags"))


@query("""
SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de') THEN 'file_type_not_supported' WHEN n_chars * 1000 > 2 * 1048576 THEN 'file_size_exceeded' ELSE 'file_validated_success' END AS signal FROM documents""")
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", catalog.upload_signal(F.col("lang"), F.col("n_chars") * 1000, ["en", "de"], 2).alias("signal"))


@query("""
SELECT conv_id, turn, CASE WHEN t = '' THEN NULL WHEN starts_with(t, 'CLARIFICATION_NEEDED') THEN ltrim(substr(t, 21), E' \\t:-\\n') ELSE t END AS answer, starts_with(t, 'CLARIFICATION_NEEDED') AS asks
FROM (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN 'CLARIFICATION_NEEDED: ' ELSE '' END || coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations) a""")
def parsed_answer(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.when(F.col("turn") % 2 == 0, "CLARIFICATION_NEEDED: ").otherwise(""), F.coalesce("text", F.lit("")))
    text, asks = T.parsed_answer(raw)
    return _turns(spark, d).select("conv_id", "turn", text.alias("answer"), asks.alias("asks"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def metadata_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(catalog.contains(F.col("props"), {"k": 69})).select("event_id")


# Stored tables.


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 100 OFFSET 100")
def chunks_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page(_documents(spark, d).select("doc_id", "source", "n_chars"), "doc_id", 2, S.insert_batch)


@query("""
SELECT source, n, ceil((SELECT count(DISTINCT source) FROM documents) / 7.0)::INT AS total_pages
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) s ORDER BY source LIMIT 7 OFFSET 7""")
def projects_page(spark: SparkSession, d: str) -> DataFrame:
    projects = _documents(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    total = projects.where("source is not null").agg(F.ceil(F.count("*") / 7).cast("int").alias("total_pages"))
    return catalog.page(projects, "source", 2, 7).join(F.broadcast(total))


@query("SELECT source, count(doc_id) AS chunk_count FROM documents GROUP BY source")
def chunk_count(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).groupBy("source").agg(F.count("doc_id").alias("chunk_count"))


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_assets(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("source", "lang").distinct()


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_assets(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def indexed_assets(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("""
WITH i AS (SELECT DISTINCT doc_id FROM labels),
a AS (SELECT source, count(*) AS n, count(i.doc_id) AS k FROM documents d LEFT JOIN i USING (doc_id) GROUP BY source)
SELECT source AS project_id, n AS chunk_count, n AS asset_count, k AS indexed_count, greatest(0, n - k) AS pending_count, n > 0 AND k >= n AS fully_indexed FROM a""")
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select(F.col("source").alias("project_id"), F.col("doc_id").alias("asset_id"), F.col("doc_id").alias("chunk_id"))
    return catalog.coverage(docs, docs, table(spark, d, "labels").select(F.col("doc_id").alias("asset_id")))


@query("SELECT source, substr(sha256(string_agg(p, '|' ORDER BY p)), 1, 16) AS fingerprint FROM (SELECT source, doc_id::VARCHAR || ':' || lang AS p FROM documents) d GROUP BY source")
def asset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).groupBy("source").agg(catalog.fingerprint(F.col("doc_id"), F.col("lang")).alias("fingerprint"))


@query("""SELECT event_id, sha256('{"event_type": "' || event_type || '", "task_name": "index", "user_id": ' || user_id::VARCHAR || '}') AS args_hash FROM events""")
def task_args_hash(spark: SparkSession, d: str) -> DataFrame:
    args = {"user_id": F.col("user_id"), "event_type": state.json_text(F.col("event_type"))}
    return table(spark, d, "events").select("event_id", state.args_hash(F.lit("index"), args).alias("args_hash"))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' WHEN 'signup' THEN 'PENDING' ELSE 'STARTED' END"


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.expr(_STATUS).alias("status"), F.col("ts").cast("timestamp").alias("started_at"))


@query(f"SELECT user_id, event_id, {_STATUS} AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_task(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(_ledger(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "status")


@query(f"""
SELECT user_id, CASE s WHEN 'SUCCESS' THEN false WHEN 'FAILURE' THEN true ELSE coalesce(epoch(last) - epoch(ts) > 120, false) END AS run FROM (
  SELECT user_id, {_STATUS} AS s, ts, (SELECT max(ts) FROM events) AS last FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) a""")
def should_execute(spark: SparkSession, d: str) -> DataFrame:
    ledger = _ledger(spark, d)
    last = ledger.agg(F.max("started_at").alias("last"))
    rows = state.latest(ledger, ["user_id"], "event_id").join(F.broadcast(last))
    return rows.select("user_id", state.should_execute(F.col("status"), F.col("started_at"), F.col("last"), S.task_time_limit).alias("run"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND")
def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    ledger = _ledger(spark, d)
    last = ledger.agg(F.max("started_at").alias("last"))
    return state.retained(ledger.join(F.broadcast(last)), "started_at", F.col("last"), S.retention_seconds).select("event_id")


@query("SELECT event_id, user_id, CASE WHEN user_id % 7 = 0 AND status = 'STARTED' THEN 'FAILURE' ELSE status END AS status FROM (SELECT event_id, user_id, " + _STATUS + " AS status FROM events) e")
def status_update(spark: SparkSession, d: str) -> DataFrame:
    ledger = _ledger(spark, d).withColumnRenamed("event_id", "execution_id").withColumns({"result": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("timestamp")})
    updates = ledger.where("user_id % 7 = 0 and status = 'STARTED'").select("execution_id", F.lit("FAILURE").alias("status"), F.lit("{}").alias("result"))
    return state.with_status(ledger, updates, F.lit(NOW).cast("timestamp")).select(F.col("execution_id").alias("event_id"), "user_id", "status")


@query("""
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) c""")
def chat_history_last20(spark: SparkSession, d: str) -> DataFrame:
    return state.last_messages(_turns(spark, d), "conv_id", "turn", 20).select("conv_id", "turn", "role", "place")


@query(f"""
WITH last AS (SELECT conv_id, {_K["follow_up"]} AS f FROM (SELECT conv_id, {_STRIPPED} AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) c)
SELECT conv_id, turn FROM (SELECT c.conv_id, turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS n FROM conversations c JOIN last USING (conv_id) WHERE role = 'user' AND f) r WHERE n <= 2""")
def chat_history_auto(spark: SparkSession, d: str) -> DataFrame:
    chat = _turns(spark, d)
    asked = state.latest(chat, ["conv_id"], "turn").select("conv_id", Q.is_follow_up(F.col("text")).alias("follow_up"))
    return state.history(chat.join(asked, "conv_id"), "conv_id", "turn", "auto", F.col("follow_up")).select("conv_id", "turn")


@query("SELECT user_id, count(*) AS n FROM (SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'click') a WHERE r <= 4) b GROUP BY user_id")
def user_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("role", F.when(F.col("event_type") == "click", "user").otherwise("assistant"))
    return state.history(rows, "user_id", "event_id", "user_only", F.lit(True)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
SELECT coalesce(n.n_nationkey, s.k) AS project_id, coalesce(s.name, n.n_name) AS prompt_en FROM nation n
FULL JOIN (SELECT s_suppkey AS k, min(s_name) AS name FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY s_suppkey) s ON s.k = n.n_nationkey""")
def upsert_prompt(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("prompt_en"))
    new = table(spark, d, "supplier").where("s_suppkey % 3 = 0").groupBy(F.col("s_suppkey").alias("project_id")).agg(F.min("s_name").alias("prompt_en"))
    return catalog.upsert(prompts, new, "project_id")


@query("SELECT DISTINCT s_suppkey AS project_id, s_name AS project_name, n_name AS prompt FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey")
def project_prompt(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("prompt"))
    projects = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("project_name")).distinct()
    return projects.join(prompts, "project_id", "left")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN '{\"tags\": []}' ELSE lang END AS asset_config FROM documents")
def bulk_config_update(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", "source", F.col("lang").alias("asset_config"))
    return catalog.updated(rows, F.col("source").isin("src1", "src2"), asset_config=F.lit('{"tags": []}')).select("doc_id", "asset_config")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src3' OR source IS NULL")
def delete_chunks(spark: SparkSession, d: str) -> DataFrame:
    return catalog.without(_documents(spark, d).select("doc_id", "source"), F.col("source") == "src3")


@query("""
SELECT c_custkey AS project_id, c_name AS name FROM customer UNION ALL
SELECT k, name FROM (SELECT s_suppkey + 1000 AS k, min(s_name) AS name FROM supplier GROUP BY ALL) s WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    new = table(spark, d, "supplier").groupBy((F.col("s_suppkey") + 1000).alias("project_id")).agg(F.min("s_name").alias("name"))
    return catalog.insert_absent(have, new, ["project_id"])


# Prompts, metrics, streams.


@query("""
SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER w AS used, row_number() OVER w AS n FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) c WHERE used <= 600 OR n = 1""")
def char_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return fusion.within_budget(rows, F.col("n"), 600).select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"), "used")


@query("""
WITH kept AS (SELECT *, sum(length(t)) OVER w AS used, row_number() OVER w AS n FROM (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations) c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, sha256('""" + search.TEMPLATES["en"][0].replace("'", "''") + """' || E'\\n\\n' || string_agg('[' || n::VARCHAR || '] ' || role || ' — page ' || (turn + 1)::VARCHAR || E'\\n' || regexp_replace(left(t, 4000), '^\\s+|\\s+$', '', 'g'), E'\\n\\n' ORDER BY n)
  || E'\\n\\nQuestion: hello there') AS digest FROM kept WHERE used <= 12000 OR n = 1 GROUP BY conv_id""")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select(F.col("conv_id").alias("query_id"), F.lit("hello there").alias("query"), F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("file_name"), (F.col("turn") + 1).cast("int").alias("page"))
    return search.prompts(rows, S.context_chars).select(F.col("query_id").alias("conv_id"), F.sha2("prompt", 256).alias("digest"))


@query()
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    corpus, queries = _vectors(spark, d)
    queries = queries.select("query_id", "vector").join(_asked(spark, d), "query_id", "full")
    near = search.hybrid(spark, corpus, docs, queries, candidates=S.candidates, k=S.rrf_k, index=_index(spark, d))
    # Which passages are within the budget is found out by their lengths; only the texts of these are read then,
    # and of those that ask. A digest tells texts of one id apart.
    passages = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("_d"), F.length("text").alias("_n"), F.col("source").alias("file_name"))
    asking = docs.select(F.col("doc_id").alias("query_id"), F.xxhash64("text").alias("_q"))
    rows = fusion.within_budget(near.join(passages, "key").join(asking, "query_id"), F.col("_n"), S.context_chars).drop("_n", "used")
    rows = kept(rows.withColumn("page", F.lit(None).cast("int")))

    def texts(id: str, digest: str, name: str) -> DataFrame:
        wanted = kept(rows.select(id).distinct())
        some = docs.withColumnRenamed("doc_id", id).join(small(wanted, 2_000_000), id, "left_semi")
        return some.select(id, F.xxhash64("text").alias(digest), F.col("text").alias(name)).dropDuplicates([id, digest])

    rows = rows.join(texts("key", "_d", "text"), ["key", "_d"]).join(texts("query_id", "_q", "query"), ["query_id", "_q"]).drop("_d", "_q")
    return search.prompts(rows, S.context_chars)


@query("SELECT event_type, count(*) AS total FROM events GROUP BY event_type")
def request_counter(spark: SparkSession, d: str) -> DataFrame:
    return state.counter(table(spark, d, "events"), "event_type")


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0)


@query(
    "SELECT event_type, le, cumulative, total, n FROM ("
    + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS cumulative, round(sum(value), 3) AS total, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type" for b in _BOUNDS)
    + " UNION ALL SELECT event_type, '+Inf', count(*), round(sum(value), 3), count(*) FROM events WHERE value IS NOT NULL GROUP BY event_type) h"
)
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return state.histogram(table(spark, d, "events"), F.col("value"), "event_type", bounds=_BOUNDS).select("event_type", "le", "cumulative", F.round("total", 3).alias("total"), "n")


@query("SELECT DISTINCT vec_id, label FROM embeddings")
def incremental_index_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    folder = own_folder(spark, "stream")
    rows.where("vec_id % 2 = 0").write.parquet(f"{folder}/in/first")
    schema = rows.schema

    def run() -> DataFrame:
        return incremental.index_new(spark, f"{folder}/in/*", schema, f"{folder}/out", "vec_id")

    run()
    rows.write.parquet(f"{folder}/in/second")  # half of it is there already
    return run().select("vec_id", "label")


@query("""
SELECT event_type, count(*) FILTER (ts >= last - INTERVAL 86400 SECOND) AS kept, count(*) FILTER (ts < last - INTERVAL 86400 SECOND) AS expired
FROM events, (SELECT max(ts) AS last FROM events) m GROUP BY event_type""")
def retention_stream(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    folder = own_folder(spark, "stream")
    events.write.parquet(f"{folder}/events")
    return incremental.retained_counts(spark, f"{folder}/events", events.schema, "ts", "event_type", F.lit(last), S.retention_seconds)


#: Seconds after which a task of ``task_gate_stream`` is stuck, for its requests are hours apart.
GATE_WAIT = 21_600


@query(f"""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' WHEN 'signup' THEN 'RETRY' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE ts IS NOT NULL),
g AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::TIMESTAMP AS due, NULL::BIGINT AS run, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS decision, NULL::BIGINT AS stuck, NULL::TIMESTAMP AS stuck_at FROM e
  UNION ALL
  SELECT user_id, n, CASE WHEN s IS NOT NULL THEN s WHEN go THEN 'STARTED' ELSE was END,
    CASE WHEN s = 'RETRY' OR (s IS NULL AND go) THEN date_trunc('second', ts) + INTERVAL {GATE_WAIT + 1} SECOND ELSE due END, CASE WHEN s = 'RETRY' OR (s IS NULL AND go) THEN event_id ELSE run END,
    event_id, ts, CASE WHEN s IS NULL THEN CASE WHEN go THEN 'run' ELSE 'skip' END END, CASE WHEN was = 'STUCK' AND status <> 'STUCK' THEN run END, due
  FROM (SELECT *, coalesce(was NOT IN ('SUCCESS', 'STARTED', 'RETRY'), true) AS go FROM (
    SELECT e.user_id, e.n, e.s, e.event_id, e.ts, g.status, g.due, g.run, CASE WHEN g.status IN ('STARTED', 'RETRY') AND e.ts >= g.due THEN 'STUCK' ELSE g.status END AS was
    FROM g JOIN e ON e.user_id IS NOT DISTINCT FROM g.user_id AND e.n = g.n + 1) a) b)
SELECT user_id, event_id, ts, decision FROM g WHERE decision IS NOT NULL
UNION ALL SELECT user_id, stuck, stuck_at, 'stuck' FROM g WHERE stuck IS NOT NULL
UNION ALL SELECT user_id, run, due, 'stuck' FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1) l
WHERE status IN ('STARTED', 'RETRY') AND due <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def task_gate_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the events' time first, then the rest, by a stream that goes on from its checkpoint."""
    events = table(spark, d, "events").withColumn("status", F.expr("CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE' WHEN 'signup' THEN 'RETRY' END"))
    events = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "status")
    folder = own_folder(spark, "gate")
    for _ in _in_two(spark, events, f"{folder}/in"):
        out = gate.decided(spark, f"{folder}/in/*", events.schema, f"{folder}/out", ["user_id"], id="event_id", at="ts", status="status", wait=GATE_WAIT)
    return out.select("user_id", F.col("id").alias("event_id"), F.col("at").alias("ts"), "decision")


def _in_two(spark: SparkSession, events: DataFrame, folder: str):
    """Files of two thirds of the events' time, and then of the rest."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cut = F.coalesce(F.col("ts") < F.lit(None if first is None else first + (last - first) * 2 / 3), F.lit(False))
    for name, part in (("first", cut), ("second", ~cut)):
        yield events.where(part).write.parquet(f"{folder}/{name}")


@query(f"""
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life, sum(new) OVER (PARTITION BY user_id) AS lives FROM (
    SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {S.retention_seconds} SECOND)::INT, 1) AS new FROM events WHERE ts IS NOT NULL) a) b
GROUP BY user_id, life
HAVING life < any_value(lives)
  OR max(ts) + INTERVAL {S.retention_seconds} SECOND < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def retention_expiry_stream(spark: SparkSession, d: str) -> DataFrame:
    """Users that aren't heard of for the retention time, by a stream that goes on from its checkpoint."""
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = own_folder(spark, "expiry")
    for _ in _in_two(spark, events, f"{folder}/in"):
        out, _ = retention.expired(spark, f"{folder}/in/*", events.schema, f"{folder}/out", ["user_id"], at="ts", seconds=S.retention_seconds)
    return out


# More queries register themselves.
from . import catalogue_forms, catalogue_store  # noqa: E402, F401
