"""Hybrid search for batches of questions, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import questions as Q
from ..functions.text import cut_then_strip, focused, lexical_recall, question_language, source_label
from ..models import Generator, Reranker
from ..operators.common import small
from ..operators.dense import nearest
from ..operators.fusion import greedy_dedup, reciprocal_rank_fusion, rerank, text_key, within_budget
from ..operators.sparse import search
from ..operators.text_index import TextIndex

#: Own wording of the prompt, by language.
TEMPLATES = {
    "en": ("Answer from the passages only. If they don't hold the answer, begin with CLARIFICATION_NEEDED and ask what is meant.", "Question: $question"),
    "ar": ("أجب من المقاطع فقط. إن لم تكن الإجابة فيها فابدأ بعبارة CLARIFICATION_NEEDED واسأل عن المقصود.", "السؤال: $question"),
}


def filled(template: Column, **values: Column) -> Column:
    """A template with each ``$name`` replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"${name}"), value)
    return template


def hybrid(spark: SparkSession, vectors: DataFrame, texts: DataFrame, queries: DataFrame, *, candidates: int = 30, k: int = 60, index: TextIndex | None = None) -> DataFrame:
    """(query_id, key, score, rank): dense and sparse rankings of ``candidates`` rows each, fused.
    ``queries`` is (query_id, vector, terms); keys are ids. If one ranking of a query is empty, the
    other one stands as it is, with its own scores, deduplicated by text. With an index of ``texts``
    these are searched there."""
    dense = nearest(spark, vectors, queries.where("vector is not null").select("query_id", "vector"), candidates)
    worded = queries.select("query_id", "terms").where("size(terms) > 0")
    sparse = search(texts, worded, candidates) if index is None else index.search(worded, candidates)
    dense, sparse = (x.withColumnRenamed("id", "key").checkpoint() for x in (dense, sparse))
    both = dense.select("query_id").distinct().join(sparse.select("query_id").distinct(), "query_id")
    fused = reciprocal_rank_fusion(dense.join(both, "query_id", "left_semi"), sparse.join(both, "query_id", "left_semi"), k=k, limit=candidates)
    alone = dense.unionByName(sparse).join(both, "query_id", "left_anti")
    alone = alone.join(texts.select(F.col("doc_id").alias("key"), text_key(F.col("text")).alias("_t")), "key", "left")
    single = greedy_dedup(alone, ["key", "_t"], order=[-F.col("score"), F.col("key")], limit=candidates)
    return fused.unionByName(single.select("query_id", "key", "score", F.col("kept_rank").alias("rank")))


def expanded(found: DataFrame, extra: DataFrame, query: Column, limit: Column) -> DataFrame:
    """``found`` and ``extra`` (query_id, id, text, score), re-ranked together and deduplicated, as
    many as the question's kind asks for. Queries without extra rows stay as they are."""
    both = found.unionByName(extra)
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    both = both.withColumn("rank", F.row_number().over(at)).withColumn("_q", query)
    ranked = rerank(both, lexical_recall(F.col("text"), F.col("_q")), Q.structural_boost(F.col("text"), F.col("_q")))
    ranked = ranked.withColumn("_t", text_key(F.col("text"))).withColumn("_most", limit)
    kept = greedy_dedup(ranked.drop("rank"), ["id", "_t"], order=[F.col("new_rank")])
    return kept.where("kept_rank <= _most").select("query_id", "id", "text", F.col("combined").alias("score"), F.col("kept_rank").alias("rank"))


def cross_encoded(rows: DataFrame, model: Reranker, *, chars: int = 1024, top: int = 5) -> DataFrame:
    """The ``top`` rows (query_id, query, id, text, rank, ...) of each query by the model's scores;
    equal ones keep their order. The lists of a query are the bounded results of a search."""
    import pandas as pd

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        part["model_score"] = model.scores(part["query"].iloc[0] or "", [(t or "").strip()[:chars] for t in part["text"]])
        return part.sort_values("model_score", ascending=False, kind="stable").head(top)

    out = rows.groupBy("query_id").applyInPandas(run, StructType([*rows.schema.fields, StructField("model_score", DoubleType())]))
    at = Window.partitionBy("query_id").orderBy(F.desc("model_score"), F.asc("rank"))
    return out.withColumn("rank", F.row_number().over(at))


def template(lang: Column, part: int, default: str = "en") -> Column:
    """A part of the prompt's wording in a language, or in the default one if there is none."""
    out = F.lit(TEMPLATES[default][part])
    for known, parts in TEMPLATES.items():
        out = F.when(lang == known, parts[part]).otherwise(out)
    return out


def prompts(rows: DataFrame, budget: int, *, chars: int = 4000, compose: bool = True, own: dict[str, str | None] | None = None) -> DataFrame:
    """(query_id, prompt): passages (query_id, query, rank, text, file_name, page) within the budget,
    numbered and labelled, narrowed to their best item where the question wants that. ``own`` has a
    project's wording of the head by language, where it has one."""
    kept = within_budget(rows, F.length("text"), budget)
    # What a question is is found out once for each; only passages of those that want it are narrowed.
    asked = rows.groupBy("query_id").agg(F.first("query").alias("query"))
    asked = asked.select(F.col("query_id").alias("_of"), question_language(F.col("query")).alias("_lang"), F.coalesce(Q.wants_focus(F.col("query")), F.lit(False)).alias("_focus")).checkpoint()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    kept = kept.withColumn("_n", place).join(small(asked), F.col("query_id") == F.col("_of")).drop("_of")
    if not asked.where("_focus").isEmpty():
        narrowed = kept.where("_focus").withColumn("text", focused(F.col("text"), F.col("query"), compose=compose))
        kept = narrowed.unionByName(kept.where("not _focus"))
    text = F.col("text")
    line = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), source_label(F.col("file_name"), F.col("page"), F.col("_lang")), F.lit("\n"), cut_then_strip(text, chars))
    kept = kept.withColumn("_line", line)
    body = kept.groupBy("query_id", "query", "_lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n\n").alias("_body"))
    head = template(F.col("_lang"), 0)
    for known, words in (own or {}).items():
        head = F.when((F.col("_lang") == known) & F.lit(bool((words or "").strip())), F.lit(words or "")).otherwise(head)
    foot = filled(template(F.col("_lang"), 1), question=F.coalesce("query", F.lit("")))
    return body.select("query_id", F.concat_ws("\n\n", head, "_body", foot).alias("prompt"))


def answers(prompted: DataFrame, model: Generator, history: DataFrame | None = None) -> DataFrame:
    """(query_id, answer, asks): what the model makes of each prompt and of the earlier messages that
    go with it, ``history`` (query_id, place, role, text), a bounded number for each query."""
    from ..functions.text import parsed_answer

    def run(parts):
        for part in parts:
            said = [[(m["role"], m["text"]) for m in (h if h is not None else [])] for h in part["said"]]
            yield part[["query_id"]].assign(raw=[model.generate(p, h) for p, h in zip(part["prompt"], said, strict=True)])

    said = "array<struct<role:string,text:string>>"
    rows = prompted.select("query_id", "prompt")
    if history is None:
        rows = rows.withColumn("said", F.lit(None).cast(said))
    else:
        listed = history.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("h"))
        rows = rows.join(listed, "query_id", "left").withColumn("said", F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))).drop("h")
    raw = rows.select("query_id", "prompt", "said").mapInPandas(run, "query_id long, raw string")
    text, asks = parsed_answer(F.col("raw"))
    return raw.select("query_id", text.alias("answer"), asks.alias("asks"))
