"""Neighbouring chunks of what a search has found. ``chunks`` is (asset_id, chunk_order, text, ...),
with one row for each asset and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.questions import article_context_limit, article_numbers, chapter_labels, cited_articles, cites_article, cites_chapter, is_structural, starts_other_article, starts_other_chapter

RUN = 12


def continuation_key(asset_id: Column, chunk_order: Column) -> tuple[Column, Column]:
    """Asset and order of the next chunk; null if either isn't a number."""
    asset = asset_id.cast("string").try_cast("bigint")
    order = chunk_order.cast("string").try_cast("int")
    return F.when(order.isNotNull(), asset), F.when(asset.isNotNull(), order + 1)


def continuations(found: DataFrame, chunks: DataFrame, ends_open: Column) -> DataFrame:
    """(query_id, asset_id, chunk_order, score): the chunk after each found one whose text ends with
    an open header, unless it is found already; its score is the found one's, 0.95 at least."""
    asset, order = continuation_key(F.col("asset_id"), F.col("chunk_order"))
    wanted = found.where(ends_open).select("query_id", asset.alias("asset_id"), order.alias("chunk_order"), F.greatest("score", F.lit(0.95)).alias("score"))
    wanted = wanted.groupBy("query_id", "asset_id", "chunk_order").agg(F.max("score").alias("score"))
    new = wanted.join(found.select("query_id", "asset_id", "chunk_order"), ["query_id", "asset_id", "chunk_order"], "left_anti")
    return new.join(chunks.select("asset_id", "chunk_order"), ["asset_id", "chunk_order"]).select("query_id", "asset_id", "chunk_order", "score")


def page_siblings(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, asset_id, page, chunk_order, score): other chunks on the pages of the found ones,
    at 0.96 or the found one's score. ``found`` and ``chunks`` have a page; nulls have no siblings."""
    seeds = found.where("page is not null").groupBy("query_id", "asset_id", "page").agg(F.max("score").alias("score"))
    rows = seeds.join(chunks.select("asset_id", "page", "chunk_order"), ["asset_id", "page"])
    rows = rows.join(found.select("query_id", "asset_id", "chunk_order"), ["query_id", "asset_id", "chunk_order"], "left_anti")
    return rows.select("query_id", "asset_id", "page", "chunk_order", F.greatest("score", F.lit(0.96)).alias("score"))


def runs(seeds: DataFrame, chunks: DataFrame, stops: Column, length: int = RUN, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, asset_id, *by, start, chunk_order, offset): up to ``length`` consecutive chunks from
    each seed (query_id, asset_id, chunk_order, *by) on, until an order is missing or one ``stops``,
    which may read the chunk and the seed's ``by``. Each distinct seed has one run.
    An equality join: each seed's orders are listed, not searched for."""
    keys = ["query_id", "asset_id", *by]
    seeds = seeds.select(*keys, F.col("chunk_order").alias("start")).distinct()
    wanted = seeds.select(*keys, "start", F.posexplode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("offset", "chunk_order"))
    rows = wanted.join(chunks.drop(*by), ["asset_id", "chunk_order"], "left")
    order = Window.partitionBy(*keys, "start").orderBy("chunk_order")
    over = F.col("text").isNull() | ((F.col("offset") > 0) & F.coalesce(stops, F.lit(False)))
    rows = rows.withColumn("_over", F.max(over).over(order))
    return rows.where("not _over").select(*keys, "start", "chunk_order", "offset")


def chapter_runs(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, asset_id, chapter, start, chunk_order, offset, score): runs from each seed (query_id,
    asset_id, chunk_order, chapter, score) until another chapter than the seed's own begins, scored
    from 0.95 downwards, but not below the seed's own score. A file's seeds may have several chapters."""
    keyed = runs(seeds, chunks, starts_other_chapter(F.col("text"), F.col("chapter")), by=("chapter",))
    best = seeds.groupBy("query_id", "asset_id", "chapter", F.col("chunk_order").alias("start")).agg(F.max("score").alias("score"))
    scored = keyed.join(best, ["query_id", "asset_id", "chapter", "start"])
    return scored.withColumn("score", F.greatest("score", 0.95 - 0.01 * F.col("offset")))


def article_runs(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, asset_id, number, chunk_order, place, score): for each wanted article (query_id,
    asset_id, number, most) the chunks from where it is cited first in a chunk, or else from where
    it is cited at all, until one begins with another article, ``most`` of them at most."""
    rows = wanted.join(chunks.select("asset_id", "chunk_order", "text"), "asset_id")
    number = F.col("number")
    cites = cites_article(F.col("text"), number)
    leads = cites & (F.get(cited_articles(F.col("text")), 0) == number)
    of = Window.partitionBy("query_id", "asset_id", "number")
    start = F.coalesce(F.min(F.when(leads, F.col("chunk_order"))).over(of), F.min(F.when(cites, F.col("chunk_order"))).over(of))
    rows = rows.withColumn("_start", start).where("chunk_order >= _start")
    order = of.orderBy("chunk_order")
    stop = (F.col("chunk_order") > F.col("_start")) & starts_other_article(F.col("text"), number)
    rows = rows.withColumn("_over", F.max(stop).over(order)).where("not _over").withColumn("place", F.row_number().over(order) - 1)
    rows = rows.where("place < most")
    return rows.select("query_id", "asset_id", "number", "chunk_order", "place", (0.98 - 0.005 * F.col("place")).alias("score"))


def top_seeds(found: DataFrame, n: int = 5) -> DataFrame:
    """The n best rows of each query, by score, equal ones by rank."""
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return found.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= n).drop("_n")


def structural_context(found: DataFrame, chunks: DataFrame, seeds: int = 5) -> DataFrame:
    """(query_id, asset_id, chunk_order, score, emitted): what goes with the rows found (query_id,
    query, asset_id, chunk_order, page, text, score, rank) of questions about articles and chapters:
    the runs of the articles asked for in the seeds' files, the seeds' pages, and the runs from seeds
    that cite a chapter asked for until another one begins. Each chunk once, as it is emitted first;
    those found already are left out."""
    asked = found.where(is_structural(F.col("query")))
    best = top_seeds(asked, seeds).checkpoint()
    keys = ["query_id", "asset_id", "chunk_order"]
    wanted = best.select("query_id", "query", "asset_id").distinct().withColumn("number", F.explode(article_numbers(F.col("query"))))
    articles = article_runs(wanted.select("query_id", "asset_id", "number", article_context_limit(F.col("query")).alias("most")), chunks)
    articles = articles.select(*keys, "score", F.struct(F.lit(0).alias("branch"), F.col("number").alias("of"), F.col("place").cast("long").alias("place")).alias("emitted"))
    pages = page_siblings(best, chunks).select(*keys, "score", F.struct(F.lit(1).alias("branch"), F.lit("").alias("of"), F.col("chunk_order").cast("long").alias("place")).alias("emitted"))
    labels = best.withColumn("chapter", F.explode(chapter_labels(F.col("query")))).where(cites_chapter(F.col("text"), F.col("chapter")))
    each = labels.groupBy(*keys, "chapter").agg(F.max("score").alias("score"))
    chapters = chapter_runs(each, chunks)
    chapters = chapters.select(*keys, "score", F.struct(F.lit(2).alias("branch"), F.lit("").alias("of"), F.col("offset").cast("long").alias("place")).alias("emitted"))
    first = Window.partitionBy(*keys).orderBy("emitted")
    every = articles.union(pages).union(chapters).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return every.join(found.select(keys), keys, "left_anti")
