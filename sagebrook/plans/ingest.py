"""From loaded records to chunks, and from chunks to indexed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_params, clean_extracted, recursive_split, structural_parts
from ..models import Embedder
from ..operators.catalog import Collections


def split(records: DataFrame, size: int = 800, overlap: int = 120, *, clean: bool = True) -> DataFrame:
    """(all columns but text, part, chunk_text): each record's text cleaned, cut at its headers, and
    cut into chunks of a size that follows the text's length. Pages of a PDF have no overlap; a
    text that is empty when clean has no chunks."""
    rows = records.withColumn("text", clean_extracted(F.col("text")) if clean else F.coalesce("text", F.lit(""))).where("text <> ''")
    own, over = chunk_params(F.length("text"), size, overlap)
    bound = F.col("page").isNotNull() & (F.col("source_type") == "pdf") if {"page", "source_type"} <= set(records.columns) else F.lit(False)
    rows = rows.withColumn("_size", own).withColumn("_over", F.when(bound, 0).otherwise(over))
    keep = [c for c in records.columns if c != "text"]
    schema = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in keep) + ", part int, chunk_text string"

    def chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [[c for p in structural_parts(t) for c in recursive_split(p, s, o)] for t, s, o in zip(part.text, part._size, part._over, strict=True)]
            out = part[keep].assign(chunk_text=made, part=[list(range(len(m))) for m in made])
            out = out[out.chunk_text.map(len) > 0].explode(["part", "chunk_text"], ignore_index=True)
            yield out[[*keep, "part", "chunk_text"]].astype({"part": "int32"})

    return rows.select(*keep, "text", "_size", "_over").mapInPandas(chunks, schema)


def numbered(chunks: DataFrame, asset: str = "asset_id", *order: str) -> DataFrame:
    """Chunks with chunk_order, from 1 on over each asset, and char_count."""
    at = Window.partitionBy(asset).orderBy(*order, "part")
    return chunks.withColumn("chunk_order", F.row_number().over(at)).withColumn("char_count", F.length("chunk_text"))


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunks`` (chunk_id, chunk_text) with their vectors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(vector=embedder.embed(part.chunk_text.tolist()))

    return chunks.select("chunk_id", "chunk_text").mapInPandas(run, "chunk_id long, chunk_text string, vector array<float>")


def pending(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    return chunks.join(indexed.select("chunk_id"), "chunk_id", "left_anti")


def index(chunks: DataFrame, store: Collections, embedder: Embedder, project_id: int) -> None:
    """Embed and store the chunks (chunk_id, chunk_text, and, where they have some, metadata as JSON)
    of a project that aren't stored yet."""
    left = pending(chunks, store.indexed_ids(embedder.size, project_id))
    new = embedded(left, embedder)
    if "metadata" in chunks.columns:
        new = new.join(left.select("chunk_id", "metadata"), "chunk_id")
    else:
        new = new.withColumn("metadata", F.lit(None).cast("string"))
    rows = new.select(F.col("chunk_id").alias("id"), F.col("chunk_text").alias("text"), "vector", "metadata", "chunk_id")
    store.insert(rows, embedder.size, project_id)


def line_chunks(text: str, size: int, mark: str = "\n") -> list[str]:
    """Lines of two characters or more gathered until a chunk has ``size``; what is left over at the
    end is a chunk even if it is empty."""
    out, held = [], ""
    for line in (x.strip() for x in text.split(mark)):
        if len(line) > 1:
            held += line + mark
            if len(held) >= size:
                out.append(held.strip())
                held = ""
    return [*out, held.strip()]
