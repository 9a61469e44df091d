"""Loading uploaded files as records: (path, text, metadata columns)."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import BROADCAST_ROWS, small
from ..session import with_checkpoints

TYPES = ("txt", "pdf", "csv", "xlsx")
#: A page reader: the bytes of a file to (page number, text, whether it was recognised).
Pages = Callable[[bytes], list[tuple[int, str, bool]]]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _records(df: DataFrame) -> DataFrame:
    names = {"page": "int", "row": "int", "ocr_used": "boolean"}
    for name, kind in names.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.select("path", "text", *names)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """Each .txt file whole, one record."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return _records(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Each row of each .csv file is a record of ``column: value`` lines. Files may have different
    columns, so each is read with its own header. Files are read by lines, in splits, and no file is
    held; where one has a quote, a record may go over many lines, and the file's lines go by one
    task in their order."""
    line = F.col("value").cast("binary")
    lines = with_checkpoints(spark).read.text(path, lineSep="\n", pathGlobFilter="*.csv", recursiveFileLookup=True)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), line.alias("_line"), F.contains("value", F.lit('"')).alias("_quote"), (F.rtrim("value", F.lit("\r")) != "").alias("_filled"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("_file", "_start").agg(F.count_if("_filled").alias("n"), F.bool_or("_quote").alias("_quotes"), F.min_by("_line", "_at").alias("first"))
    of = Window.partitionBy("_file")
    before = F.sum("n").over(of.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    header = F.first("first").over(of.orderBy("_start"))
    splits = splits.withColumns({"_before": F.coalesce(before, F.lit(0)), "_header": header, "_quotes": F.bool_or("_quotes").over(of)})
    splits = splits.select("_file", "_start", "_before", "_header", "_quotes", F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))).alias("path")).checkpoint()
    out = "path string, text string, row int"
    one = small(splits.where("not _quotes"))
    plain = lines.join(one, ["_file", "_start"]).select("path", "_start", "_before", "_header", "_line", "_at")
    if splits.count() > BROADCAST_ROWS:  # a join that shuffles loses the order
        plain = plain.sortWithinPartitions("path", "_start", "_at")
    quoted = splits.where("_quotes")
    if quoted.isEmpty():
        return _records(plain.drop("_at").mapInArrow(_csv_rows, out))
    whole = lines.join(small(quoted), ["_file", "_start"]).select("path", F.lit(0).cast("long").alias("_start"), F.lit(0).cast("long").alias("_before"), F.lit(None).cast("binary").alias("_header"), "_line", F.col("_start").alias("_place"), "_at")
    whole = whole.repartition("path").sortWithinPartitions("path", "_place", "_at").drop("_place", "_at")
    return _records(plain.drop("_at").mapInArrow(_csv_rows, out).union(whole.mapInArrow(_csv_rows, out)))


def _csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines in their order, split by split, each with the file's header and the number of
    filled lines before the split; without a header the first record is it."""

    def lines() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("path", "_start", "_before", "_header", "_line")), strict=True)

    def decoded(line: bytes) -> str:
        return line.decode("utf-8", errors="replace") + "\n"

    def records() -> Iterator[tuple[str, str, int]]:
        for (path, start, before, header), rows in groupby(lines(), lambda x: x[:4]):
            texts = (decoded(x[4]) for x in rows)
            if start == 0:
                texts = chain([next(texts).removeprefix("\ufeff")], texts)
            names = None
            if header is not None:
                names = next(csv.reader([decoded(header).removeprefix("\ufeff")]))
                if start == 0:
                    next(texts)
                elif names:
                    before -= 1
            for i, r in enumerate(csv.DictReader(texts, names)):
                yield path, "\n".join(f"{(k or '').strip()}: {(v if isinstance(v, str) else ', '.join(v or [])).strip()}" for k, v in r.items()), before + i

    found = records()
    while part := list(islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)], names=["path", "text", "row"])


def load_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of each .xlsx file that have rows, as CSV under their names; a file that can't be
    read is left out. Needs openpyxl on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)

    def sheets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [workbook_text(c) for c in part.content]
            yield pd.DataFrame({"path": part.path, "text": texts}).dropna()

    return _records(files.select("path", "content").mapInPandas(sheets, "path string, text string"))


def workbook_text(content: bytes) -> str | None:
    try:
        tables = pd.read_excel(io.BytesIO(content), sheet_name=None)
    except Exception:  # noqa: BLE001  whatever is wrong with the file, it is skipped
        return None
    parts = [f"--- Sheet: {name} ---\n{t.to_csv(index=False)}\n" for name, t in tables.items() if not t.empty]
    return "".join(parts) or "Empty Excel File"


def recognised(pages: Pages, recognise: Callable[[bytes, int], str], least: int = 10) -> Pages:
    """A page reader that has pages with hardly any text (under ``least`` characters) recognised from
    their image by ``recognise`` (file, page number); what fails there gives an empty page."""

    def read(content: bytes) -> list[tuple[int, str, bool]]:
        out = []
        for number, text, before in pages(content):
            if len((text or "").strip()) >= least:
                out.append((number, text, before))
                continue
            try:
                out.append((number, recognise(content, number) or "", True))
            except Exception:  # noqa: BLE001  whatever is wrong with a page, the others are read
                out.append((number, "", True))
        return sorted(out, key=lambda p: p[0])

    return read


def load_pdf(spark: SparkSession, path: str, pages: Pages) -> DataFrame:
    """The pages of each .pdf file that have text, as the reader gives them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for where, content in zip(part.path, part.content, strict=True):
                found = [p for p in pages(bytes(content)) if p[1].strip()]
                yield pd.DataFrame({"path": where, "page": [p[0] for p in found], "text": [p[1] for p in found], "ocr_used": [p[2] for p in found]})

    return _records(files.select("path", "content").mapInPandas(each, "path string, page int, text string, ocr_used boolean"))


def load(spark: SparkSession, path: str, pdf_pages: Pages | None = None) -> DataFrame:
    """All files under a path by their extension; other files are left out, and so are .pdf files
    without a reader."""
    out = load_text(spark, path).unionByName(load_csv(spark, path)).unionByName(load_xlsx(spark, path))
    return out.unionByName(load_pdf(spark, path, pdf_pages)) if pdf_pages else out


def with_metadata(records: DataFrame) -> DataFrame:
    """Adds file_name and source_type (``unknown`` for other types), and makes pages whole numbers
    or nothing."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    kind = extension(F.col("path"))
    return records.withColumn("file_name", name).withColumn("source_type", F.when(kind.isin(*TYPES), kind).otherwise("unknown")).withColumn("page", F.col("page").cast("string").try_cast("int"))
