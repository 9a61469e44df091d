"""WARC archives of web pages, compressed record by record with a Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record
follows as a Zstandard frame of its own, so that a reader can start at any record's offset. The
dictionary is built from the archived records themselves: from a bounded sample, DICTIONARY_PAGES
payloads of the least hashes of page_id, which is the same whenever the same pages are archived.

Payloads of REVISIT_BYTES or more that occur more than once are stored once, in the record of the
largest page_id; the others become revisit records that refer to it. Archives are written by the
executors straight to the given folder, each in one task, under a temporary name until it is whole.
They hold some ARCHIVE_BYTES of payload each. The manifest names only what a finished task has
written, and a row's archive follows from the row itself, so a repeated task does no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, least_hashes, small

SKIPPABLE = 0x184D2A5D
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32_000_000
#: Archives at most, as each is a partition; beyond, they grow.
ARCHIVES = 100_000
DICTIONARY_BYTES = 64_000
DICTIONARY_PAGES = 500
LEVEL = 3
#: Tasks that read archives, at most; beyond, a task reads several.
READERS = 20_000
_URI = "urn:page:"


def record(kind: str, page_id: int | None, url: str, digest: str, size: int, block: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit's block is empty, digest and size are those of the full payload.
    A page without an id is named by a UUID of its digest."""
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}" if page_id is None else f"{_URI}{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{_URI}{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, block


def dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the samples; of too few to train on, their start as plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def open_archive(path: str):
    files, at = fs.FileSystem.from_uri(path)
    return files.open_input_stream(at, compression=None)


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one after the other."""
    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(int.from_bytes(head[4:], "little"))))
    rest = b""
    frame, out = reader.decompressobj(), []
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                break
        out.append(frame.decompress(rest))
        rest = b""
        if frame.eof:
            yield parse(b"".join(out))
            rest = frame.unused_data
            frame, out = reader.decompressobj(), []
    if any(out):
        raise ValueError("the last record is cut off")


def _writer(folder: str, trained: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows are one archive."""
        n = size = 0
        out = None
        for batch in batches:
            if out is None and batch.num_rows:
                name = f"{folder}/pages-{batch.column('archive')[0].as_py():08d}.warc.zst"
                files, at = fs.FileSystem.from_uri(f"{name}.{uuid.uuid4().hex}.part")
                compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained)).compress
                out = files.open_output_stream(at, compression=None)
                out.write(SKIPPABLE.to_bytes(4, "little") + len(trained).to_bytes(4, "little") + trained)
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "n", "refers_to")]
            for page_id, url, html, digest, length, refers_to in zip(*columns, strict=True):
                kind = "response" if refers_to is None else "revisit"
                size += out.write(compress(record(kind, page_id, url or "", digest, length, (html or "").encode(), refers_to)))
                n += 1
        if out is not None:
            out.close()
            files.move(at, fs.FileSystem.from_uri(name)[1])
            yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, ws: Workspace | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``folder``, a URI that all executors can write;
    the manifest (path, records, bytes). Every row becomes a record, one with a null page_id too;
    a null url is empty, a null html an empty payload. Of an empty table there are no archives."""
    ws = ws or Workspace(spark, "warc")
    files, at = fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"digest": F.sha1(F.encode("html", "utf-8")), "n": F.octet_length("html").cast("long")})
    sizes = ws.save(pages.select("page_id", "digest", "n"), "sizes")
    total = sizes.agg(F.sum("n"), F.count("*")).first()
    # All records of equal pages refer to the largest page_id; a row repeated under that id stays a
    # response, and so do equal pages of which none has an id.
    copied = sizes.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    copied = ws.save(copied.select("digest", "first"), "copied")
    repeated = ws.save(sizes.groupBy("page_id", "digest").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("page_id").alias("of"), F.col("digest").alias("same")), "repeated")
    trained = _trained(ws, pages, sizes)

    rows = pages.join(small(copied), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    # A revisit's payload isn't written, so it doesn't travel.
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "n", "refers_to").withColumn("copy", F.lit(1).cast("long"))
    if not repeated.isEmpty():  # rows that say the same are counted before they travel
        same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same"))
        again = rows.join(small(repeated), same, "left_semi").groupBy("page_id", "url", "digest", "n", "refers_to").agg(F.first("html").alias("html"), F.count("*").alias("rows"))
        again = again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(rows.columns)
        rows = rows.join(small(repeated), same, "left_anti").unionByName(again)
    archives = min(max(1, -(-((total[0] or 0) + 500 * total[1]) // ARCHIVE_BYTES)), ARCHIVES)
    rows = rows.withColumn("archive", F.pmod(F.xxhash64("page_id", "url", "digest", "copy"), F.lit(archives)).cast("int"))
    manifest = ws.save(rows.repartitionById(archives, "archive").mapInArrow(_writer(folder, trained), "path string, records long, bytes long"), "manifest")
    ws.keep_only(manifest)
    return manifest


def _trained(ws: Workspace, pages: DataFrame, sizes: DataFrame) -> bytes:
    """The dictionary of DICTIONARY_PAGES pages, up to 20,000 characters of each."""
    chosen = ws.save(least_hashes(sizes.where("page_id is not null").select("page_id"), "page_id", DICTIONARY_PAGES), "sample")
    sample = pages.join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min(F.struct("url", F.substring("html", 1, 20_000).alias("html"))).alias("page"))
    samples = []
    for r in sample.select("page_id", "page.*").orderBy("page_id").collect():
        payload = r.html.encode()
        samples.append(record("response", r.page_id, r.url or "", hashlib.sha1(payload).hexdigest(), len(payload), payload, None))
    return dictionary(samples)


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, content) of every
    record in the archives of ``manifest``; tasks read an archive each, record by record. The digest of a
    response is computed from its content and must be what its header says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "content"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for paths in batches:
            for path in paths.column(0).to_pylist():
                with open_archive(path) as stream:
                    rows, held = [], 0
                    for fields, block in read_archive(stream):
                        revisit = fields["WARC-Type"] == "revisit"
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if not revisit and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
                            raise ValueError(f"a record of {path} is damaged")
                        refers = int(fields["WARC-Refers-To"].removeprefix(f"<{_URI}")[:-1]) if revisit else None
                        name = fields["WARC-Record-ID"][1:-1]
                        rows.append((int(name.removeprefix(_URI)) if name.startswith(_URI) else None, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], refers, block))
                        held += len(block)
                        if len(rows) >= 1000 or held > 8_000_000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, content binary"
    # A number is given, or adaptive execution would let one task read all archives.
    return manifest.select("path").repartition(max(1, min(manifest.count(), READERS))).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all ``pages`` to archives in the shared folder and read them back: (page_id,
    payload_bytes, payload_digest, record_type, refers_to), one row for each page."""
    ws = Workspace(spark, "warc")
    manifest = write_archives(spark, pages, f"{ws.folder}/archives", ws)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM (SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest, n) AS last
  FROM (SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages) a) b
"""
