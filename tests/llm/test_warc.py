from __future__ import annotations

import hashlib
import io

import pytest
import zstandard

from sagebrook.llm import warc
from sagebrook.llm.common import Workspace

PAGES = "page_id long, url string, html string, digest string, first long"


def expected(rows):
    out, last = [], {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, i), i)
    for i, _, html in rows:
        data = (html or "").encode()
        refers = last.get(html) if len(data) >= 1000 and last.get(html) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    big, other = "é<p>" * 400, "x" * 1000
    rows = [(i, f"http://a/{i}", f"<html><p>page {i} of many, all of one kind</p>{'y' * i}</html>") for i in range(60)]
    rows += [(100, "u", big), (101, "u", big), (99, "u", big), (103, "u", "x" * 999), (104, "u", "x" * 999), (105, None, other), (106, "a\r\nb", other)]
    rows += [(107, "u", None), (108, "u", ""), (109, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (110, "u", "z" * 300_000), (110, "v", "z" * 300_000), (None, "u", big)]
    rows += [(None, None, None), (None, "u", "q" * 1500), (None, "u", "q" * 1500), (101, "u", big), (99, "u", big), (99, "u", big)] + [(200, "u", "r" * 1200)] * 40 + [(None, "u", "<p>")] * 30
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], PAGES)
    assert sorted(map(tuple, warc.round_trip(spark, df).collect()), key=repr) == expected(rows)
    ws = Workspace(spark, "test")
    manifest = warc.write_archives(spark, df, f"{ws.folder}/a", ws)
    read = warc.read_archives(manifest)
    texts = {r.page_id: bytes(r.content).decode() for r in read.collect() if r.record_type == "response" and r.page_id is not None}
    assert all(texts[i] == (h or "") for i, _, h in rows if i in texts) and manifest.count() > 1
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and read.rdd.getNumPartitions() == manifest.count()


def test_archives_are_frames_behind_a_dictionary(spark):
    ws = Workspace(spark, "test")
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50, "", 1) for i in range(30)], PAGES)
    path = warc.write_archives(spark, df, f"{ws.folder}/a", ws).first().path
    with warc.open_archive(path) as f:
        data = f.read()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    n = int.from_bytes(data[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompressobj()
    fields, block = warc.parse(reader.decompress(data[8 + n :]))
    assert reader.eof and reader.unused_data and fields["WARC-Type"] == "response" and block.startswith(b"<p>")


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"not an archive at all")))
    record = warc.record("response", 1, "u", "d", 3, b"abc", None)
    with pytest.raises(ValueError):
        warc.parse(record[:-1])


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).collect() == []
