"""Token counts of texts with a cache of what has been counted before.

A text's key is the SHA-256 of its normalised content (a null becomes the empty text; nothing else
may change, or the count could) together with the digest of the tokenizer's file and library
version. Counts stored under the key are joined; of what is missing every distinct text is encoded
once, and the new counts are appended to the cache, a Parquet table that later calls read.

Only texts whose content occurs more than once travel over the network, to become distinct; a map-
side aggregation leaves one of each per task. All other misses are encoded where they are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, exists, shared_folder, small

LIMIT = 512
#: Encoded words that a Python worker remembers (some 100 MB at most).
REMEMBERED = 400_000

_loaded: dict = {}


class Counter:
    """Counts tokens of texts just as the tokenizer does, without added special tokens.

    A byte-level BPE whose pre-tokenizer splits off ``' ?word'`` never joins anything over a single
    space between two characters that aren't white space, so its count is the sum over the pieces
    between such spaces, each with its space in front; pieces are remembered. That holds only for
    such tokenizers and pieces without special strings; all else is encoded as a whole.
    """

    def __init__(self, path: str):
        self.kind = os.path.splitext(path)[1]
        if self.kind == ".json":
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            import json

            with open(path) as f:
                told = json.load(f)
            steps = told.get("pre_tokenizer") or {}
            self.split = not told.get("normalizer") and steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space")
            self.special = [x["content"] for x in told.get("added_tokens") or []]
        elif self.kind == ".model":
            import sentencepiece

            self.library, self.split, self.special = sentencepiece.SentencePieceProcessor(model_file=path), False, []
        else:
            raise ValueError(f"neither .json nor .model: {path}")
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        if self.kind == ".model":
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.whole(texts)
        known, out, pieces = self.known, [0] * len(texts), {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self.whole([text])[0]
                continue
            # A piece that ends in white space, or is empty, is joined with what follows it.
            parts = text.split(" ")
            first, rest = parts[0], parts[1:]
            if not first or first[-1].isspace() or any(not p or p[-1].isspace() or p[0].isspace() for p in rest):
                merged = [first]
                for p in rest:
                    before = merged[-1]
                    if not before or before[-1].isspace() or not p or p[0].isspace():
                        merged[-1] = f"{before} {p}"
                    else:
                        merged.append(" " + p)
                pieces[i] = merged
            else:
                pieces[i] = [first, *[" " + p for p in rest]]
        missing = list({p for of in pieces.values() for p in of if p not in known})
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = list({p for of in pieces.values() for p in of})
        for at in range(0, len(missing), 5000):
            some = missing[at : at + 5000]
            known.update(zip(some, self.whole(some), strict=True))
        for i, of in pieces.items():
            out[i] = sum(map(known.__getitem__, of))
        return out


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _loaded:
            _loaded[path] = Counter(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                n = _loaded[path](batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return run


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text).

    ``tokenizer`` is a file that every executor has; ``cache`` a folder that all share, by default
    a new one. A null or empty text has 0 tokens. Repeated texts are counted once and repeated rows
    each get their row. An empty table gives an empty result; other columns are ignored.
    """
    ws = Workspace(spark, "tokens")
    cache, stamp = cache or f"{shared_folder(spark)}/token-cache-{os.urandom(8).hex()}", version(tokenizer)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = docs.withColumn("content", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))
    keys = ws.save(keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    schema = "tokenizer string, content binary, n_tokens long"
    stored = spark.read.schema(schema).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], schema)
    stored = stored.where(F.col("tokenizer") == stamp).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    stored = ws.save(stored, "stored")

    # What is to do of each content that occurs more than once or is in the cache; the rest is encoded in place.
    seen = keys.groupBy("content").agg(F.count("*").alias("n")).join(stored, "content", "left").where("n > 1 or n_tokens is not null")
    seen = ws.save(seen.select("content", F.col("n_tokens").isNotNull().alias("counted")), "seen")
    marked = keyed.select("content", "text").join(small(seen), "content", "left")
    once = marked.where("counted is null").select("content", "text")
    again = marked.where("counted = false").groupBy("content").agg(F.first("text").alias("text"))
    counts = once.union(again).mapInArrow(_counts(tokenizer), "content binary, n_tokens long")
    new = ws.save(counts, "new")
    new.select(F.lit(stamp).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)

    every = stored.union(new)
    out = keys.join(every, "content", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
