"""Language identification: words first, then ever shorter character n-grams.

Training counts the words of all labelled documents for each language, and the n-grams of these
words with their edges marked, from MOST characters down to one. Nothing is dropped: every label
with a word is a language, and every word and n-gram is an entry, with the log of its frequency in
each language; a language without it has FLOOR. A text's score in a language is the sum over its
words: of a known word its own log frequency, of an unseen one the mean over its longest n-grams of
which any is known.

Workers hold the commonest words, as many as fit into ENTRIES entries, and add up what these say
where they read a text. A text's other words, each once, go over the network: the distinct ones
among them are looked up in the whole table, or backed off, by joins, and their scores are added.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, small

MOST = 4
#: What is added to each frequency before its log is taken, so that unknown words have one.
LEAST = 1e-9
FLOOR = math.log(LEAST)
#: Entries (word, language) of the words that a worker holds; some 100 MB.
ENTRIES = 400_000
UNKNOWN = "und"
#: Entries that a Python worker holds before it passes counts on.
HELD = 300_000
_RUNS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters (Unicode's categories L) in lower case."""
    found = _RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # Other characters that count as parts of words are numbers like ½ or Ⅷ.
    split = ("".join(c if c.isalpha() else " " for c in w).split() for w in found)
    return list(chain.from_iterable(split))


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _rows(held: dict[str, Counter], n: int) -> Iterator[pa.RecordBatch]:
    """What is held as rows, which are then held no more."""
    for lang, of in held.items():
        if of:
            columns = [pa.array([lang] * len(of)), pa.array([n] * len(of), pa.int32()), pa.array(list(of)), pa.array(list(of.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "gram", "count"])
    held.clear()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, held.values())) > HELD:
                yield from _rows(held, 0)
    yield from _rows(held, 0)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all lengths, of (lang, word, count)."""
    held: list[dict[str, Counter]] = [{} for _ in range(MOST + 1)]
    for batch in batches:
        for lang, word, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            for n in range(1, MOST + 1):
                of = held[n].setdefault(lang, Counter())
                for g in grams(word, n):
                    of[g] += c
        if sum(len(of) for x in held for of in x.values()) > HELD:
            for n in range(1, MOST + 1):
                yield from _rows(held[n], n)
    for n in range(1, MOST + 1):
        yield from _rows(held[n], n)


def _cut(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, gram) for all n-grams of (id, word)."""
        for batch in batches:
            ids, made = [], []
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = grams(w, n)
                ids += [i] * len(own)
                made += own
                if len(made) > 20_000:
                    yield _pairs(ids, made)
                    ids, made = [], []
            yield _pairs(ids, made)

    return run


def _pairs(ids: list[int], made: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.string())], names=["id", "gram"])


def _narrow(saved: DataFrame) -> DataFrame:
    """A saved table with ``known``, marked for broadcast if it has few entries."""
    return F.broadcast(saved) if (saved.agg(F.sum(F.size("known"))).first()[0] or 0) <= BROADCAST_ROWS else saved


class Words:
    """What words say of languages: how far above FLOOR their log frequency is, by places in the
    list of languages. Adds that up over texts."""

    def __init__(self, langs: int, known: list[str], ends: np.ndarray, places: np.ndarray, above: np.ndarray):
        self.langs, self.of = langs, {w: i for i, w in enumerate(known)}
        self.starts, self.lens = ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0)
        self.places, self.above = places, above

    def sums(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Counter]]:
        """For each text: (text, place, sum) of the languages that know any of the words held here,
        and the other words with how often each occurs."""
        get, rest = self.of.get, []
        ids, whose = [], []
        for i, of in enumerate(texts):
            found = [get(w, -1) for w in of]
            rest.append(Counter(w for w, k in zip(of, found, strict=True) if k < 0) if -1 in found else Counter())
            found = [k for k in found if k >= 0]
            ids += found
            whose += [i] * len(found)
        flat, row = np.array(ids, np.int64), np.array(whose, np.int64)
        lens = self.lens[flat]
        at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(self.starts[flat], lens)
        cells = np.repeat(row, lens) * self.langs + self.places[at]
        totals = np.bincount(cells, self.above[at], minlength=1)
        used = np.flatnonzero(totals)
        return used // self.langs, used % self.langs, totals[used], rest


def train(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Learn from rows of ``docs`` (text, lang) with a lang: the languages (place, lang) by code point, and as
    (gram, seen, known) the words and (with n) the n-grams: how often each is seen, and for each
    language that has it, (place, above), its place and its log frequency above FLOOR."""
    schema = "lang string, n int, gram string, count long"
    own = docs.where("lang is not null").select("lang", "text").mapInArrow(_count_words, schema).groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    own = ws.save(own, "words")
    parts = own.mapInArrow(_count_grams, schema).groupBy("n", "lang", "gram").agg(F.sum("count").alias("count"))
    parts = ws.save(parts, "grams")
    langs = own.groupBy("lang").count().select((F.row_number().over(Window.orderBy("lang")) - 1).alias("place"), "lang")
    place = ws.save(langs, "langs")

    def entries(counts: DataFrame, *n: str) -> DataFrame:
        totals = ws.save(counts.groupBy(*n, "lang").agg(F.sum("count").alias("total")).join(small(place), "lang"), "totals")
        above = F.log(F.col("count") / F.col("total") + LEAST) - FLOOR
        found = counts.join(small(totals), [*n, "lang"]).groupBy(*n, "gram").agg(F.sum("count").alias("seen"), F.collect_list(F.struct("place", above.alias("above"))).alias("known"))
        return ws.save(found, "entries")

    return place, entries(own), entries(parts, "n")


def common(entries: DataFrame, most: int) -> int:
    """The least power of two so that words seen as often hold no more than so many entries."""
    by = entries.groupBy(F.floor(F.log2("seen")).cast("int").alias("power")).agg(F.sum(F.size("known")).alias("entries")).collect()
    held, least = 0, 64
    for power, n in sorted(((r.power, r.entries) for r in by), reverse=True):  # 64 rows at most
        held += n
        if held > most:
            break
        least = power
    return 1 << min(least, 62)


def _held(entries: DataFrame, least: int, langs: int) -> Words:
    table = entries.where(F.col("seen") >= least).select("gram", "known").toArrow()
    known = table["known"].combine_chunks()
    flat = known.flatten()
    return Words(langs, table["gram"].to_pylist(), np.cumsum(np.array(pc.list_value_length(known), np.int64)), flat.field("place").to_numpy().astype(np.int64), flat.field("above").to_numpy())


def _texts(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, words, sums, rest) of (row, text): how many words there are, what those held here
        say, and the others."""
        sums, rest = pa.list_(pa.struct([("place", pa.int32()), ("above", pa.float64())])), pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                of = [words(t) for t in batch.column(1).to_pylist()]
                row, place, total, others = held.value.sums(of)
                ends = np.searchsorted(row, np.arange(len(of) + 1)).astype(np.int32)
                local = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(total)], ["place", "above"]))
                far = pa.array([[{"word": w, "times": c} for w, c in x.items()] for x in others], rest)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in of], pa.int64()), local.cast(sums), far], names=["row", "words", "sums", "rest"])

    return run


def looked_up(ws: Workspace, wanted: DataFrame, own: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, known) of ``wanted`` (word): the entry of a known word; the mean over the longest
    n-grams of another one, of which any is known."""
    out = wanted.join(own.select(F.col("gram").alias("word"), "known"), "word")
    rest = wanted.join(own.select(F.col("gram").alias("word")), "word", "left_anti")
    unseen = rest = ws.save(rest.withColumn("id", F.monotonically_increasing_id()).select("id", "word"), "unseen")
    backed = []
    for n in range(MOST, 0, -1):
        of = ws.save(parts.where(F.col("n") == n).select("gram", "known"), f"of{n}")
        hit = ws.save(rest.mapInArrow(_cut(n), "id long, gram string").join(_narrow(of), "gram").select("id", "known"), f"hit{n}")
        used = hit.groupBy("id").agg(F.count("*").alias("used"))
        adds = hit.select("id", F.inline("known")).groupBy("id", "place").agg(F.sum("above").alias("above")).join(used, "id")
        backed.append(adds.groupBy("id").agg(F.collect_list(F.struct("place", (F.col("above") / F.col("used")).alias("above"))).alias("known")))
        rest = ws.save(rest.join(hit.select("id").distinct(), "id", "left_anti"), f"rest{n}")
        if rest.isEmpty():
            break
    return out.unionByName(unseen.join(reduce(DataFrame.union, backed), "id").select("word", "known"))


def identify(spark: SparkSession, docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang).

    Rows with crc32(doc_id) mod 3 = 1 are held out: never learnt from. lang_pred is a learnt label,
    which every lang of a learnt row with a word is, however rare, or ``und`` with score 0 for null
    texts, texts without a letter, and if there was nothing to learn from. Of equal languages it is
    the first by code point. score is the share of the best language, evidence growing with the root
    of the number of words, as neighbouring words aren't independent. A null doc_id isn't held out
    and isn't learnt from. Repeated rows each get their row; an empty table gives an empty result;
    other columns are ignored. ``entries`` bounds what workers hold and changes no result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    held_out = F.coalesce(part == 1, F.lit(False)).alias("held_out")
    ws = Workspace(spark, "language")
    names, own, parts = train(ws, docs.where(part != 1))
    langs = names.count()
    if not langs:
        return docs.select("doc_id", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = spark.sparkContext.broadcast(_held(own, common(own, entries), langs))
    row = "row long, doc_id long, held_out boolean"
    schema = f"{row}, words long, sums array<struct<place:int,above:double>>, rest array<struct<word:string,times:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for made in _texts(held)(iter([batch.select(["row", "text"])])):
                same = batch.slice(at, made.num_rows)
                at += made.num_rows
                yield pa.RecordBatch.from_arrays([made.column(0), same.column("doc_id"), same.column("held_out"), *made.columns[1:]], names=["row", "doc_id", "held_out", "words", "sums", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out, "text")
    read = ws.save(rows.mapInArrow(run, schema), "texts")
    rest = read.select("row", F.inline("rest"))
    adds = ws.save(looked_up(ws, ws.save(rest.select("word").distinct(), "wanted"), own, parts), "adds")
    ws.keep_only(read, adds, names)
    far = rest.join(_narrow(adds), "word").select("row", "times", F.inline("known")).select("row", "place", (F.col("times") * F.col("above")).alias("above"))
    sums = read.select("row", F.inline("sums")).union(far).groupBy("row", "place").agg(F.sum("above").alias("above"))
    # A text has no more sums than there are languages.
    scores = sums.groupBy("row").agg(F.collect_list("above").alias("every"), F.min(F.struct((-F.round("above", 9)).alias("less"), "place")).alias("best"))
    out = read.select("row", "doc_id", "held_out", "words").join(scores, "row", "left")
    every = F.coalesce("every", F.array().cast("array<double>"))
    most, root = F.coalesce(F.array_max(every), F.lit(0.0)), F.sqrt(F.greatest("words", F.lit(1)))
    odds = F.aggregate(every, F.lit(0.0), lambda s, x: s + F.exp((x - most) / root)) + (F.lit(langs) - F.size(every)) * F.exp(-most / root)
    out = out.select("doc_id", "held_out", "words", F.coalesce("best.place", F.lit(0)).alias("place"), (1 / odds).alias("score")).join(small(names), "place", "left")
    none = F.col("words") == 0
    return out.select("doc_id", "held_out", F.when(none, UNKNOWN).otherwise(F.col("lang")).alias("lang_pred"), F.when(none, 0.0).otherwise(F.col("score")).alias("score"))
