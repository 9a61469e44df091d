"""Benchmark decontamination: which documents contain a benchmark item.

A size-partitioned MinHash containment search. Items are partitioned by the logarithm of their
number of shingles. In the partitions below 2**WHOLE shingles, all of an item's shingles are its
coordinates. In each larger one an item has COORDINATES of them: under each of so many hash
permutations the shingle with the least value. The chance that a document holds such a shingle is
exactly the share of the item's shingles that the document holds, however long it is. So the
documents' shingles are looked up in the items' coordinates. A document, all rows of its doc_id
together, is a candidate if it has three quarters of an item's coordinates in a partition of the
first kind, or HITS of them in one of the second: there, at a containment of 0.75, an item is missed
with the chance that a binomial (24, 0.75) variable stays under 6, which is 8e-9.

Candidates are then confirmed by exact containment: of the item's distinct shingles, at least 75 of
100 are in the whole document. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small

WIDTH = 5
WHOLE, COORDINATES, HITS = 4, 24, 6
PERCENT = 75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; of a null or blank text none."""
    inner = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def shingles(text: Column) -> Column:
    """Hashes of all five-word shingles of a text in order; of a shorter text that of its whole."""

    def grams(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WIDTH)]))
        return F.when(n >= WIDTH, each).when(n > 0, F.array(F.xxhash64(F.lit("short"), h))).otherwise(F.array().cast("array<long>"))

    # The array of hashes is bound to a name by a transform over one element, so that it is made once.
    hashed = F.array(F.transform(words(text), lambda w: F.xxhash64(w)))
    return F.element_at(F.transform(hashed, grams), 1)


def contained_items(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item long, n_common long, containment double) for every document of
    ``docs`` (doc_id, text) that holds at least 75 of 100 of an item's distinct shingles; ``items``
    is (item_id, text).

    Rows that share a doc_id count as one document, those that share an item_id as one item.
    Rows with a null id, and null or wordless texts, match nothing. An item of under five words is
    one shingle, found only in documents that consist of just these words. Empty tables give an
    empty result; other columns are ignored.
    """
    ws = Workspace(spark, "decontaminate")
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null").select("item_id", F.explode(shingles(F.col("text").cast("string"))).alias("shingle")).distinct()
    items = ws.save(items, "items")
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_item"))
    sized = ws.save(items.join(sizes, "item_id").withColumn("partition", F.floor(F.log2("n_item")).cast("int")), "sized")

    entire = sized.where(F.col("partition") < WHOLE).select("item_id", "n_item", "shingle", F.lit(1).cast("long").alias("weight"), F.ceil(F.col("n_item") * PERCENT / 100).cast("int").alias("needed"))
    coordinate = F.explode(F.sequence(F.lit(1), F.lit(COORDINATES)))
    larger = sized.where(F.col("partition") >= WHOLE).withColumn("k", coordinate)
    least = larger.groupBy("item_id", "n_item", "k").agg(F.min_by("shingle", F.xxhash64("k", "shingle")).alias("shingle"))
    least = least.groupBy("item_id", "n_item", "shingle").agg(F.count("*").alias("weight")).withColumn("needed", F.lit(HITS))
    sketch = ws.save(entire.unionByName(least), "sketch")

    rows = docs.select("doc_id", F.explode(shingles(F.col("text"))).alias("shingle"))
    hits = rows.join(small(sketch), "shingle")
    hits = hits.groupBy("doc_id", "item_id", "needed", "shingle").agg(F.max("weight").alias("weight"))
    likely = hits.groupBy("doc_id", "item_id", "needed").agg(F.sum("weight").alias("hits")).where(F.col("hits") >= F.col("needed"))
    likely = ws.save(likely.select("doc_id", "item_id"), "likely")

    wanted = ws.save(likely.select("doc_id").distinct(), "wanted")
    held = docs.join(small(wanted), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(shingles(F.col("text")))).alias("shingle"))
    pairs = likely.join(small(sized.select("item_id", "n_item", "shingle")), "item_id")
    common = held.join(pairs, ["doc_id", "shingle"]).select("doc_id", "item_id", "n_item", "shingle").distinct()
    counts = common.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_common"))
    exact = counts.where(F.col("n_common") * 100 >= F.col("n_item") * PERCENT)
    return exact.select("doc_id", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


CONTAINED_SQL = """
WITH split AS (
  SELECT id, kind, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id AS id, 'd' AS kind, text FROM documents UNION ALL SELECT item_id, 'i', text FROM benchmark) t
  WHERE id IS NOT NULL
), grams AS (
  SELECT DISTINCT id, kind, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS g
  FROM split
), items AS (
  SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_item FROM grams WHERE kind = 'i'
)
SELECT d.id AS doc_id, item_id, n_item, count(*) AS n_common, count(*) / n_item AS containment
FROM grams d JOIN items USING (g) WHERE kind = 'd'
GROUP BY d.id, item_id, n_item HAVING count(*) * 100 >= n_item * 75
"""
