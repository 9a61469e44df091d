"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is e times its words is wanted e times: the whole copies of
that are certain, and the rest is a fractional probability. Pairs of fractional documents then
exchange mass at random, in words, until one of the two is certain to be in or out; a document's
probability keeps its expectation and a source keeps its expected words exactly. In a source the
documents are dealt by a hash into groups of some 32; a fold over each group leaves one fractional
document at most, and these residuals are dealt into groups again, in a reduction tree, until one
is left for each source, which is drawn. A source's documents are rounded by size, the largest tenth
first, the smallest 4 % last; by what the larger ones miss, the smaller ones are wanted more or less
often (on average as often, unless a source would miss more than a few words; what one of them can't
take, the others do), so that a source commonly misses its target by less than the words of one of its
smallest documents.
All randomness is a hash of the documents' ids, so reruns agree. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Workspace, small

GROUP = 32
MOST_COPIES = 3.0
WEIGHTS = (1, 2, 3)
SEED = 20240506
ROUNDS = 12
#: Words that a source may miss before its smaller documents are wanted more or less often than on average.
SLACK = 16.0
#: Where a source's documents are parted by size.
CUTS = (0.9, 0.5, 0.15, 0.04)

#: One step of the fold: s.held is the fractional document so far, x the next one. What both names
#: stand for is bound step by step by transforms over one element.
_STEP = """
CASE WHEN s.held IS NULL THEN named_struct('held', x, 'done', s.done) ELSE
element_at(transform(transform(transform(array(named_struct('i', s.held, 'j', x,
    'up_i', (1 - s.held.p) * s.held.size, 'down_j', x.p * x.size,
    'down_i', s.held.p * s.held.size, 'up_j', (1 - x.p) * x.size,
    'draw', shiftrightunsigned(xxhash64({seed}, s.held.doc_id, s.held.size, x.doc_id, x.size), 11) / 9007199254740992D)),
  t -> named_struct('t', t, 'a', least(t.up_i, t.down_j), 'b', least(t.down_i, t.up_j),
    'rise', t.draw * (least(t.up_i, t.down_j) + least(t.down_i, t.up_j)) <= least(t.down_i, t.up_j))),
  v -> named_struct(
    'i', named_struct('doc_id', v.t.i.doc_id, 'size', v.t.i.size, 'rows', v.t.i.rows, 'whole', v.t.i.whole, 'p',
      CASE WHEN v.rise THEN if(v.t.up_i <= v.t.down_j, 1D, v.t.i.p + v.a / v.t.i.size) ELSE if(v.t.down_i <= v.t.up_j, 0D, v.t.i.p - v.b / v.t.i.size) END),
    'j', named_struct('doc_id', v.t.j.doc_id, 'size', v.t.j.size, 'rows', v.t.j.rows, 'whole', v.t.j.whole, 'p',
      CASE WHEN v.rise THEN if(v.t.down_j <= v.t.up_i, 0D, v.t.j.p - v.a / v.t.j.size) ELSE if(v.t.up_j <= v.t.down_i, 1D, v.t.j.p + v.b / v.t.j.size) END))),
  w -> if(w.i.p IN (0D, 1D), named_struct('held', w.j, 'done', concat(s.done, array(w.i))), named_struct('held', w.i, 'done', concat(s.done, array(w.j))))), 1)
END
"""
_UNIT = "struct<doc_id:bigint,size:bigint,rows:bigint,whole:bigint,p:double>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(ws: Workspace, sources: DataFrame) -> DataFrame:
    """(source, source_size, target) of ``sources`` (source, source_size). Weights 1, 2, 3 go round
    over the sources by code point, null last. A target is its source's weight times a common
    level, or three times the source's size if that is less; the level rises until the targets
    make up the sum of all sizes."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (at % len(WEIGHTS)) + 1)
    sources = ws.save(sources.withColumn("weight", weights).withColumn("most", F.col("source_size") * MOST_COPIES), "weighted")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / weight if weight else 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("most")
        n, taken, rest = sources.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, (total - taken) / rest
    return sources.select("source", "source_size", F.least(F.col("weight") * level, "most").alias("target"))


def _settled(ws: Workspace, units: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, size, rows, copies) of units (source, doc_id, size, rows, whole, p): the
    reduction tree. The last unit of a source is in or out by its probability."""
    whole = (F.col("whole") + F.col("p")).cast("long").alias("copies")
    columns = ["source", "doc_id", "size", "rows"]
    settled = F.col("p").isin(0.0, 1.0)
    parts, level, open_now = [], seed, ws.save(units, "open")
    while True:
        counts = ws.save(open_now.groupBy("source").agg(F.count("*").alias("n")), "counts")
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        level += 1
        lot = F.xxhash64(F.lit(level), "doc_id", "size")
        counted = open_now.join(small(counts.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        grouped = counted.groupBy("source", F.pmod(lot, F.ceil(F.col("n") / GROUP)).alias("lot")).agg(
            F.sort_array(F.collect_list(F.struct(lot.alias("order"), F.struct("doc_id", "size", "rows", "whole", "p").alias("unit")))).alias("units")
        )
        start = f"named_struct('held', CAST(NULL AS {_UNIT}), 'done', CAST(array() AS array<{_UNIT}>))"
        folded = F.expr(f"aggregate(transform(units, u -> u.unit), {start}, (s, x) -> {_STEP.format(seed=level)})")
        folded = ws.save(grouped.select("source", folded.alias("fold")).select("source", "fold.held", "fold.done"), "folded")
        parts.append(folded.select("source", F.inline("done")).select(*columns, whole))
        held = folded.select("source", "held.*")
        parts.append(held.where(settled).select(*columns, whole))
        open_now = ws.save(held.where(~settled), "open")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "doc_id", "size"), 11) / F.lit(float(1 << 53))
    out = open_now.select(*columns, (F.col("whole") + (draw < F.col("p")).cast("long")).alias("copies"))
    for part in parts:
        out = out.unionByName(part)
    return out


def _shifted(ws: Workspace, units: DataFrame, owed: DataFrame) -> DataFrame:
    """``units`` that are wanted (whole + p times) so much more often that each source has as many more
    expected words as it is ``owed`` (of, owed), evenly over words. What some can't take is spread over
    the others, which are as many as still can. At first each may move as far up as down, so that all
    are wanted as often on average; what is left then, if it is more than SLACK words, moves them
    anywhere between never and MOST_COPIES times each row."""
    most = F.col("rows") * MOST_COPIES
    columns = [c for c in units.columns if c not in ("whole", "p")]
    units = units.withColumn("wanted", F.col("whole") + F.col("p")).withColumn("reach", F.least(F.col("wanted"), most - F.col("wanted")))
    units = units.withColumn("low", F.col("wanted") - F.col("reach")).withColumn("high", F.col("wanted") + F.col("reach"))
    for bound, low, high in ((0.5, F.col("low"), F.col("high")), (SLACK, F.lit(0.0), most)):
        before = None
        for _ in range(ROUNDS):
            large = F.abs("owed") > bound
            left = owed.agg(F.sum(F.when(large, F.abs("owed")))).first()[0] or 0.0
            if not left or before is not None and left > before - bound:
                break
            before = left
            moved = units.join(small(owed), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("owed", F.when(large, F.col("owed")).otherwise(0.0))
            can = ((F.col("owed") > 0) & (F.col("wanted") < high)) | ((F.col("owed") < 0) & (F.col("wanted") > low))
            free = moved.where(can).groupBy(F.col("source").alias("at")).agg(F.sum(F.col("size") * F.col("rows")).alias("room"))
            free = small(ws.save(free, "free"))
            moved = moved.join(free, F.col("source").eqNullSafe(F.col("at")), "left")
            # A word of each row gets the same share.
            to = F.greatest(low, F.least(high, F.col("wanted") + F.col("owed") / F.col("room") * F.col("rows")))
            moved = ws.save(moved.withColumn("to", F.when(can, to).otherwise(F.col("wanted"))), "moved")
            gained = moved.groupBy(F.col("source").alias("at")).agg(F.sum((F.col("to") - F.col("wanted")) * F.col("size")).alias("gained"))
            owed = owed.join(gained, F.col("of").eqNullSafe(F.col("at")), "left").select("of", (F.col("owed") - F.coalesce("gained", F.lit(0.0))).alias("owed"))
            owed = ws.save(owed, "owed")
            units = moved.select(*columns, F.col("to").alias("wanted"), "low", "high")
    return units.select(*columns, F.floor("wanted").alias("whole"), (F.col("wanted") - F.floor("wanted")).alias("p"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size long, source_size long, target double, taken long) for each row of ``docs``
    (doc_id, text, source): the words of the text, those of its source, its source's target, and
    the words that the mix takes of it, repeats counted.

    Null and wordless texts have size 0 and are never taken. Null is a source of its own. Rows with
    equal doc_id, size and source count as one document that may be taken as often as all of them;
    what is taken is dealt evenly over its rows. If there are no words at all, targets are 0. An
    empty table gives an empty result; other columns are ignored.
    """
    ws = Workspace(spark, "mixing")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    units = ws.save(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goals = small(ws.save(targets(ws, sums), "targets"))
    goal = goals.withColumnRenamed("source", "of")
    units = units.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    wanted = F.when(F.col("source_size") > 0, F.col("rows") * (F.col("target") / F.col("source_size"))).otherwise(0.0)
    units = units.withColumn("wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0))
    units = units.select("source", "doc_id", "size", "rows", "source_size", F.floor("wanted").alias("whole"), (F.col("wanted") - F.floor("wanted")).alias("p"))

    never = units.where("size = 0 or source_size = 0").select("source", "doc_id", "size", "rows", F.lit(0).cast("long").alias("copies"))
    # Larger documents first; what they miss the target by is made up for by smaller ones.
    open_now = units.where("size > 0 and source_size > 0").drop("source_size")
    cuts = open_now.groupBy(F.col("source").alias("of")).agg(F.percentile_approx("size", list(CUTS)).alias("cuts"))
    cuts = small(ws.save(cuts, "cuts"))
    part = F.size(F.filter("cuts", lambda c: F.col("size") <= c))
    open_now = ws.save(open_now.join(cuts, F.col("source").eqNullSafe(F.col("of"))).withColumn("part", part).drop("of", "cuts"), "open")
    parts, owed = [never], None
    for n in range(len(CUTS) + 1):
        own = open_now.where(F.col("part") == n).drop("part")
        done = ws.save(_settled(ws, own if owed is None else _shifted(ws, own, owed), SEED + 100 * n), "done")
        parts.append(done)
        wished = own.groupBy("source").agg(F.sum((F.col("whole") + F.col("p")) * F.col("size")).alias("owed"))
        got = done.groupBy("source").agg((-F.sum(F.col("copies") * F.col("size"))).cast("double").alias("owed"))
        both = wished.select("source", F.col("owed").cast("double").alias("owed")).unionByName(got)
        both = both if owed is None else both.unionByName(owed.withColumnRenamed("of", "source"))
        owed = ws.save(both.groupBy(F.col("source").alias("of")).agg(F.sum("owed").alias("owed")), "owed")

    taken = parts[0]
    for part in parts[1:]:
        taken = taken.unionByName(part)
    each = taken.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.expr("copies div rows") + (F.col("row") <= F.col("copies") % F.col("rows")).cast("long")
    each = each.select("source", "doc_id", "size", (copies * F.col("size")).alias("taken"))
    return each.join(goal, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", "taken")
