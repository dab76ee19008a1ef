"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule is the point frac(i / golden ratio) mapped through the
cumulative target shares of the sources.  Slots are ranked per source.  The
documents of a source are shuffled by a hash and laid end to end; the line is
cut into blocks of equal token counts, and slot r of a source takes block r of
its line (from the start again in a second pass).  The last block is cut where
the source's target is reached.

Running sums and ranks are taken in two steps (inside hash buckets or chunks of
the schedule, then over the bucket totals), so that a source with a third of
all rows is spread over all tasks.  A slot finds its source by a join on the
cell of the unit line that holds its point; the sources never leave the tables.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; repeated rows are separate documents; an
empty table gives an empty result; a source without words has target 0; a
text of any length is cut into as many blocks as it fills; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

GOLDEN = 0.6180339887498949  # 1 / golden ratio, as the nearest double


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (3, 1, 2)  # repeating over the sources in order
    share: float = 1.5  # of all sizes
    most_repeats: int = 2
    block: int = 512  # tokens in a block
    chunk: int = 4096  # slots ranked together
    cells: int = 4096  # parts of the unit line by which slots find their sources
    bucket_digits: int = 3  # hex digits of the shuffling hash that make a bucket


def targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:  # noqa: B008
    """source, source_size, target and the source's interval [lo, hi) of the unit line; one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(params.weights)
    weight = F.element_at(F.array(*map(F.lit, params.weights)), k + 1)
    t = totals.withColumn("weight", weight).withColumn("most", params.most_repeats * F.col("source_size"))
    # shares by weight, held down at 'most': the sources are capped in the order of most / weight, and
    # the level of the rest is (total - capped) / (their weight); the first level that caps no more holds
    by = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (params.share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("most"))
    held = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(held, F.lit(0.0)) * F.col("weight")))
    total = F.sum("target").over(whole)
    upto = F.sum("target").over(order)
    t = t.withColumn("hi", F.when(total > 0, upto / total).otherwise(0.0)).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    return t.select("source", "source_size", "target", "lo", "hi", F.row_number().over(order).alias("sid"))


def schedule(plan: DataFrame, n_slots: int, params: MixParams = MixParams()) -> DataFrame:  # noqa: B008
    """sid, rank (from 0 in each source) and slot; every slot of the schedule. ``plan``: the targets, one row per source."""
    point = (F.col("slot") + 0.5) * GOLDEN
    slots = plan.sparkSession.range(n_slots).select(F.col("id").alias("slot")).withColumn("u", point - F.floor(point))
    # the unit line in cells: an interval [lo, hi) lies in a few, a point in one, and they meet by the cell's number
    last = F.lit(params.cells - 1)
    cell = lambda x: F.least(F.floor(F.col(x) * params.cells), last)
    spans = plan.filter("lo < hi").select("sid", "lo", F.when(F.col("hi") < 1, F.col("hi")).otherwise(2.0).alias("hi"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    slots = slots.withColumn("cell", cell("u")).join(spans, "cell").filter("lo <= u and u < hi").select("slot", "sid").withColumn("chunk", F.floor(F.col("slot") / params.chunk))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside)
    per = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(per.select("sid", "chunk", before.alias("before")), ["sid", "chunk"]).select("sid", (F.col("before") + F.col("inside")).alias("rank"), "slot")
    # a source's count differs from its share by the discrepancy of the points (logarithmic): what a source is short of follows at the end
    have = per.groupBy("sid").agg(F.sum("n").alias("have"))
    short = plan.join(have, "sid", "left").select("sid", F.coalesce("have", F.lit(0).cast("long")).alias("have"), F.ceil(F.round("target") / params.block).alias("need")).filter("have < need")
    offset = F.coalesce(F.sum(F.col("need") - F.col("have")).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = short.withColumn("offset", offset).select("sid", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"), "have", "offset")
    return ranked.unionByName(late.select("sid", "rank", (F.col("rank") - F.col("have") + F.col("offset") + n_slots).alias("slot")))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:  # noqa: B008
    """doc_id, size, source_size, target and taken of every document, and its places in the schedule: n_slots, first_slot and a digest of all of them.

    The digest is of ``slot:first word:words``, comma-joined by slot (then first word): what a trainer reads in which order.
    """
    got = take(docs.select("doc_id", "source", shared.n_words(F.col("text")).alias("size")), params)
    places = F.array_join(F.transform("slots", lambda s: F.concat_ws(":", s["slot"].cast("string"), s["first"].cast("string"), s["n"].cast("string"))), ",")
    return got.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.coalesce(F.when(F.col("slots").isNotNull(), F.size("slots")), F.lit(0)).cast("long").alias("n_slots"), F.get("slots", F.lit(0))["slot"].alias("first_slot"), shared.hex_sha(F.coalesce(places, F.lit(""))).alias("slots_sha256"),
    )


def take(rows: DataFrame, params: MixParams = MixParams()) -> DataFrame:  # noqa: B008
    """``rows``: doc_id, source, size. Adds source_size, target, taken and slots: [(slot, first word, words)] of the row."""
    shuffled = F.sha2(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string")), 256)
    rows = shared.spill(rows.withColumn("h", shuffled).withColumn("rid", F.monotonically_increasing_id()), "sizes")
    plan = shared.spill(targets(rows, params), "targets")
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    # each row's place on its source's line, from bucket totals and a running sum inside the bucket
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select(rows["*"], *(plan[c] for c in ("source_size", "target", "sid")))
    rows = rows.withColumn("bucket", F.substring("h", 1, params.bucket_digits))
    in_bucket = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "rid")
    placed = rows.withColumn("inside", F.sum("size").over(in_bucket) - F.col("size"))
    per = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(per.select("sid", "bucket", before.alias("before")), ["sid", "bucket"]).withColumn("lo", F.col("before") + F.col("inside")).drop("before", "inside", "bucket", "h")
    placed = shared.spill(placed.withColumn("hi", F.col("lo") + F.col("size")), "line")
    slots = schedule(plan, math.ceil(total / params.block), params)
    # slot r takes the words [r * block, (r + 1) * block) of the source's line, laid twice, up to the target
    line = plan.select("sid", F.col("source_size").alias("size"), F.round("target").cast("long").alias("goal"))
    at = slots.join(line, "sid").withColumn("from", F.col("rank") * params.block).filter("from < goal").withColumn("upto", F.least(F.col("from") + params.block, F.col("goal")))
    # a slot across the end of the line is two pieces
    turn = F.floor(F.col("from") / F.col("size"))
    at = at.withColumn("cut", (turn + 1) * F.col("size")).withColumn("turn", turn)
    whole = F.struct((F.col("from") - F.col("turn") * F.col("size")).alias("a"), (F.least("upto", "cut") - F.col("turn") * F.col("size")).alias("b"))
    rest = F.struct(F.lit(0).cast("long").alias("a"), (F.col("upto") - F.col("cut")).alias("b"))
    pieces = at.select("sid", "slot", F.explode(F.when(F.col("upto") > F.col("cut"), F.array(whole, rest)).otherwise(F.array(whole))).alias("p")).select("sid", "slot", "p.a", "p.b")
    grid = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / params.block), F.floor((F.col(hi) - 1) / params.block))).alias("cell")
    pieces = pieces.select("*", grid("a", "b"))
    cells = placed.filter("size > 0").select("rid", "sid", "lo", "hi", grid("lo", "hi"))
    got = cells.join(pieces, ["sid", "cell"]).withColumn("x", F.greatest("lo", "a", F.col("cell") * params.block)).withColumn("y", F.least("hi", "b", (F.col("cell") + 1) * params.block)).filter("x < y")
    # a piece that crosses cells is one again
    got = got.groupBy("rid", "slot", "a").agg(F.min(F.col("x") - F.col("lo")).alias("first"), F.sum(F.col("y") - F.col("x")).alias("n"))
    got = got.groupBy("rid").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list(F.struct("slot", "first", "n"))).alias("slots"))
    return placed.join(got, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
