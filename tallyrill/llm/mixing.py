"""Mixing sources to target weights along a time-varying curriculum.

Target words: each source's weight is a share of all words; a target stops at CAP times what
the source has, and the excess is shared again by weight until none is above (water-filling,
in closed form over the sources sorted by capacity for each unit of weight).

A source's words are a stream: its documents in the order of md5(doc_id), again and again, of which
the mix takes the first ``target`` words.  Where a document lies in the stream is a prefix sum over
(source, leading md5 digits) buckets, so a hot source is spread over many tasks.

Curriculum: a source's relative demand at time t in [0, 1] is piecewise linear (``SCHEDULES``, knots at
equal distances, cycled over the sources like the weights).  Its integral, scaled to the target, is
the source's cumulative token demand; inverting it at the stream position of a document's copy gives
the copy's training position, and range-sorting by position gives the training order.

Only DataFrame functions run.

Cases: null text has size 0; a document of size 0 takes nothing, and stands where its stream position says;
a null source is a source of its own, last in order; null doc_ids order as empty text; repeated rows are
documents of their own; without any words all targets are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.llm.workspace import Workspace, columns, require

WEIGHTS, CAP = (5, 2, 1), 3
#: Relative demand at equally spaced times, by the source's place modulo their number.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Rows that one bucket of a source's stream may hold on average.
ROWS_OF_BUCKET = 20_000


def words(text: Column) -> Column:
    """Number of runs of characters outside [\x20\x09-\x0D]."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, place, source_size, target) from (source, source_size).  Windows run over one row for each source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    out = sources.withColumn("place", place).withColumn("w", weight).withColumn("full", F.col("source_size") * cap)
    out = out.withColumn("r", F.col("full") / F.col("w"))
    by = Window.orderBy("r", "place")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0))
    out = out.withColumn("level", left / F.sum("w").over(after)).withColumn("rank", F.row_number().over(by))
    out = out.withColumn("stops", F.col("r") < F.col("level"))
    level = F.min_by(F.when(~F.col("stops"), F.col("level")), F.when(~F.col("stops"), F.col("rank"))).over(Window.partitionBy())
    return out.select("source", "place", "source_size", F.when(F.col("stops"), F.col("full").cast("double")).otherwise(level * F.col("w")).alias("target"))


def position(demand: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which the source's cumulative share of demand reaches ``demand`` (0 to 1)."""
    out = None
    for k, knots in enumerate(schedules):
        at = _inverse(demand, knots)
        out = at if out is None else F.when(F.pmod(place, F.lit(len(schedules))) == k, at).otherwise(out)
    return out


def _inverse(x: Column, knots: tuple[float, ...]) -> Column:
    """Inverse of the normalised integral of a positive piecewise linear function."""
    step = 1 / (len(knots) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(knots[:-1], knots[1:], strict=True)]
    total, done, out = sum(areas), 0.0, None
    for k, area in enumerate(areas):
        a, slope = knots[k], (knots[k + 1] - knots[k]) / step
        rest = F.greatest(x * total - done, F.lit(0.0))
        # a s + slope s^2 / 2 = rest, in the form that stays exact for slope 0
        s = 2 * rest / (a + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))))
        out = k * step + s if out is None else F.when(x * total >= done, k * step + s).otherwise(out)
        done += area
    return F.least(out, F.lit(1.0))


def mix(df: DataFrame, weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES, carried: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``df`` but ``text`` and of the mix: size, source_size, target, taken, and copies (position, words) in training order of the document.

    ``carried`` names further columns to keep, other than those; they order rows that are alike in doc_id and size.
    """
    if clash := {c.lower() for c in carried} & {"doc_id", "source", "size", "source_size", "target", "taken", "position", "copies"}:
        raise ValueError(f"columns that the mix makes itself: {', '.join(sorted(clash))}")
    ws = Workspace(df.sparkSession, "mixing")
    rows = require(df, "doc_id", "source", "text", *carried)
    extra = F.struct(*(F.col(c) for c in carried)) if carried else F.lit(None).cast("int")
    sized = ws.table(rows.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.xxhash64("text").alias("tie"), extra.alias("extra")), "sized")
    digits = max(1, math.ceil(math.log(max(1, sized.count() / ROWS_OF_BUCKET), 16)) + 1)
    sized = sized.withColumn("b", F.substring("h", 1, digits))
    # prefix sums: of whole buckets before, then within the bucket; nulls group together
    per_bucket = ws.table(sized.groupBy("source", "b").agg(F.sum("size").alias("bucket_size")), "buckets")
    sources = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    starts = per_bucket.withColumn("start", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("b")) - F.col("bucket_size"))
    starts = starts.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "bucket_size")
    starts = ws.table(starts, "starts").withColumnsRenamed({"source": "s", "b": "sb"})
    inner = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size", "tie", "extra").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(inner)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb")))
    first = F.col("start") + F.col("upto") - F.col("size")
    goal = F.floor(F.col("target") + 0.5)
    copy = F.array(*(F.struct(F.lit(e).alias("copy"), F.greatest(F.least(goal - e * F.col("source_size") - first, F.col("size")), F.lit(0)).alias("words"), (first + e * F.col("source_size")).alias("at")) for e in range(cap)))
    taken = F.filter(copy, lambda c: c["words"] > 0)
    copies = F.transform(taken, lambda c: F.struct(position(c["at"] / goal, F.col("place"), schedules).alias("position"), c["words"].alias("words")))
    out = placed.withColumn("copies", copies)
    total = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    at = F.when(goal > 0, position(F.least(first / goal, F.lit(1.0)), F.col("place"), schedules)).otherwise(0.0)
    return out.select("doc_id", "source", "size", "source_size", "target", total.alias("taken"), at.alias("position"), "copies", *(["extra.*"] if carried else []))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position."""
    return mixed.orderBy("position", "doc_id")


def curriculum(df: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents that the mix takes, all columns of ``df``, once for each copy, in training order.

    A copy of which less than half the words are taken (at most one document of each source
    and pass) is left out, a longer one is given whole; documents without words stay once.
    """
    ws = Workspace(df.sparkSession, "curriculum")
    # all columns travel in one struct, so that no name among them can clash
    row = df.select(F.struct(*columns(df)).alias("row"))
    rows = ws.table(row.withColumn("tie", F.xxhash64("row.text")).withColumn("key", F.monotonically_increasing_id()), "rows")
    mixed = mix(rows.select("row.doc_id", "row.source", "row.text", "tie", "key"), weights, cap, carried=("tie", "key"))
    whole = F.transform(F.filter("copies", lambda c: c["words"] * 2 >= F.col("size")), lambda c: c["position"])
    times = mixed.select("key", F.when(F.col("size") == 0, F.array("position")).otherwise(whole).alias("at")).filter(F.size("at") > 0)
    return rows.join(times, "key").select("row", "key", F.explode("at").alias("position")).orderBy("position", "row.doc_id", "key").select("row.*")
