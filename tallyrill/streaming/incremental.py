"""Structured Streaming: late or corrected bars flow through upsert and tail recomputation.

No watermark drops late rows: a micro-batch names, per symbol, its earliest changed bar, and
features are recomputed from there with 20 bars of history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.operators.engine import Engine, classify
from tallyrill.plans.market import recomputed


def newest(batch: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """One row for each key: the one of the largest ``order``; of equal ones, or without it, the largest row."""
    rest = F.struct(*([F.col(order)] if order else []), *(F.col(c) for c in batch.columns if c not in key and c != order))
    best = batch.groupBy(*key).agg(F.max(rest).alias("best"))
    return best.select(*key, "best.*").select(*(c for c in batch.columns if c != order))


def apply_batch(engine: Engine, batch: DataFrame, bars: str = "bars", features: str = "features", marks: str = "watermarks", order: str | None = None) -> dict[str, int]:
    """Upsert bars (symbol, ts, open, high, low, close, volume), recompute tails, advance watermarks; counts by class.

    ``order`` names a further column that tells which of several versions of one bar is the newest.
    """

    def work(tx):
        spec = tx.spec(bars)
        latest = newest(batch, spec.key, order)
        marked = tx._kept(classify(tx.frame(bars), latest, spec.key))
        counts = {r.merge_class: r["count"] for r in marked.groupBy("merge_class").count().collect()}
        moved = marked.filter("merge_class <> 'unchanged'")
        tx.put(bars, moved.drop("merge_class"))
        since = moved.groupBy("symbol").agg(F.min("ts").alias("changed_ts"))
        rows = tx._kept(recomputed(tx.frame(bars), since))
        counts["features"] = tx.put(features, rows).rows_affected
        old = tx.frame(marks).select("symbol", F.col("last_ts").alias("old"))
        ahead = rows.groupBy("symbol").agg(F.max("ts").alias("ts")).join(old, "symbol", "left")
        tx.put(marks, ahead.select("symbol", F.greatest("ts", F.coalesce("old", "ts")).alias("last_ts")))
        return counts

    return engine.run(work)


def start(engine: Engine, stream: DataFrame, checkpoint: str, **names):
    """A streaming query that applies every micro-batch once."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_batch(engine, batch, **names)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_bars(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily counts and extremes from a stream of events, with a watermark for append output."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.min("value").alias("low"))
