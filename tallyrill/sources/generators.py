"""Made bars with fixed values, for demonstrations and acceptance tests; never market history."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import calendar
from tallyrill.functions.scalars import scale_price

#: Fixed values of the three-regime series.
FIRST, BARS, SEED, START = "2022-01-03", 600, 42, 100.0
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
RISE, FALL, FALLING = 0.0008, -0.0006, range(200, 400)
NOISE, SWING, PERIOD, SPREAD = 0.012, 0.004, 9, 0.003
#: Fixed values of the sine series: first time (2026-01-02 21:00 UTC) and number of bars.
SINE_FIRST, SINE_BARS = 1_767_387_600, 60


def _finished(df: DataFrame, symbol: str, interval: str, source: str) -> DataFrame:
    prices = [scale_price(F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    out = df.select(F.lit(symbol).alias("symbol"), F.lit(interval).alias("interval"), "ts", *prices, "volume", F.lit(source).alias("source"))
    return out.withColumn("adjusted_close", F.col("close"))


def regime_bars(spark: SparkSession, before: dt.date | None = None) -> DataFrame:
    """600 daily bars on exchange sessions, rising, falling, rising, with noise of a 64-bit linear congruential sequence.

    ``before`` moves them to the last 600 sessions before that day.  Each price follows from the one before, so the driver makes the 600 rows.
    """
    if before is None:
        days = calendar.sessions(spark, FIRST, "2024-12-31").orderBy("day").limit(BARS)
    else:
        days = calendar.sessions(spark, str(before - dt.timedelta(days=4 * 366)), str(before - dt.timedelta(days=1))).orderBy(F.desc("day")).limit(BARS)
    times = [r.ts for r in days.select((F.datediff("day", F.lit("1970-01-01")) * 86_400).alias("ts")).orderBy("ts").collect()]
    rows, state, close = [], SEED, START
    for i, ts in enumerate(times):
        state = (state * MULTIPLIER + INCREMENT) % 2**64
        drift = FALL if i in FALLING else RISE
        noise = ((state >> 11) / 2**53 - 0.5) * NOISE
        start, close = close, close * math.exp(drift + SWING * math.sin(i / PERIOD) + noise)
        rows.append((ts, start, max(start, close) * (1 + SPREAD), min(start, close) * (1 - SPREAD), close, 1_000_000 + i % 17 * 25_000))
    made = spark.createDataFrame(rows, "ts long, open double, high double, low double, close double, volume long")
    return _finished(made, "SYNTH", "1d", "synthetic-phase3-v1" if before is None else "synthetic-analyst-v1")


def sine_bars(spark: SparkSession, symbol: str, interval: str = "1d") -> DataFrame:
    """60 bars, a day apart, on a rising sine."""
    i = F.col("id").cast("double")
    close = F.lit(100.0) + i * 0.35 + F.sin(i / 4) * 2
    made = spark.range(SINE_BARS).select((F.col("id") * 86_400 + SINE_FIRST).alias("ts"), close.alias("close"), (close - F.sin(i) * 0.5).alias("open"), (F.col("id") * 10_000 + 1_000_000).alias("volume"))
    made = made.withColumn("high", F.greatest("open", "close") + 1).withColumn("low", F.least("open", "close") - 1)
    return _finished(made, symbol, interval, "deterministic-demo")
