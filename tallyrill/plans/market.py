"""Market time series: bars, features, quality, adjustment, evaluation and samples as plans.

A series is (symbol); ``ts`` is Unix seconds; prices are fixed point with six digits.
All windows partition by symbol, so series are independent tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.functions.scalars import SCALE, ratio_ppm, scaled_ratio

FEATURE_BARS, HISTORY_BARS = 21, 20


def daily_bars(rows: DataFrame, symbol: str, time: str, price: Column, order: list[str]) -> DataFrame:
    """OHLCV of each symbol and day; open and close by the smallest and largest ``order``."""
    px = F.round(price * SCALE).cast("bigint")
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    day = F.unix_timestamp(F.date_trunc("DAY", time))
    keyed = rows.select(F.col(symbol).alias("symbol"), day.alias("ts"), px.alias("px"), by.alias("by"))
    return keyed.groupBy("symbol", "ts").agg(F.min_by("px", "by").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "by").alias("close"), F.count(F.lit(1)).alias("volume"))


def bars(orders: DataFrame) -> DataFrame:
    return daily_bars(orders, "o_orderpriority", "o_orderdate", F.col("o_totalprice"), ["o_orderkey"])


def series() -> Window:
    return Window.partitionBy("symbol").orderBy("ts")


def _back(n: int) -> Window:
    return series().rowsBetween(-n, 0)


def _mean(c: str, n: int) -> Column:
    """Mean of the last n rows, rounded; sums stay exact integers."""
    return F.round(F.sum(c).over(_back(n - 1)) / n).cast("bigint")


def returns(df: DataFrame) -> DataFrame:
    return df.withColumns({f"return_{k}_ppm": ratio_ppm(F.col("close"), F.lag("close", k).over(series())) for k in (1, 5)})


def averages(df: DataFrame) -> DataFrame:
    return df.withColumns({"sma_5": _mean("close", 5), "sma_20": _mean("close", 20), "volume_sma_20": _mean("volume", 20)})


def volatility(df: DataFrame) -> DataFrame:
    """Sample deviation of the last 20 log returns, in ppm."""
    out = df.withColumn("__lr", F.log(F.col("close") / F.lag("close", 1).over(series())))
    return out.withColumn("volatility_20_ppm", F.round(F.stddev_samp("__lr").over(_back(19)) * SCALE).cast("bigint")).drop("__lr")


def strength(df: DataFrame) -> DataFrame:
    """Relative strength over 14 differences, plain sums."""
    out = df.withColumn("__d", F.col("close") - F.lag("close", 1).over(series()))
    out = out.withColumn("__g", F.sum(F.greatest("__d", F.lit(0))).over(_back(13))).withColumn("__l", F.sum(F.greatest(-F.col("__d"), F.lit(0))).over(_back(13)))
    rsi = F.when((F.col("__l") == 0) & (F.col("__g") == 0), SCALE // 2).when(F.col("__l") == 0, SCALE).otherwise(F.round((1 - 1 / (1 + F.col("__g") / F.col("__l"))) * SCALE))
    return out.withColumn("rsi_14_ppm", rsi.cast("bigint")).drop("__d", "__g", "__l")


def features(df: DataFrame) -> DataFrame:
    """All features of each bar from the 21st of its series on; one sort for all windows."""
    out = strength(volatility(averages(returns(df)))).withColumn("__n", F.row_number().over(series()))
    names = ["return_1_ppm", "return_5_ppm", "sma_5", "sma_20", "volatility_20_ppm", "rsi_14_ppm", "volume_sma_20"]
    return out.filter(F.col("__n") >= FEATURE_BARS).select("symbol", "ts", *names)


def latest_n(df: DataFrame, at: int, n: int) -> DataFrame:
    """As-of: each symbol's last n bars with ts <= at (a pushed filter, then a limited rank)."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    return df.filter(F.col("ts") <= at).withColumn("rank", rank).filter(F.col("rank") <= n)


def outliers(df: DataFrame, limit: float = 0.25) -> DataFrame:
    return df.withColumn("prev", F.lag("close", 1).over(series())).filter(F.abs(F.log(F.col("close") / F.col("prev"))) > limit)


def order_violations(df: DataFrame) -> DataFrame:
    """Bars whose time does not rise, in arrival order ``pos``."""
    return df.withColumn("prev_ts", F.lag("ts", 1).over(Window.partitionBy("symbol").orderBy("pos"))).filter(F.col("ts") <= F.col("prev_ts"))


def split_adjusted(df: DataFrame, splits: DataFrame) -> DataFrame:
    """adjusted_close by all later splits: exact products over the sorted union of bars and splits.

    A split applies to bars strictly before it.  Instead of a range join, splits flow backwards
    through each series as running arrays of its own (few) splits.
    """
    actions = splits.select("symbol", F.col("ex_date").alias("ts"), F.struct("split_from", "split_to").alias("action"))
    rows = df.withColumn("action", F.lit(None).cast("struct<split_from:bigint,split_to:bigint>")).unionByName(actions, allowMissingColumns=True)
    later = Window.partitionBy("symbol").orderBy(F.col("ts").desc()).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("actions", F.collect_list("action").over(later)).filter("action is null and close is not null")
    product = lambda name: F.aggregate("actions", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x[name]).cast("decimal(38,0)"))
    return rows.select("symbol", "ts", "close", scaled_ratio(F.col("close"), product("split_from"), product("split_to")).alias("adjusted_close"))


#: The names in a bar's line of lineage text, in order, and the value where a table lacks the column.
LINEAGE = {"Symbol": "symbol", "Interval": "interval", "Source": "source", "Timestamp": "ts", "Open": "open", "High": "high", "Low": "low", "Close": "close", "AdjustedClose": "adjusted_close", "Volume": "volume"}
MISSING = {"interval": "'1d'", "source": "''", "adjusted_close": "close"}


def bar_line(df: DataFrame) -> Column:
    """A bar as the JSON line of its lineage text, without the line's end; when it was imported has no part in it."""
    return F.to_json(F.struct(*((F.col(c) if c in df.columns else F.expr(MISSING[c])).alias(name) for name, c in LINEAGE.items())), {"ignoreNullFields": "false"})


def dataset_hash(df: DataFrame) -> DataFrame:
    """SHA-256 of each series' JSON lines in time order.  One digest is one sequence, so a series' lines meet in one task."""
    lines = F.array_sort(F.collect_list(F.struct("ts", bar_line(df).alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return df.groupBy("symbol").agg(F.sha2(text, 256).alias("digest"), F.count(F.lit(1)).alias("n_bars"))


def persistence(df: DataFrame) -> DataFrame:
    """Forecast of each close by the one before, with errors."""
    out = df.withColumn("predicted", F.lag("close", 1).over(series())).filter("predicted is not null")
    return out.withColumn("abs_error", F.abs(F.col("close") - F.col("predicted"))).withColumn("ape_ppm", F.round(F.col("abs_error") * SCALE / F.col("close")).cast("bigint"))


def backtest(scored: DataFrame) -> DataFrame:
    """Count, mean absolute error (fixed point), mean percentage error, share of right directions (unchanged closes)."""
    return scored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("abs_error") / F.count(F.lit(1))).cast("bigint").alias("mae"),
        (F.sum("ape_ppm") / F.count(F.lit(1)) / SCALE).alias("mape"),
        (F.sum(F.when(F.col("close") == F.col("predicted"), 1).otherwise(0)) / F.count(F.lit(1))).alias("direction_accuracy"),
    )


def realize(forecasts: DataFrame, df: DataFrame) -> DataFrame:
    """Open forecasts meet the bar at their target."""
    actual = df.select("symbol", F.col("ts").alias("target_ts"), F.col("close").alias("actual"))
    out = forecasts.filter(~F.col("has_actual")).join(actual, ["symbol", "target_ts"])
    up = lambda a, b: F.signum((a - b).cast("double")).cast("int")
    return out.select("symbol", "as_of_ts", "target_ts", "actual", F.abs(F.col("actual") - F.col("predicted")).alias("absolute_error"), (up(F.col("actual"), F.col("baseline")) == up(F.col("predicted"), F.col("baseline"))).cast("int").alias("direction_correct"))


def samples(df: DataFrame, horizon: int = 1) -> DataFrame:
    """Inputs and the log return ``horizon`` bars ahead, with origin and target time."""
    out = features(df).join(df.select("symbol", "ts", "close", "volume"), ["symbol", "ts"])
    ahead = df.select("symbol", "ts", F.lead("close", horizon).over(series()).alias("future"), F.lead("ts", horizon).over(series()).alias("target_ts"))
    out = out.join(ahead, ["symbol", "ts"]).filter("future is not null")
    ppm = lambda c: F.col(c) / float(SCALE)
    regime = F.when(F.col("return_5_ppm") > 10_000, "uptrend").when(F.col("return_5_ppm") < -10_000, "downtrend").otherwise("flat")
    return out.select(
        "symbol", "ts", "target_ts", "close", "sma_5", "future", ppm("return_1_ppm").alias("x1"), ppm("return_5_ppm").alias("x2"), (F.col("close") / F.col("sma_5") - 1).alias("x3"), (F.col("close") / F.col("sma_20") - 1).alias("x4"),
        ppm("volatility_20_ppm").alias("x5"), ppm("rsi_14_ppm").alias("x6"), (F.col("volume") / F.col("volume_sma_20")).alias("x7"), F.log(F.col("future") / F.col("close")).alias("y"), regime.alias("regime"),
    )


PARTS = ("train", "tune", "calibration", "test")


def split_purged(sampled: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Chronological parts by row share, less rows whose target reaches the next part's first origin."""
    row = F.row_number().over(series()) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    a = F.floor(total * train)
    b = a + F.floor(total * validation)
    ends = [a, a + F.floor((b - a) / 2), b]
    part = F.when(row < ends[0], "train").when(row < ends[1], "tune").when(row < ends[2], "calibration").otherwise("test")
    parted = sampled.withColumn("part", part)
    order = {name: k for k, name in enumerate(PARTS)}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    firsts = parted.groupBy("symbol", "part").agg(F.min("ts").alias("next_origin")).withColumn("k", rank[F.col("part")] - 1).drop("part")
    joined = parted.withColumn("k", rank[F.col("part")]).join(firsts, ["symbol", "k"], "left")
    return joined.filter(F.col("next_origin").isNull() | (F.col("target_ts") < F.col("next_origin"))).drop("k", "next_origin")


def folds(sampled: DataFrame, every: int = 20, first: int = 100, calibration: int = 20) -> DataFrame:
    """Walk-forward blocks: per block its origin, size, and rows usable for fit and calibration.

    Eligible rows have targets before the block's origin; both rise with time, so the count is a merge of two
    sorted sequences (a running count over their union), not a range join.
    """
    row = F.row_number().over(series()) - 1
    parts = sampled.withColumn("row", row).filter(F.col("row") >= first).withColumn("block", F.floor((F.col("row") - first) / every).cast("bigint"))
    blocks = parts.groupBy("symbol", "block").agg(F.min("ts").alias("origin"), F.count(F.lit(1)).alias("n_scored"))
    both = sampled.select("symbol", F.col("target_ts").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("bigint").alias("n_scored"))
    both = both.unionByName(blocks.select("symbol", F.col("origin").alias("at"), F.lit(0).alias("one"), "block", "n_scored"))
    before = Window.partitionBy("symbol").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    eligible = F.coalesce(F.sum("one").over(before), F.lit(0))
    out = both.withColumn("eligible", eligible).filter("block is not null")
    return out.select("symbol", "block", F.col("at").alias("origin"), "n_scored", "eligible", F.greatest(F.col("eligible") - calibration, F.lit(0)).alias("n_fit"))


def metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Errors of (actual, predicted, lower, upper, baseline) in units."""
    e = (F.col("predicted") - F.col("actual")) / float(SCALE)
    sign = lambda a: F.signum((F.col(a) - F.col("baseline")).cast("double"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e) / (F.col("actual") / float(SCALE))).alias("mape"),
        F.avg((sign("actual") == sign("predicted")).cast("double")).alias("direction_accuracy"),
        F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"),
        F.avg((F.col("upper") - F.col("lower")) / float(SCALE)).alias("mean_width"),
    )


def residual_radius(df: DataFrame, residual: Column, coverage: float, *by: str) -> DataFrame:
    """Order statistic min(n, ceil((n + 1) coverage)) of |residual|, one-based."""
    w = Window.partitionBy(*by)
    out = df.withColumn("radius", F.abs(residual)).withColumn("rank", F.row_number().over(w.orderBy("radius"))).withColumn("n", F.count(F.lit(1)).over(w))
    want = F.least(F.col("n"), F.ceil((F.col("n") + 1) * coverage))
    return out.filter(F.col("rank") == want).select(*by, "n", "radius")


def predicted_price(close: Column, log_return: Column) -> Column:
    """Close moved by a log return held to +-0.5, at least one unit."""
    return F.greatest(F.lit(1), F.round(close * F.exp(F.greatest(F.least(log_return, F.lit(0.5)), F.lit(-0.5))))).cast("bigint")


def gram(df: DataFrame, inputs: list[str], label: str, *by: str) -> DataFrame:
    """Moments for ridge regression in one pass: means, X'X / n and X'y / n."""
    n = F.count(F.lit(1))
    aggs = [F.avg(c).alias(f"m_{c}") for c in [*inputs, label]]
    aggs += [(F.sum(F.col(a) * F.col(b)) / n).alias(f"g_{a}_{b}") for i, a in enumerate(inputs) for b in inputs[i:]]
    aggs += [(F.sum(F.col(a) * F.col(label)) / n).alias(f"g_{a}_{label}") for a in inputs]
    return df.groupBy(*by).agg(n.alias("n"), *aggs)


def recomputed(df: DataFrame, changed_from: DataFrame) -> DataFrame:
    """Features from each symbol's ``changed_ts`` on, reading only the 20 bars before it as history."""
    marked = df.join(changed_from, "symbol")
    before = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    old = marked.filter(F.col("ts") < F.col("changed_ts")).withColumn("__r", before).filter(F.col("__r") <= HISTORY_BARS).drop("__r")
    tail = old.unionByName(marked.filter(F.col("ts") >= F.col("changed_ts")))
    return features(tail.drop("changed_ts")).join(changed_from, "symbol").filter(F.col("ts") >= F.col("changed_ts")).drop("changed_ts")
