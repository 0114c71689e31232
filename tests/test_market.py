import datetime

import numpy as np
from pyspark.sql import functions as F

from tallyrill.functions import calendar
from tallyrill.operators.engine import Engine
from tallyrill.plans import market, models
from tallyrill.sources import generators
from tallyrill.streaming.incremental import apply_batch

FIELDS = "symbol string, ts bigint, open bigint, high bigint, low bigint, close bigint, volume bigint"


def linear(spark, n, first=0):
    px = lambda i: (100 + i) * 1_000_000
    return spark.createDataFrame([("SYM", 1_767_387_600 + i * 86_400, px(i) - 500_000, px(i) + 1_000_000, px(i) - 1_000_000, px(i), 1_000_000 + i) for i in range(first, n)], FIELDS)


def synthetic(spark):
    return generators.regime_bars(spark).select("symbol", "ts", "open", "high", "low", "close", "volume")


def test_made_bars(spark):
    made = generators.regime_bars(spark)
    digest = market.dataset_hash(made).first()
    assert (digest.symbol, digest.n_bars) == ("SYNTH", 600)
    assert digest.digest == "b4ce07c27d7306ad627446cebedfa71a910b848f325ed7683555da37bdabc1f3"  # published for these bars
    assert market.dataset_hash(made.withColumn("ingested_at", F.lit(7)).repartition(5)).first() == digest
    late = generators.regime_bars(spark, datetime.date(2026, 8, 28)).orderBy("ts").collect()
    assert len(late) == 600 and late[-1].ts == 1_787_788_800 and [r.close for r in late] == [r.close for r in made.orderBy("ts").collect()]
    sine = generators.sine_bars(spark, "DEMO").orderBy("ts").collect()
    assert len(sine) == 60 and (sine[0].open, sine[0].close, sine[0].high, sine[0].volume) == (100_000_000, 100_000_000, 101_000_000, 1_000_000)
    assert sine[-1].ts - sine[0].ts == 59 * 86_400 and all(r.low < min(r.open, r.close) and r.high > max(r.open, r.close) for r in sine)


def test_features_of_a_linear_series(spark):
    rows = market.features(linear(spark, 30)).orderBy("ts").collect()
    assert len(rows) == 10 and rows[0].sma_5 == 118_000_000 and rows[0].rsi_14_ppm == 1_000_000
    report = market.backtest(market.persistence(linear(spark, 6))).first()
    assert (report.n, report.mae) == (5, 1_000_000)


def test_sessions(spark):
    assert calendar.sessions(spark, "2021-08-29", "2026-08-27").count() == 1254
    days = {str(r.day) for r in calendar.sessions(spark, "2021-01-01", "2026-12-31").collect()}
    assert {"2026-07-02", "2026-11-27", "2021-12-31"} <= days
    assert not {"2026-04-03", "2026-07-03", "2026-11-26", "2025-01-09"} & days


def test_split_halves_earlier_bars(spark):
    splits = spark.createDataFrame([("SYM", 1_767_387_600 + 86_400, 1, 2)], "symbol string, ex_date bigint, split_from bigint, split_to bigint")
    rows = market.split_adjusted(linear(spark, 2), splits).orderBy("ts").collect()
    assert [r.adjusted_close for r in rows] == [50_000_000, 101_000_000]


def test_models_match_known_scores(spark):
    xs = [f"x{k}" for k in range(1, 8)]
    rows = market.split_purged(market.samples(synthetic(spark))).orderBy("ts").collect()
    part = {p: [r for r in rows if r.part == p] for p in market.PARTS}
    assert [len(part[p]) for p in market.PARTS] == [346, 56, 57, 117]
    x = lambda rs: np.array([[r[c] for c in xs] for r in rs])
    y = lambda rs: np.array([r.y for r in rs])

    def mae(model, rs):
        close, actual = np.array([r.close for r in rs]), np.array([r.future for r in rs])
        return np.abs(np.round(close * np.exp(models.predict(model, x(rs)))) - actual).mean() / 1e6

    tuned = {k: mae(models.fit(*k[:1], dict(k[1]), x(part["train"]), y(part["train"])), part["tune"]) for k in [("ridge", (("alpha", 0.01),)), ("ridge", (("alpha", 1.0),)), ("stumps", (("rounds", 32), ("rate", 0.05)))]}
    assert [round(v, 6) for v in tuned.values()] == [0.397505, 0.405386, 0.391241]
    known = part["train"] + part["tune"]
    frozen = [mae(models.fit(n, p, x(known), y(known)), part["test"]) for n, p in (("persistence", {}), ("moving-average", {"window": 5}), ("ridge", {"alpha": 0.01}), ("stumps", {"rounds": 64, "rate": 0.05}))]
    assert [round(v, 6) for v in frozen] == [0.443923, 0.866318, 0.424135, 0.427774]


def test_incremental_recompute_counts(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute("create table bars (symbol string, ts int, open int, high int, low int, close int, volume int, primary key (symbol, ts))")
    engine.execute("create table features (symbol string, ts int, return_1_ppm int, return_5_ppm int, sma_5 int, sma_20 int, volatility_20_ppm int, rsi_14_ppm int, volume_sma_20 int, primary key (symbol, ts))")
    engine.execute("create table watermarks (symbol string, last_ts int, primary key (symbol))")
    assert apply_batch(engine, linear(spark, 25)) == {"inserted": 25, "features": 5}
    assert apply_batch(engine, linear(spark, 27, 25)) == {"inserted": 2, "features": 2}
    assert apply_batch(engine, linear(spark, 27)) == {"unchanged": 27, "features": 0}
