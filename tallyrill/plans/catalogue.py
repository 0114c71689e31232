"""Registered queries and the SQL that gives the same rows.

Bars, keyed tables and statements are derived from the input tables alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrill.functions import calendar, scalars
from tallyrill.operators import engine
from tallyrill.operators.syntax import parse
from tallyrill.plans import experiment, market, models, service
from tallyrill.sources.store import TableSpec

QUERIES: dict = {}
ORACLES: dict = {}

SPECS = {
    "part": TableSpec("part", [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "bigint")], ["p_partkey"], [["p_size", "p_name"]]).checked(),
    "customer": TableSpec("customer", [("c_custkey", "bigint"), ("c_name", "string"), ("c_mktsegment", "string"), ("c_nationkey", "bigint")], ["c_custkey"], [["c_mktsegment", "c_nationkey"]]).checked(),
    "orders": TableSpec("orders", [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string")], ["o_orderkey"], [["o_custkey"]]).checked(),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table in the language's two types."""
    return read(spark, sf_dir, name).select(*(F.col(c).cast(t) for c, t in SPECS[name].columns))


def _typed(name: str) -> str:
    return ", ".join(f"{c}::{'bigint' if t == 'bigint' else 'varchar'} as {c}" for c, t in SPECS[name].columns)


def statement(key: str, table: str, text: str, sql: str) -> None:
    """A SELECT of the table language; ``sql`` reads the typed table as t."""
    QUERIES[key] = lambda spark, sf_dir: engine.query(spark, text, keyed(spark, sf_dir, table), SPECS[table])
    ORACLES[key] = f"with t as (select {_typed(table)} from {table}) {sql}"


statement("scan_full", "part", "select * from part", "select * from t")
statement("scan_range_asc", "part", "select * from part index by p_partkey > 10 and p_partkey <= 500", "select * from t where p_partkey > 10 and p_partkey <= 500")
statement("scan_ge_asc", "part", "select p_partkey, p_name from part index by p_partkey >= 100 limit 25", "select p_partkey, p_name from t where p_partkey >= 100 order by p_partkey limit 25")
statement("scan_lt_desc", "part", "select p_partkey, p_name from part index by p_partkey < 100 limit 25", "select p_partkey, p_name from t where p_partkey < 100 order by p_partkey desc limit 25")
statement("scan_prefix_eq", "part", "select * from part index by p_size = 10", "select * from t where p_size = 10")
statement("scan_tuple_gt", "part", "select * from part index by (p_size, p_name) > (10, 'm')", "select * from t where p_size > 10 or (p_size = 10 and p_name > 'm')")
statement("scan_secondary", "customer", "select * from customer index by c_mktsegment = 'BUILDING'", "select * from t where c_mktsegment = 'BUILDING'")
statement("point_get", "orders", "select * from orders index by o_orderkey = 42", "select * from t where o_orderkey = 42")
statement("indexby_flipped", "part", "select p_partkey, p_size from part index by 30 > p_size", "select p_partkey, p_size from t where p_size < 30")
statement("indexby_constexpr", "part", "select p_partkey, p_size from part index by p_size = 5 + 5", "select p_partkey, p_size from t where p_size = 10")
statement("select_star", "customer", "select * from customer", "select * from t")
statement("select_expr", "part", "select p_partkey, p_size + 1 as next_size, p_size * 2 from part", "select p_partkey, p_size + 1 as next_size, p_size * 2 as expr3 from t")
statement("literals", "part", "select p_partkey, 'it''s' as s, \"a\\tb\" as t, true as yes, FALSE as no, -7 as n from part", "select p_partkey, 'it''s' as s, 'a' || chr(9) || 'b' as t, true as yes, false as no, -7::bigint as n from t")
statement("filter_compound", "part", "select * from part where p_size >= 10 and p_size < 20 and p_brand != 'Brand#11'", "select * from t where p_size >= 10 and p_size < 20 and p_brand <> 'Brand#11'")
statement("filter_bool_ops", "part", "select p_partkey from part filter not (p_size < 10 or p_size > 40) and p_name > 'b'", "select p_partkey from t where not (p_size < 10 or p_size > 40) and p_name > 'b'")
statement("filter_cmp_ops", "orders", "select o_orderkey from orders where o_orderkey <> 5 and o_orderstatus == 'F' and o_custkey <= 900", "select o_orderkey from t where o_orderkey <> 5 and o_orderstatus = 'F' and o_custkey <= 900")
statement("bool_cmp", "part", "select p_partkey, (p_size > 10) > (p_size > 30) as mid from part", "select p_partkey, (p_size > 10) > (p_size > 30) as mid from t")
statement("arith_int", "part", "select p_partkey, p_size * 3 - p_partkey + 7 as v from part", "select p_partkey, p_size * 3 - p_partkey + 7 as v from t")
statement("arith_div", "part", "select p_partkey, (p_size - 25) / 4 as q from part", "select p_partkey, (p_size - 25) // 4 as q from t")
statement("arith_neg", "part", "select p_partkey, -p_size as v, - -p_size as w from part", "select p_partkey, -p_size as v, p_size as w from t")
statement("str_concat", "part", "select p_partkey, p_brand + '/' + p_type as v from part", "select p_partkey, p_brand || '/' || p_type as v from t")
statement("limit_n", "orders", "select * from orders index by o_custkey > 100 limit 50", "select * from t where o_custkey > 100 order by o_custkey, o_orderkey limit 50")
statement("limit_offset", "orders", "select o_orderkey from orders where o_orderstatus = 'O' limit 20, 30", "select o_orderkey from t where o_orderstatus = 'O' order by o_orderkey limit 30 offset 20")
statement("queue_head", "orders", "select o_orderkey, o_custkey from orders index by o_custkey >= 0 where o_orderstatus = 'P' limit 1", "select o_orderkey, o_custkey from t where o_custkey >= 0 and o_orderstatus = 'P' order by o_custkey, o_orderkey limit 1")


def dml(key: str, text: str, sql: str) -> None:
    """The table ``part`` after a statement."""

    def run(spark, sf_dir):
        df, spec, s = keyed(spark, sf_dir, "part"), SPECS["part"], parse(text)
        if type(s).__name__ == "Insert":
            return df.unionByName(engine.insert(df, spec, s))
        if type(s).__name__ == "Update":
            return engine.upserted(df, engine.updated(spark, df, spec, s), spec.key)
        with engine.wrapping(spark):
            return df.join(engine.scanned(df, spec, s).select(*spec.key), spec.key, "left_anti")

    QUERIES[key] = run
    ORACLES[key] = f"with t as (select {_typed('part')} from part) {sql}"


dml("dml_insert", "insert into part (p_partkey, p_name, p_brand, p_type, p_size) values (90000001, 'a', 'b', 'c', 1 + 2), (90000002, 'd', 'e', 'f', -4)", "select * from t union all values (90000001, 'a', 'b', 'c', 3), (90000002, 'd', 'e', 'f', -4)")
dml("dml_update", "update part set p_size = p_size + 100, p_name = p_name + '!' index by p_size >= 40 where p_partkey < 1000", "select p_partkey, case when p_size >= 40 and p_partkey < 1000 then p_name || '!' else p_name end as p_name, p_brand, p_type, case when p_size >= 40 and p_partkey < 1000 then p_size + 100 else p_size end as p_size from t")
dml("dml_delete", "delete from part where p_size < 10 limit 50", "select * from t where p_partkey not in (select p_partkey from t where p_size < 10 order by p_partkey limit 50)")
dml("dml_delete_range", "delete from part index by p_partkey > 20 and p_partkey <= 400 limit 100", "select * from t where p_partkey not in (select p_partkey from t where p_partkey > 20 and p_partkey <= 400 order by p_partkey limit 100)")


def changes(df: DataFrame) -> DataFrame:
    """A third of the table changed, a third as it is, and new keys."""
    own = df.filter("p_partkey % 3 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 3 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return own.unionByName(df.filter("p_partkey % 3 = 0").withColumn("p_partkey", F.col("p_partkey") + 90_000_000))


CHANGES = """c as (select p_partkey, p_name, p_brand, p_type, p_size + (p_partkey % 3 = 1)::int as p_size from t where p_partkey % 3 <> 0
  union all select p_partkey + 90000000, p_name, p_brand, p_type, p_size from t where p_partkey % 3 = 0)"""


def query(key: str, sql: str | None):
    def register(f):
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


PART = f"with t as (select {_typed('part')} from part), {CHANGES}"


@query("dml_upsert", PART + " select * from c union all select * from t where p_partkey not in (select p_partkey from c)")
def dml_upsert(spark, sf_dir):
    df = keyed(spark, sf_dir, "part")
    return engine.upserted(df, changes(df), ["p_partkey"])


@query("read_your_writes", PART + ", u as (select * from c union all select * from t where p_partkey not in (select p_partkey from c)) select p_partkey, p_size from u where p_size >= 45")
def read_your_writes(spark, sf_dir):
    df = keyed(spark, sf_dir, "part")
    pending = engine.upserted(df, changes(df), ["p_partkey"])
    return engine.query(spark, "select p_partkey, p_size from part index by p_size >= 45", pending, SPECS["part"])


@query("merge_classify", PART + " select case when t.p_partkey is null then 'inserted' when t.p_size = c.p_size then 'unchanged' else 'updated' end as merge_class, count(*)::bigint as n from c left join t on c.p_partkey = t.p_partkey group by 1")
def merge_classify(spark, sf_dir):
    df = keyed(spark, sf_dir, "part")
    return engine.classify(df, changes(df), ["p_partkey"]).groupBy("merge_class").agg(F.count(F.lit(1)).alias("n"))


BARS = """bars as (select o_orderpriority as symbol, epoch(date_trunc('day', o_orderdate))::bigint as ts,
  arg_min(px, o_orderkey) as open, max(px) as high, min(px) as low, arg_max(px, o_orderkey) as close, count(*)::bigint as volume
  from (select *, round(o_totalprice * 1e6)::bigint as px from orders) group by 1, 2)"""
EBARS = """ebars as (select event_type as symbol, epoch(date_trunc('day', ts))::bigint as ts,
  arg_min(px, {'a': ts, 'b': event_id}) as open, max(px) as high, min(px) as low, arg_max(px, {'a': ts, 'b': event_id}) as close, count(*)::bigint as volume
  from (select *, round((abs(value) + 1) * 1e6)::bigint as px from events) group by 1, 2)"""
RETURNS = "round((close / lag(close, {k}) over w - 1) * 1e6)::bigint as return_{k}_ppm"
WINDOW = "window w as (partition by symbol order by ts), w5 as (partition by symbol order by ts rows 4 preceding), w14 as (partition by symbol order by ts rows 13 preceding), w20 as (partition by symbol order by ts rows 19 preceding)"
AVERAGES = "round(sum(close) over w5 / count(*) over w5)::bigint as sma_5, round(sum(close) over w20 / count(*) over w20)::bigint as sma_20, round(sum(volume) over w20 / count(*) over w20)::bigint as volume_sma_20"
RSI = "case when l14 = 0 and g14 = 0 then 500000 when l14 = 0 then 1000000 else round((1 - 1 / (1 + g14 / l14)) * 1e6)::bigint end"
STEPS = f"""{BARS}, steps as (select *, ln(close / lag(close, 1) over w) as lr, close - lag(close, 1) over w as d, row_number() over w as n from bars window w as (partition by symbol order by ts)),
feats as (select symbol, ts, close, volume, n, {RETURNS.format(k=1)}, {RETURNS.format(k=5)}, round(sum(close) over w5 / 5)::bigint as sma_5, round(sum(close) over w20 / 20)::bigint as sma_20,
  round(stddev_samp(lr) over w20 * 1e6)::bigint as volatility_20_ppm, (sum(greatest(d, 0)) over w14)::double as g14, (sum(greatest(-d, 0)) over w14)::double as l14, round(sum(volume) over w20 / 20)::bigint as volume_sma_20 from steps {WINDOW})"""
FULL = f"{STEPS}, features as (select symbol, ts, return_1_ppm, return_5_ppm, sma_5, sma_20, volatility_20_ppm, {RSI} as rsi_14_ppm, volume_sma_20 from feats where n >= 21)"


def bars(spark, sf_dir) -> DataFrame:
    return market.bars(read(spark, sf_dir, "orders"))


def ebars(spark, sf_dir) -> DataFrame:
    return market.daily_bars(read(spark, sf_dir, "events"), "event_type", "ts", F.abs("value") + 1, ["ts", "event_id"])


query("daily_bars", f"with {BARS} select * from bars")(bars)
query("event_bars", f"with {EBARS} select * from ebars")(ebars)
query("features_full", f"with {FULL} select * from features")(lambda spark, sf_dir: market.features(bars(spark, sf_dir)))
query("feat_returns", f"with {BARS} select symbol, ts, {RETURNS.format(k=1)}, {RETURNS.format(k=5)} from bars {WINDOW}")(lambda spark, sf_dir: market.returns(bars(spark, sf_dir)).select("symbol", "ts", "return_1_ppm", "return_5_ppm"))
query("feat_sma", f"with {STEPS} select symbol, ts, sma_5, sma_20, volume_sma_20 from feats where n >= 20")(lambda spark, sf_dir: market.averages(bars(spark, sf_dir)).withColumn("n", F.row_number().over(market.series())).filter("n >= 20").select("symbol", "ts", "sma_5", "sma_20", "volume_sma_20"))
query("feat_volatility", f"with {STEPS} select symbol, ts, volatility_20_ppm from feats where n >= 21")(lambda spark, sf_dir: market.volatility(bars(spark, sf_dir)).withColumn("n", F.row_number().over(market.series())).filter("n >= 21").select("symbol", "ts", "volatility_20_ppm"))
query("feat_rsi", f"with {STEPS} select symbol, ts, {RSI} as rsi_14_ppm from feats where n >= 15")(lambda spark, sf_dir: market.strength(bars(spark, sf_dir)).withColumn("n", F.row_number().over(market.series())).filter("n >= 15").select("symbol", "ts", "rsi_14_ppm"))
AT = 946_684_800
query("asof_latest_n", f"with {BARS} select symbol, ts, close from bars where ts <= {AT} qualify row_number() over (partition by symbol order by ts desc) <= 21")(lambda spark, sf_dir: market.latest_n(bars(spark, sf_dir), AT, 21).select("symbol", "ts", "close"))
query("latest_k_per_symbol", f"with {EBARS} select symbol, ts, close from ebars qualify row_number() over (partition by symbol order by ts desc) <= 5")(lambda spark, sf_dir: market.latest_n(ebars(spark, sf_dir), 1 << 40, 5).select("symbol", "ts", "close"))
query("union_history", f"with {BARS} select symbol, ts, close, 'history' as part from bars where ts < {AT} union all select symbol, ts, close, 'target' from bars where ts >= {AT}")(
    lambda spark, sf_dir: bars(spark, sf_dir).filter(F.col("ts") < AT).select("symbol", "ts", "close", F.lit("history").alias("part")).unionByName(bars(spark, sf_dir).filter(F.col("ts") >= AT).select("symbol", "ts", "close", F.lit("target").alias("part")))
)
query("quality_outliers", f"with {BARS} select symbol, ts, close, prev from (select *, lag(close) over (partition by symbol order by ts) as prev from bars) where abs(ln(close / prev)) > 0.25")(lambda spark, sf_dir: market.outliers(bars(spark, sf_dir)).select("symbol", "ts", "close", "prev"))
query("bar_order_violations", f"with {EBARS}, p as (select *, row_number() over (partition by symbol order by close, ts) as pos from ebars) select symbol, pos, ts, prev_ts from (select *, lag(ts) over (partition by symbol order by pos) as prev_ts from p) where ts <= prev_ts")(
    lambda spark, sf_dir: market.order_violations(ebars(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("close", "ts")).cast("bigint"))).select("symbol", "pos", "ts", "prev_ts")
)
LINE = """'{"Symbol":"' || symbol || '","Interval":"1d","Source":"","Timestamp":' || ts || ',"Open":' || open || ',"High":' || high || ',"Low":' || low
    || ',"Close":' || close || ',"AdjustedClose":' || close || ',"Volume":' || volume || '}' || chr(10)"""
query("dataset_hash", f"with {BARS} select symbol, sha256(string_agg({LINE}, '' order by ts)) as digest, count(*)::bigint as n_bars from bars group by symbol")(lambda spark, sf_dir: market.dataset_hash(bars(spark, sf_dir)))
PERSIST = f"{BARS}, scored as (select *, abs(close - predicted) as abs_error, round(abs(close - predicted) * 1e6 / close)::bigint as ape_ppm from (select *, lag(close) over (partition by symbol order by ts) as predicted from bars) where predicted is not null)"
query("backtest_persistence", f"with {PERSIST} select symbol, count(*)::bigint as n, round(sum(abs_error) / count(*))::bigint as mae, sum(ape_ppm) / count(*) / 1e6 as mape, count(*) filter (where close = predicted) / count(*) as direction_accuracy from scored group by symbol")(lambda spark, sf_dir: market.backtest(market.persistence(bars(spark, sf_dir))))
query("pred_persistence", f"with {PERSIST} select symbol, ts, predicted, abs_error, ape_ppm from scored")(lambda spark, sf_dir: market.persistence(bars(spark, sf_dir)).select("symbol", "ts", "predicted", "abs_error", "ape_ppm"))
SESSIONS = calendar.duckdb_sessions("1995-01-01", "2001-12-31")
query("nyse_sessions", f"select * from {SESSIONS}")(lambda spark, sf_dir: calendar.sessions(spark, "1995-01-01", "2001-12-31"))
query("next_session", f"with s as (select day, row_number() over (order by day) as n from {SESSIONS}) select a.day, b.day as third_next from s a join s b on b.n = a.n + 3")(lambda spark, sf_dir: _next_session(spark, 3))


def _next_session(spark, n: int) -> DataFrame:
    """The n-th session after each one."""
    s = calendar.numbered(calendar.sessions(spark, "1995-01-01", "2001-12-31"))
    return s.join(s.select(F.col("day").alias("third_next"), (F.col("n") - n).alias("n")), "n").select("day", "third_next")


DATES = "make_timestamp(ts * 1000000)::date"


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date(F.timestamp_seconds("ts")))


def all_sessions(spark) -> DataFrame:
    return calendar.sessions(spark, "1995-01-01", "2001-12-31")


CALENDAR = f"s as (select * from {SESSIONS}), b as (select *, {DATES} as day from bars), e as (select symbol, s.day from (select symbol, min(day) as lo, max(day) as hi from b group by symbol) r join s on s.day between r.lo and r.hi)"


def expected(df: DataFrame, spark) -> DataFrame:
    """Sessions within each series' range; a calendar is a few hundred rows a year."""
    span = dated(df).groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = F.broadcast(all_sessions(spark))
    return span.join(days, F.col("day").between(F.col("lo"), F.col("hi"))).select("symbol", "day")


query("quality_missing", f"with {BARS}, {CALENDAR} select e.symbol, e.day from e anti join b on e.symbol = b.symbol and e.day = b.day")(lambda spark, sf_dir: expected(bars(spark, sf_dir), spark).join(dated(bars(spark, sf_dir)), ["symbol", "day"], "left_anti"))
query("quality_unexpected", f"with {BARS}, {CALENDAR} select symbol, day, close from b anti join s on b.day = s.day")(lambda spark, sf_dir: dated(bars(spark, sf_dir)).join(F.broadcast(all_sessions(spark)), "day", "left_anti").select("symbol", "day", "close"))
query("session_except", f"with {BARS}, {CALENDAR} select day from s except select day from b")(lambda spark, sf_dir: all_sessions(spark).subtract(dated(bars(spark, sf_dir)).select("day")))


@query("quality_report", f"""with {BARS}, {CALENDAR}, m as (select e.symbol, e.day from e anti join b on e.symbol = b.symbol and e.day = b.day),
  o as (select *, abs(ln(close / lag(close) over (partition by symbol order by ts))) > 0.25 as far from b),
  q as (select symbol, count(*)::bigint as observed, count(*) filter (where o.day not in (select day from s))::bigint as unexpected, count(*) filter (where far)::bigint as outliers, count(*) filter (where volume = 0)::bigint as zero_volume from o group by symbol)
select q.*, x.expected, x.expected - coalesce(y.missing, 0) as met, coalesce(y.missing, 0)::bigint as missing, round((x.expected - coalesce(y.missing, 0)) * 1000000 / x.expected)::bigint as coverage_ppm, y.sample
from q join (select symbol, count(*)::bigint as expected from e group by symbol) x using (symbol) left join (select symbol, count(*)::bigint as missing, string_agg(day::varchar, ',' order by day) filter (where k <= 50) as sample from (select *, row_number() over (partition by symbol order by day) as k from m) group by symbol) y using (symbol)""")
def quality_report(spark, sf_dir):
    """One aggregation by symbol; the sessions, a few hundred a year, are an array that the bars' days are taken out of."""
    days = all_sessions(spark)
    listed = F.array(*(F.lit(r.day) for r in days.orderBy("day").collect()))
    df = dated(bars(spark, sf_dir)).join(F.broadcast(days.withColumn("session", F.lit(True))), "day", "left")
    df = df.withColumn("prev", F.lag("close", 1).over(market.series()))
    far = F.abs(F.log(F.col("close") / F.col("prev"))) > 0.25
    found = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(F.col("session").isNull()).alias("unexpected"), F.count_if(far).alias("outliers"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
        F.count_if(F.col("session")).alias("met"), F.min("day").alias("lo"), F.max("day").alias("hi"), F.collect_list(F.when(F.col("session"), F.col("day"))).alias("seen"),
    )
    found = found.withColumn("days", F.filter(listed, lambda d: d.between(F.col("lo"), F.col("hi"))))
    found = found.withColumn("gaps", F.array_except("days", "seen")).withColumn("expected", F.size("days").cast("bigint"))
    missing = F.size("gaps").cast("bigint")
    sample = F.when(missing > 0, F.array_join(F.slice(F.transform("gaps", lambda d: d.cast("string")), 1, 50), ","))
    coverage = F.round(F.col("met") * 1_000_000 / F.col("expected")).cast("bigint")
    return found.select("symbol", "observed", "unexpected", "outliers", "zero_volume", "expected", "met", missing.alias("missing"), coverage.alias("coverage_ppm"), sample.alias("sample"))


SPLITS = (("1-URGENT", 820_454_400, 1, 2), ("1-URGENT", 915_148_800, 1, 3), ("2-HIGH", 883_612_800, 3, 2))


@query("split_adjust", f"""with {BARS}, s(symbol, ex, f, t) as (values {", ".join(f"('{s}', {x}, {f}, {t})" for s, x, f, t in SPLITS)}),
j as (select b.symbol, b.ts, b.close, coalesce(product(s.f), 1)::hugeint as f, coalesce(product(s.t), 1)::hugeint as t from bars b left join s on s.symbol = b.symbol and b.ts < s.ex group by all)
select symbol, ts, close, ((close::hugeint * f + t // 2) // t)::bigint as adjusted_close from j""")
def split_adjust(spark, sf_dir):
    splits = spark.createDataFrame(SPLITS, "symbol string, ex_date bigint, split_from bigint, split_to bigint")
    return market.split_adjusted(bars(spark, sf_dir), splits)


@query("forecast_realize", f"""with {BARS}, f as (select symbol, ts as as_of_ts, close as baseline, lead(ts) over w as target_ts, round(close * 1.01)::bigint as predicted, ts % 172800 = 0 as has_actual from bars window w as (partition by symbol order by ts))
select f.symbol, as_of_ts, target_ts, b.close as actual, abs(b.close - predicted) as absolute_error, (sign(b.close - baseline) = sign(predicted - baseline))::int as direction_correct from f join bars b on f.symbol = b.symbol and f.target_ts = b.ts where not has_actual""")
def forecast_realize(spark, sf_dir):
    df = bars(spark, sf_dir)
    forecasts = df.select("symbol", F.col("ts").alias("as_of_ts"), F.col("close").alias("baseline"), F.lead("ts", 1).over(market.series()).alias("target_ts"), F.round(F.col("close") * 1.01).cast("bigint").alias("predicted"), (F.col("ts") % 172_800 == 0).alias("has_actual"))
    return market.realize(forecasts, df)


SAMPLES = f"""{FULL}, samples as (select f.symbol, f.ts, f.close, f.sma_5, a.target_ts, a.future, f.return_1_ppm / 1e6 as x1, f.return_5_ppm / 1e6 as x2, f.close / f.sma_5 - 1 as x3, f.close / f.sma_20 - 1 as x4, f.volatility_20_ppm / 1e6 as x5, r.rsi_14_ppm / 1e6 as x6, f.volume / f.volume_sma_20 as x7,
  ln(a.future / f.close) as y, case when f.return_5_ppm > 10000 then 'uptrend' when f.return_5_ppm < -10000 then 'downtrend' else 'flat' end as regime
  from feats f join features r on f.symbol = r.symbol and f.ts = r.ts join (select symbol, ts, lead(ts) over w as target_ts, lead(close) over w as future from bars window w as (partition by symbol order by ts)) a on a.symbol = f.symbol and a.ts = f.ts where a.future is not null)"""
XS = [f"x{k}" for k in range(1, 8)]


def samples(spark, sf_dir) -> DataFrame:
    return market.samples(bars(spark, sf_dir))


query("pred_samples", f"with {SAMPLES} select symbol, ts, target_ts, regime, {', '.join(f'round({x}, 6) as {x}' for x in [*XS, 'y'])} from samples")(lambda spark, sf_dir: samples(spark, sf_dir).select("symbol", "ts", "target_ts", "regime", *(F.round(x, 6).alias(x) for x in [*XS, "y"])))
PARTS = """parts as (select *, case when row < a then 'train' when row < a + (b - a) // 2 then 'tune' when row < b then 'calibration' else 'test' end as part from
  (select *, a + floor(n * 0.2)::bigint as b from (select *, floor(n * 0.6)::bigint as a from (select *, row_number() over (partition by symbol order by ts) - 1 as row, count(*) over (partition by symbol) as n from samples)))),
firsts as (select symbol, part, min(ts) as origin from parts group by all)"""
query("split_purged", f"""with {SAMPLES}, {PARTS} select p.symbol, p.part, count(*)::bigint as n, min(p.ts) as first_ts, max(p.target_ts) as last_target from parts p
  left join firsts f on f.symbol = p.symbol and f.part = case p.part when 'train' then 'tune' when 'tune' then 'calibration' when 'calibration' then 'test' end where f.origin is null or p.target_ts < f.origin group by all""")(
    lambda spark, sf_dir: market.split_purged(samples(spark, sf_dir)).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("target_ts").alias("last_target"))
)
query("walk_forward_folds", f"""with {SAMPLES}, r as (select *, row_number() over (partition by symbol order by ts) - 1 as row from samples), b as (select symbol, (row - 100) // 20 as block, min(ts) as origin, count(*)::bigint as n_scored from r where row >= 100 group by all)
select b.symbol, b.block, b.origin, b.n_scored, count(s.ts)::bigint as eligible, greatest(count(s.ts) - 20, 0)::bigint as n_fit from b left join samples s on s.symbol = b.symbol and s.target_ts < b.origin group by all""")(lambda spark, sf_dir: market.folds(samples(spark, sf_dir)))
MA = "greatest(1, round(close * exp(greatest(least(ln(sma_5 / close), 0.5), -0.5))))::bigint"


def ma_scored(spark, sf_dir) -> DataFrame:
    out = samples(spark, sf_dir).withColumn("predicted", market.predicted_price(F.col("close"), F.log(F.col("sma_5") / F.col("close"))))
    width = F.floor(F.col("close") / 10)
    return out.select("symbol", "ts", "regime", F.col("future").alias("actual"), F.col("close").alias("baseline"), "predicted", (F.col("predicted") - width).alias("lower"), (F.col("predicted") + width).alias("upper"))


SCORED = f"{SAMPLES}, scored as (select symbol, ts, regime, future as actual, close as baseline, {MA} as predicted, {MA} - close // 10 as lower, {MA} + close // 10 as upper from samples)"
METRICS = "count(*)::bigint as n, round(avg(abs(predicted - actual) / 1e6), 6) as mae, round(sqrt(avg(((predicted - actual) / 1e6) ** 2)), 6) as rmse, round(avg(abs(predicted - actual) / actual), 6) as mape, round(avg((sign(actual - baseline) = sign(predicted - baseline))::int), 6) as direction_accuracy, round(avg((actual between lower and upper)::int), 6) as coverage, round(avg((upper - lower) / 1e6), 6) as mean_width"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


query("pred_moving_average", f"with {SCORED} select symbol, ts, predicted from scored")(lambda spark, sf_dir: ma_scored(spark, sf_dir).select("symbol", "ts", "predicted"))
query("pred_metrics", f"with {SCORED} select symbol, {METRICS} from scored group by symbol")(lambda spark, sf_dir: rounded(market.metrics(ma_scored(spark, sf_dir), "symbol")))
query("regime_metrics", f"with {SCORED} select regime, {METRICS} from scored group by regime")(lambda spark, sf_dir: rounded(market.metrics(ma_scored(spark, sf_dir), "regime")))
query("residual_radius", f"with {SCORED}, r as (select symbol, abs(actual - predicted) as radius, row_number() over (partition by symbol order by abs(actual - predicted)) as k, count(*) over (partition by symbol) as n from scored) select symbol, n, radius from r where k = least(n, ceil((n + 1) * 0.9))")(
    lambda spark, sf_dir: market.residual_radius(ma_scored(spark, sf_dir).select("symbol", "actual", "predicted"), F.col("actual") - F.col("predicted"), 0.9, "symbol")
)


@query("mae_vs_baseline", f"with {SCORED} select symbol, round(1 - avg(abs(predicted - actual)) / avg(abs(baseline - actual)), 6) as improvement, avg(abs(predicted - actual)) < avg(abs(baseline - actual)) as beats from scored group by symbol")
def mae_vs_baseline(spark, sf_dir):
    mae, base = (F.avg(F.abs(F.col(c) - F.col("actual"))) for c in ("predicted", "baseline"))
    return ma_scored(spark, sf_dir).groupBy("symbol").agg(F.round(1 - mae / base, 6).alias("improvement"), (mae < base).alias("beats"))


@query("standardize", f"with {SAMPLES} select symbol, {', '.join(f'round(avg({x}), 6) as mean_{x}, round(case when stddev_pop({x}) < 1e-12 then 1 else stddev_pop({x}) end, 6) as scale_{x}' for x in XS)} from samples group by symbol")
def standardize(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("symbol").agg(*(x for c in XS for x in (F.round(F.avg(c), 6).alias(f"mean_{c}"), F.round(F.when(F.stddev_pop(c) < 1e-12, 1.0).otherwise(F.stddev_pop(c)), 6).alias(f"scale_{c}"))))


_GRAM = [(a, b) for i, a in enumerate(XS) for b in XS[i:]] + [(a, "y") for a in XS]
query("ridge_gram", f"with {SAMPLES} select symbol, count(*)::bigint as n, {', '.join(f'round(avg({c}), 6) as m_{c}' for c in [*XS, 'y'])}, {', '.join(f'round(sum({a} * {b}) / count(*), 6) as g_{a}_{b}' for a, b in _GRAM)} from samples group by symbol")(lambda spark, sf_dir: rounded(market.gram(samples(spark, sf_dir), XS, "y", "symbol")))


@query("argmin_group", f"with {BARS} select symbol, ts, low from bars qualify row_number() over (partition by symbol order by low, ts) = 1")
def argmin_group(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("low", "ts"))).filter("k = 1").select("symbol", "ts", "low")


query("checkpoint_max", f"with {BARS} select symbol, max(ts) as last_ts, min(ts) as first_ts, count(*)::bigint as n from bars group by symbol")(lambda spark, sf_dir: bars(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n")))


@query("supported_outlook", f"with {SAMPLES} select symbol, case when bool_or(x2 > 0) and bool_or(x2 < 0) then 'mixed' when bool_or(x2 > 0) then 'positive' when bool_or(x2 < 0) then 'negative' else 'flat' end as outlook from samples where ts >= 1 group by symbol")
def supported_outlook(spark, sf_dir):
    up, down = F.bool_or(F.col("x2") > 0), F.bool_or(F.col("x2") < 0)
    return samples(spark, sf_dir).groupBy("symbol").agg(F.when(up & down, "mixed").when(up, "positive").when(down, "negative").otherwise("flat").alias("outlook"))


@query("scorecard", """
with c as (
  select case when quality = 0 and toxic = 0 then 'abstain' when toxic = 1 then 'negative' else 'positive' end as expected,
         case when doc_id % 4 = 0 then 'abstain' when toxic = 1 then 'negative' else 'positive' end as outlook,
         ['e' || doc_id % 3, 'e' || doc_id % 5] as cited, ['e0', 'e' || doc_id % 2] as supported
  from labels)
select count(*)::bigint as cases, count(*) filter (where expected = outlook)::bigint as correct,
       round(count(*) filter (where expected = outlook) / count(*), 6) as accuracy,
       round(sum(len(list_intersect(cited, supported))) / sum(len(cited)), 6) as citation_precision,
       round(count(*) filter (where expected = 'abstain' and outlook = 'abstain') / count(*) filter (where expected = 'abstain'), 6) as abstention_recall
from c""")
def scorecard(spark, sf_dir):
    """The scorecard operator over cases made from labels."""
    named = lambda k: F.concat(F.lit("e"), (F.col("doc_id") % k).cast("string"))
    sign = F.when(F.col("toxic") == 1, "negative").otherwise("positive")
    cases = read(spark, sf_dir, "labels").select(
        F.when((F.col("quality") == 0) & (F.col("toxic") == 0), "abstain").otherwise(sign).alias("expected"),
        F.when(F.col("doc_id") % 4 == 0, "abstain").otherwise(sign).alias("outlook"),
        F.array(named(3), named(5)).alias("cited"), F.array(F.lit("e0"), named(2)).alias("supported"),
    )
    return rounded(service.scorecard(cases))


@query("nearest_rank", "select event_type, " + ", ".join(f"percentile_disc({p}) within group (order by value) as p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + " from events group by event_type")
def nearest_rank(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(*(F.expr(f"percentile_disc({p}) within group (order by value)").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)))


@query("counter_rollup", "select event_type, user_id % 7 as shard, count(*)::bigint as n, sum(round(value * 1000)::bigint)::bigint as total_milli from events group by all")
def counter_rollup(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 1000).cast("bigint")).alias("total_milli"))


@query("scale_price", "select o_orderkey, round(o_totalprice * 1e6)::bigint as price, round(o_totalprice * 1e6)::bigint / 1e6 as unscaled from orders")
def scale_price(spark, sf_dir):
    price = scalars.scale_price(F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), scalars.unscale_price(price).alias("unscaled"))


@query("normalize_symbol", r"select c_custkey, case when regexp_full_match(upper(trim(c_mktsegment)), '[A-Z0-9.^=/-]{1,32}') then upper(trim(c_mktsegment)) end as symbol from customer")
def normalize_symbol(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", scalars.normalize_symbol(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))).alias("symbol"))


@query("json_props", "select event_id, json_valid(props) as is_object, json_extract_string(props, '$.k') as k from events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").isNotNull().alias("is_object"), F.get_json_object("props", "$.k").alias("k"))


@query("digest_rows", "select n_nationkey, sha256(concat_ws('|', n_nationkey, n_name, n_regionkey)) as digest from nation")
def digest_rows(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), 256).alias("digest"))


@query("bar_violations", f"with {BARS}, d as (select symbol, ts, open - (ts % 7 = 0)::bigint * high as open, case when ts % 5 = 0 then low - 1 else high end as high, low, close, volume - (ts % 3 = 0)::bigint * 1000 as volume from bars) select symbol, ts, case when open <= 0 or high <= 0 or low <= 0 or close <= 0 then 'price not positive' when high < open or high < close or high < low then 'high below' when low > open or low > close then 'low above' when volume < 0 then 'volume negative' end as rule from d")
def bar_violations(spark, sf_dir):
    hit = lambda k: (F.col("ts") % k == 0).cast("bigint")
    df = bars(spark, sf_dir).withColumns({"open": F.col("open") - hit(7) * F.col("high"), "high": F.when(F.col("ts") % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.col("volume") - hit(3) * 1000, "source": F.lit("orders")})
    return df.select("symbol", "ts", scalars.bar_rule().alias("rule"))


@query("duplicate_bars", "select event_type, count(*)::bigint - count(distinct date_trunc('hour', ts))::bigint as duplicates from events group by event_type")
def duplicate_bars(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg((F.count(F.lit(1)) - F.count_distinct(F.date_trunc("HOUR", "ts"))).alias("duplicates"))


@query("fk_violations", "select l_orderkey, l_linenumber from lineitem anti join orders on l_orderkey = o_orderkey and o_orderstatus = 'F'")
def fk_violations(spark, sf_dir):
    known = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(known, "l_orderkey", "left_anti")


FILED = """filed as (
  select 'S' || o_custkey % 50 as symbol, lpad((o_custkey % 50 + 1)::varchar, 10, '0') as cik,
         lpad((o_custkey % 50 + 1)::varchar, 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad((o_orderkey % 1000000)::varchar, 6, '0') as accession,
         case o_orderpriority[1] when '1' then '10-K' when '2' then '8-K' when '3' then '10-Q/A' else 'S-1' end as form,
         epoch(o_orderdate)::bigint as published_at, 'd' || o_orderkey || '.htm' as document
  from orders)"""


def submissions(spark, sf_dir) -> DataFrame:
    """(symbol, cik, payload): one document of parallel arrays for each of fifty companies, made from orders."""
    orders = read(spark, sf_dir, "orders")
    company = F.col("o_custkey") % 50
    cik = F.lpad((company + 1).cast("string"), 10, "0")
    first = F.substring("o_orderpriority", 1, 1)
    rows = orders.select(
        F.concat(F.lit("s"), company.cast("string")).alias("symbol"), cik.alias("cik"),
        F.concat_ws("-", cik, F.date_format("o_orderdate", "yy"), F.lpad((F.col("o_orderkey") % 1_000_000).cast("string"), 6, "0")).alias("accessionNumber"),
        F.when(first == "1", "10-K").when(first == "2", "8-K").when(first == "3", "10-Q/A").otherwise("S-1").alias("form"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("acceptanceDateTime"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primaryDocument"),
    )
    names = ["accessionNumber", "form", "acceptanceDateTime", "primaryDocument"]
    each = rows.groupBy("symbol", "cik").agg(F.collect_list(F.struct(*names)).alias("f"))
    recent = F.struct(*(F.col(f"f.{n}").alias(n) for n in names))
    return each.select("symbol", "cik", F.to_json(F.struct("cik", F.array("symbol").alias("tickers"), F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))


@query("filings_topk", f"""
with {FILED}
select symbol, cik, accession, form, document, published_at, null::varchar as fault,
       'https://www.sec.gov/Archives/edgar/data/' || ltrim(cik, '0') || '/' || replace(accession, '-', '') || '/' || document as url
from filed where form <> 'S-1' qualify row_number() over (partition by symbol order by published_at desc, accession desc) <= 20""")
def filings_topk(spark, sf_dir):
    return service.filings(submissions(spark, sf_dir))


@query("filings_asof", """
with f as (
  select event_type as symbol, user_id::varchar as accession, floor(epoch(ts))::bigint as published_at,
         floor(epoch(ts))::bigint + event_id % 5 * 86400 as retrieved_at, event_id from events),
k as (
  select * from f where published_at <= 1705708800 and published_at >= 1705708800 - 365 * 86400 and retrieved_at <= 1705708800
  qualify row_number() over (partition by symbol, accession order by published_at desc, retrieved_at desc, event_id desc) = 1)
select symbol, accession, published_at, retrieved_at, event_id from k
qualify row_number() over (partition by symbol order by published_at desc, accession desc) <= 3""")
def filings_asof(spark, sf_dir):
    published = F.unix_timestamp("ts")
    stored = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("user_id").cast("string").alias("accession"), published.alias("published_at"), (published + F.col("event_id") % 5 * 86_400).alias("retrieved_at"), "event_id")
    return service.filings_at(stored, 1_705_708_800)


@query("artifact_chunks", """
select doc_id::varchar as run_id, octet_length(encode(text))::bigint as bytes, ((octet_length(encode(text)) + 1799) // 1800)::bigint as chunks, sha256(text) as digest, null::varchar as fault
from documents where octet_length(encode(text)) > 0""")
def artifact_chunks(spark, sf_dir):
    """Texts cut into artifact rows and put together again, with the checks of the reader."""
    texts = read(spark, sf_dir, "documents").filter(F.octet_length("text") > 0)
    rows = service.artifact_rows(texts.select(F.col("doc_id").cast("string").alias("run_id"), F.lit("text").alias("kind"), F.encode("text", "UTF-8").alias("payload")))
    return service.artifacts(rows).select("run_id", F.length("payload").cast("bigint").alias("bytes"), "chunks", "digest", "fault")


TUNED = f"""{SAMPLES}, {PARTS},
kept as (select p.* from parts p left join firsts f on f.symbol = p.symbol
  and f.part = case p.part when 'train' then 'tune' when 'tune' then 'calibration' when 'calibration' then 'test' end
  where f.origin is null or p.target_ts < f.origin)"""


@query("tuning_scores", f"""
with {TUNED}, guess as (
  select symbol, future, unnest(['persistence', 'moving-average', 'moving-average']) as family, unnest(['{{}}', '{{"window": 5}}', '{{"window": 20}}']) as spec,
         unnest([0.0, -ln(1 + x3), -ln(1 + x4)]) as y, close from kept where part = 'tune')
select symbol, family, spec, round(avg(abs(greatest(1, floor(close * exp(greatest(least(y, 0.5), -0.5)) + 0.5)) - future)) / 1e6, 3) as tuning_mae
from guess group by all""")
def tuning_scores(spark, sf_dir):
    """Candidates without a fit, as an experiment scores them before it chooses."""
    found = experiment.tuning(samples(spark, sf_dir)).filter(F.col("family").isin("persistence", "moving-average"))
    return found.select("symbol", "family", "spec", F.round("tuning_mae", 3).alias("tuning_mae"))


@query("walk_forward_mae", f"""
with {TUNED}
select symbol, mode, count(*)::bigint as n, round(avg(abs(close - future)) / 1e6, 6) as mae
from kept, (values ('holdout'), ('walk-forward')) m(mode) where part = 'test' group by all""")
def walk_forward_mae(spark, sf_dir):
    """Persistence through the whole experiment: its folds must cover the test part once."""
    chosen = spark.createDataFrame([(r.symbol, "persistence", "{}", True) for r in bars(spark, sf_dir).select("symbol").distinct().collect()], "symbol string, family string, spec string, chosen boolean")
    found = experiment.report(experiment.experiment(samples(spark, sf_dir), every=100, chosen=chosen))
    return found.select("symbol", "mode", "n", F.round("mae", 6).alias("mae"))


@query("features_incremental", f"with {FULL} select * from features where ts >= {AT}")
def features_incremental(spark, sf_dir):
    """Only the tail from a change on, with 20 bars of history: the rows equal a full run's."""
    df = bars(spark, sf_dir)
    return market.recomputed(df, df.filter(F.col("ts") >= AT).groupBy("symbol").agg(F.min("ts").alias("changed_ts")))


@query("ridge_predictions", None)
def ridge_predictions(spark, sf_dir):
    """Ridge fitted on all samples from aggregated moments, and its predictions as an expression."""
    import numpy as np

    df = samples(spark, sf_dir)
    m = market.gram(df, XS, "y").first()
    mean = np.array([m[f"m_{x}"] for x in XS])
    second = np.array([[m[f"g_{min(a, b)}_{max(a, b)}"] for b in XS] for a in XS])
    cross = np.array([m[f"g_{x}_y"] for x in XS]) - mean * m["m_y"]
    cov = second - np.outer(mean, mean)
    model = models.ridge_from_moments(mean, np.sqrt(np.diag(cov)), m["m_y"], cov, cross, 0.1)
    return df.select("symbol", "ts", market.predicted_price(F.col("close"), models.expression(model, XS)).alias("predicted"))
