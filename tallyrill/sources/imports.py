"""Bars and corporate actions from CSV and from saved provider replies, as plans.

Every row is parsed by Columns and gets the first rule it breaks; a batch is written only if
no row breaks one.  Line numbers are prefix sums over the file's splits, so a file of any
size is read in parallel.
"""

from __future__ import annotations

import csv
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrill.functions.scalars import bar_rule, normalize_interval, normalize_symbol, scale_price

NEEDED, OPTIONAL = ("timestamp", "open", "high", "low", "close", "volume"), ("adjusted_close",)
PRICES = ("open", "high", "low", "close", "adjusted_close")
#: Shapes of a text time and how each is read, zone included.
TIMES = (
    (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd XXX", " +00:00"),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss XXX", " +00:00"),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$", "yyyy-MM-dd'T'HH:mm:ssXXX", ""),
)


class RowError(ValueError):
    """The first row, in file order, that can't be taken."""

    def __init__(self, line: int, reason: str):
        super().__init__(f"line {line}: {reason}")
        self.line, self.reason = line, reason


def unix_time(x: Column) -> Column:
    """Unix seconds from whole seconds, a date, a time in UTC or one with its zone; else null."""
    x = F.trim(x)
    out = F.when(x.rlike(r"^-?\d+$"), x.try_cast("bigint"))
    for shape, form, zone in TIMES:
        out = out.when(x.rlike(shape), F.unix_timestamp(F.try_to_timestamp(F.concat(x, F.lit(zone)), F.lit(form))))
    return out


def price(x: Column) -> Column:
    return scale_price(F.trim(x).try_cast("double"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file; numbers from 1.

    A split's rows have consecutive ids, so a row's number is its distance from its split's
    first plus the rows of earlier splits: a running sum over one row for each split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = splits.select("split", "first", (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("before"))
    return raw.join(before, "split").select((F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def header_of(first: str) -> list[str]:
    """Column names of a header line, lower-cased; any order."""
    names = [c.strip().lower() for c in next(csv.reader([first.lstrip("\ufeff")]))]
    missing = [c for c in NEEDED if c not in names]
    if missing:
        raise RowError(1, f"missing columns {', '.join(missing)}")
    if len({*names}) != len(names):
        raise RowError(1, "a column appears twice")
    return names


def csv_bars(spark: SparkSession, path: str, symbol: str, interval: str, source: str = "csv") -> DataFrame:
    """Bars of one series with ``line`` and ``error`` (null where the row is good).

    Records are single lines.  An empty table or one without a header is an error of line 1.
    """
    head = spark.read.text(path).first()
    if head is None:
        raise RowError(1, "no header")
    names = header_of(head.value)
    # more fields than the header has are an error, so the record gets one field to catch them
    schema = ", ".join(f"c{k} string" for k in range(len(names) + 1))
    rows = numbered_lines(spark, path).filter((F.col("line") > 1) & (F.trim("value") != ""))
    rows = rows.withColumn("r", F.from_csv("value", schema)).select("line", F.col(f"r.c{len(names)}").alias("extra"), *(F.col(f"r.c{k}").alias(n) for k, n in enumerate(names) if n in NEEDED + OPTIONAL))
    if "adjusted_close" not in names:
        rows = rows.withColumn("adjusted_close", F.col("close"))
    rows = rows.withColumn("adjusted_close", F.when(F.trim("adjusted_close") == "", F.col("close")).otherwise(F.col("adjusted_close")))
    parsed = rows.select(
        "line", "extra", normalize_symbol(F.lit(symbol)).alias("symbol"), normalize_interval(F.lit(interval)).alias("interval"), unix_time(F.col("timestamp")).alias("ts"),
        *(price(F.col(c)).alias(c) for c in PRICES), F.trim("volume").try_cast("bigint").alias("volume"), F.lit(source).alias("source"),
    )
    return parsed.withColumn("error", broken_rule()).drop("extra")


def broken_rule() -> Column:
    """The first thing wrong with a parsed row, or null."""
    return F.coalesce(
        F.when(F.col("extra").isNotNull(), "too many fields"),
        F.when(F.col("symbol").isNull(), "symbol"),
        F.when(F.col("interval").isNull(), "interval"),
        F.when(F.col("ts").isNull(), "timestamp"),
        *(F.when(F.col(c).isNull(), c) for c in PRICES),
        F.when(F.col("volume").isNull(), "volume"),
        bar_rule(),
    )


def checked(rows: DataFrame) -> DataFrame:
    """The rows without line and error; raises for the first bad one before any is given."""
    bad = rows.filter("error is not null").agg(F.min(F.struct("line", "error")).alias("e")).first().e
    if bad is not None:
        raise RowError(bad.line, bad.error)
    return rows.drop("line", "error")


def reply_bars(raw: DataFrame, interval: str = "1d", source: str = "provider") -> DataFrame:
    """Bars from saved replies: (symbol, body), body a JSON object with ``values`` of text prices."""
    item = "array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>"
    each = raw.select("symbol", F.posexplode(F.from_json("body", f"struct<values:{item}>")["values"]).alias("pos", "v"))
    parsed = each.select(
        F.col("pos").cast("bigint").alias("line"), F.lit(None).cast("string").alias("extra"), normalize_symbol(F.col("symbol")).alias("symbol"), normalize_interval(F.lit(interval)).alias("interval"),
        unix_time(F.col("v.datetime")).alias("ts"), *(price(F.col(f"v.{c.removeprefix('adjusted_')}")).alias(c) for c in PRICES), F.coalesce(F.col("v.volume"), F.lit("0")).try_cast("bigint").alias("volume"), F.lit(source).alias("source"),
    )
    return parsed.withColumn("error", broken_rule()).drop("extra")


def reply_actions(raw: DataFrame, source: str = "provider") -> DataFrame:
    """Splits and dividends of saved replies (symbol, body) as one table, with the digest of the reply they came from."""
    shape = "struct<splits:array<struct<date:string,from_factor:bigint,to_factor:bigint>>,dividends:array<struct<ex_date:string,amount:string,currency:string>>>"
    read = raw.select(normalize_symbol(F.col("symbol")).alias("symbol"), F.from_json("body", shape).alias("r"), F.sha2("body", 256).alias("raw_digest"))
    s = read.select("symbol", "raw_digest", F.explode("r.splits").alias("x")).select("symbol", F.lit("split").alias("action_type"), unix_time(F.col("x.date")).alias("ex_date"), F.lit(0).cast("bigint").alias("amount"), F.lit("").alias("currency"), F.col("x.from_factor").alias("split_from"), F.col("x.to_factor").alias("split_to"), "raw_digest")
    d = read.select("symbol", "raw_digest", F.explode("r.dividends").alias("x")).select("symbol", F.lit("dividend").alias("action_type"), unix_time(F.col("x.ex_date")).alias("ex_date"), price(F.col("x.amount")).alias("amount"), F.coalesce(F.col("x.currency"), F.lit("")).alias("currency"), F.lit(0).cast("bigint").alias("split_from"), F.lit(0).cast("bigint").alias("split_to"), "raw_digest")
    return s.unionByName(d).withColumn("source", F.lit(source))


class Busy(RuntimeError):
    """A reply that asks to come again, after so many seconds where it says so."""

    def __init__(self, after: float | None = None):
        super().__init__("try again")
        self.after = after


def pause(attempt: int, after: float | None = None) -> float:
    """Seconds before the next attempt: a quarter, doubling, five at most, or what the reply asked for."""
    return min(5.0, 0.25 * 2**attempt if after is None else after)


def fetched(get: Callable[[], str], attempts: int = 4, sleep: Callable[[float], None] = time.sleep, limit: int = 32 << 20) -> str:
    """One reply's text; ``get`` raises ``Busy`` to be called again."""
    for attempt in range(attempts):
        try:
            body = get()
        except Busy as e:
            if attempt + 1 == attempts:
                raise
            sleep(pause(attempt, e.after))
            continue
        if len(body) > limit:
            raise ValueError(f"a reply of more than {limit} characters")
        return body
    raise ValueError("no attempts")
