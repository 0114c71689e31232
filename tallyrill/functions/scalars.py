"""Fixed-point prices, symbols, intervals, bar rules and digests as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000
#: Seconds of each interval; a month counts 31 days.
INTERVAL_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1wk": 604800, "1mo": 2678400}


def scale_price(x: Column) -> Column:
    """Fixed point with six digits, half away from zero; null for NaN, infinities, zero, negatives and overflow."""
    good = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x * SCALE < float(1 << 63))
    return F.when(good, F.round(x * SCALE).cast("bigint"))


def unscale_price(x: Column) -> Column:
    return x / F.lit(float(SCALE))


def normalize_symbol(x: Column) -> Column:
    """Trimmed and upper-case; null unless 1 to 32 of A-Z 0-9 . ^ = / -."""
    up = F.upper(F.trim(x))
    return F.when(up.rlike(r"^[A-Z0-9.^=/-]{1,32}$"), up)


def normalize_interval(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin(*INTERVAL_SECONDS), low)


def interval_seconds(x: Column) -> Column:
    return F.create_map(*(F.lit(v) for pair in INTERVAL_SECONDS.items() for v in pair))[x]


def ratio_ppm(a: Column, b: Column) -> Column:
    """round((a / b - 1) 10^6)."""
    return F.round((a / b - 1) * SCALE).cast("bigint")


def scaled_ratio(v: Column, num: Column, den: Column) -> Column:
    """(v num + den / 2) div den in exact decimals."""
    wide = lambda c: c.cast("decimal(38,0)")
    half = F.floor(den.cast("decimal(38,0)") / 2)
    return F.floor((wide(v) * wide(num) + half) / wide(den)).cast("bigint")


def bar_rule(o: str = "open", h: str = "high", low: str = "low", c: str = "close", v: str = "volume", source: str = "source", ts: str | None = None, adjusted: str | None = None) -> Column:
    """The first rule that a bar breaks, or null; time and adjusted close count where they are named."""
    o, h, low, c, v = (F.col(x) for x in (o, h, low, c, v))
    out = F.when(F.col(ts) <= 0, "time not positive") if ts else F
    out = out.when((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), "price not positive")
    if adjusted:  # none given means that of the close
        out = out.when(F.coalesce(F.col(adjusted), c) < 0, "adjusted close negative")
    return out.when((h < o) | (h < c) | (h < low), "high below").when((low > o) | (low > c), "low above").when(v < 0, "volume negative").when(F.trim(F.col(source)) == "", "no source")


def adjusted_close(adjusted: Column, close: Column) -> Column:
    """The adjusted close, the close itself where none (null or 0) is given."""
    return F.when(adjusted.isNull() | (adjusted == 0), close).otherwise(adjusted)


def bounded(x: Column, n: int) -> Column:
    """The first n bytes of a text, less a character cut in two."""
    return F.when(F.octet_length(x) <= n, x).otherwise(F.regexp_replace(F.try_validate_utf8(F.decode(F.substring(x.cast("binary"), 1, n), "UTF-8")), "�+$", ""))
