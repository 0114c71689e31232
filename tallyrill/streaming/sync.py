"""Resumable sync of series from a paged provider into the store.

A series is read in windows of as many bars as one request may give.  Each window is one
transaction that upserts its bars, recomputes the feature tail and moves the checkpoint, so a
failure loses no more than the window it happens in and the next run goes on from there,
``overlap`` bars back, which lets late corrections in.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from tallyrill.operators.engine import Engine
from tallyrill.sources.store import StoreError
from tallyrill.streaming.incremental import apply_batch

MAX_OVERLAP = 100
TABLES = (
    "create table bars (symbol string, ts int, open int, high int, low int, close int, volume int, primary key (symbol, ts))",
    "create table features (symbol string, ts int, return_1_ppm int, return_5_ppm int, sma_5 int, sma_20 int, volatility_20_ppm int, rsi_14_ppm int, volume_sma_20 int, primary key (symbol, ts))",
    "create table watermarks (symbol string, last_ts int, primary key (symbol))",
    "create table checkpoints (source string, symbol string, last_ts int, rows_ingested int, primary key (source, symbol))",
    "create table runs (run_id string, source string, symbol string, status string, pages int, received int, inserted int, updated int, unchanged int, error string, started_at int, finished_at int, primary key (run_id))",
)


class Provider(Protocol):
    """Where bars come from: (symbol, ts, open, high, low, close, volume) of [first, last]."""

    name: str
    max_points: int

    def bars(self, symbol: str, first: int, last: int) -> DataFrame: ...


def set_up(engine: Engine) -> None:
    """Create the tables that are missing."""
    there = {t.name for t in engine.tables()}
    for text in TABLES:
        if text.split()[2] not in there:
            engine.execute(text)


def windows(first: int, last: int, period: int, max_points: int) -> list[tuple[int, int]]:
    """Closed windows of at most ``max_points`` bars that cover [first, last]."""
    if period <= 0 or max_points < 1:
        raise ValueError("period and points must be positive")
    out = []
    while first <= last:
        out.append((first, min(last, first + (max_points - 1) * period)))
        first = out[-1][1] + period
    return out


def resume_from(engine: Engine, source: str, symbol: str, first: int, period: int, overlap: int = 2) -> int:
    """Where a run that asks for bars from ``first`` on begins, given what is stored."""
    if not 0 <= overlap <= MAX_OVERLAP:
        raise ValueError(f"overlap must be from 0 to {MAX_OVERLAP}")
    held = engine.begin().frame("checkpoints").filter(f"source = '{source}' and symbol = '{symbol}'").first()
    return first if held is None else max(first, held.last_ts - overlap * period)


def sync(engine: Engine, provider: Provider, symbol: str, first: int, last: int, period: int, run_id: str, overlap: int = 2, clock: Callable[[], float] = time.time) -> dict[str, int]:
    """Read [first, last]; counts of pages and of bars by class.  A failure is recorded in the run's row and raised."""
    spark, started = engine.spark, int(clock())
    counts = {"pages": 0, "received": 0, "inserted": 0, "updated": 0, "unchanged": 0}

    def record(status: str, error: str) -> None:
        row = (run_id, provider.name, symbol, status, *(counts[k] for k in ("pages", "received", "inserted", "updated", "unchanged")), error, started, int(clock()))
        engine.run(lambda tx: tx.put("runs", spark.createDataFrame([row], tx.frame("runs").schema)))

    try:
        for lo, hi in windows(resume_from(engine, provider.name, symbol, first, period, overlap), last, period, provider.max_points):
            page = provider.bars(symbol, lo, hi)
            found = apply_batch(engine, page)
            counts["pages"] += 1
            for k in ("inserted", "updated", "unchanged"):
                counts[k] += found.get(k, 0)
                counts["received"] += found.get(k, 0)
            newest = page.agg({"ts": "max"}).first()[0]
            if newest is not None:
                engine.run(lambda tx, at=newest: advance(tx, provider.name, symbol, at, counts["received"]))
    except Exception as error:
        record("failed", f"{type(error).__name__}: {error}"[:500])
        raise
    record("done", "")
    return counts


def advance(tx, source: str, symbol: str, last_ts: int, rows: int) -> None:
    """Move a checkpoint forward; it never goes back."""
    frame = tx.frame("checkpoints")
    old = frame.filter(f"source = '{source}' and symbol = '{symbol}'").first()
    row = (source, symbol, max(last_ts, old.last_ts if old else last_ts), rows)
    tx.put("checkpoints", tx.spark.createDataFrame([row], frame.schema))


def sync_all(engine: Engine, provider: Provider, symbols: list[str], first: int, last: int, period: int, run_id: str, **options) -> tuple[dict[str, dict[str, int]], dict[str, str]]:
    """Every symbol in turn; one that fails doesn't stop the others: (counts, errors) by symbol."""
    done, failed = {}, {}
    for symbol in symbols:
        try:
            done[symbol] = sync(engine, provider, symbol, first, last, period, f"{run_id}:{symbol}", **options)
        except (StoreError, ValueError, OSError, RuntimeError) as error:
            failed[symbol] = str(error)
    return done, failed
