"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group.  Groups over HEAVY of a shard's share in some dimension are units of
their own, at most 3 x shards / HEAVY of them; all other groups fall by the hash of their text into
shards x TILES tiles, which are units too.  A group above a whole shard's share is split by the hash
of doc_id into parts of about half a share.  The number of units is so bounded by the parameters,
whatever the table holds, and the driver packs them: largest first, each to the shard where the
dot product of its vector with the residual capacities is highest among those it fits in; where it fits in
none, to the one left fullest last (highest dot product of all).  Moves and swaps of units between shards
then even out bytes, tokens and rows jointly.

Law kept: ``bytes`` - the shards' sizes are near equal.

A row's slot is the number of rows before it in its shard: whole sub-buckets before it, and its
rank in its own, so no shard is ever sorted in one task.

Cases: null text has 8 bytes and no tokens and groups with other null texts; null doc_ids sort first;
repeated rows take slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.llm.workspace import Workspace, require

SHARDS, TILES, HEAVY = 24, 256, 1 / 64
#: Weights of bytes, tokens and rows when shards are evened out, steps for each shard, shards tried in a step, and the share at which one is even.
EVEN, STEPS, TRIES, NEAR_EVEN = (2.0, 1.0, 1.0), 40, 24, 2e-4
#: Rows of one sub-bucket when slots are numbered.
ROWS_OF_BUCKET = 20_000


def pack(vectors: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each unit (rows: bytes, tokens, rows)."""
    capacity = vectors.sum(axis=0) / shards
    unit = vectors / np.where(capacity > 0, capacity, 1)
    residual = np.ones((shards, vectors.shape[1])) * (capacity > 0)
    out = np.zeros(len(unit), dtype=int)
    for k in np.argsort(-unit.max(axis=1), kind="stable"):
        gain = residual @ unit[k]
        fits = (residual >= unit[k] - 1e-9).all(axis=1)
        pick = np.where(fits, gain, -np.inf) if fits.any() else gain
        out[k] = int(np.argmax(pick))
        residual[out[k]] -= unit[k]
    return evened(unit, residual, out)


def evened(unit: np.ndarray, residual: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Move or swap units between two shards while that lowers the sum of their squared weighted residuals, in all dimensions jointly.

    Each step takes the shard furthest from even and tries the others, those that differ most from it first.
    """
    weight = np.array(EVEN[: unit.shape[1]])
    unit, residual, settled = unit * weight, residual * weight, set()
    for _ in range(STEPS * len(residual)):
        off = (residual**2).sum(axis=1)
        worst = next((int(s) for s in np.argsort(-off) if int(s) not in settled), None)
        if worst is None or off[worst] < NEAR_EVEN**2:
            break
        mine = np.flatnonzero(out == worst)
        give = np.vstack([np.zeros(unit.shape[1]), unit[mine]])
        for other in np.argsort(residual @ residual[worst])[:TRIES]:
            if other == worst:
                continue
            theirs = np.flatnonzero(out == other)
            take = np.vstack([np.zeros(unit.shape[1]), unit[theirs]])
            # with d = give - take, |worst + d|^2 + |other - d|^2 falls by -2 d.(worst - other) - 2 d.d
            gap = residual[worst] - residual[other]
            fall = -2 * ((give @ gap)[:, None] - (take @ gap)[None, :]) - 2 * ((give**2).sum(axis=1)[:, None] + (take**2).sum(axis=1)[None, :] - 2 * give @ take.T)
            i, j = np.unravel_index(int(fall.argmax()), fall.shape)
            if fall[i, j] <= 1e-10:
                continue
            moved = give[i] - take[j]
            residual[worst] += moved
            residual[other] -= moved
            if i:
                out[mine[i - 1]] = other
            if j:
                out[theirs[j - 1]] = worst
            settled -= {worst, int(other)}
            break
        else:
            settled.add(worst)
    return out


def shard(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot) for every row of (doc_id, text)."""
    spark = df.sparkSession
    ws = Workspace(spark, "sharding")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    group = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = ws.table(require(df, "doc_id", "text").select("doc_id", (F.length(raw) + 8).cast("long").alias("size"), tokens.cast("long").alias("tokens"), F.crc32(raw).alias("text_crc32"), group.alias("g")), "rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    dims = {"size": total["size"], "tokens": total["tokens"], "rows": total["rows"]}
    sums = rows.groupBy("g").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    share = F.greatest(*(F.col(c) * shards / max(1, t) for c, t in dims.items()), F.lit(0.0))
    parts = F.when(F.col("share") > 1, F.ceil(F.col("share") * 2)).otherwise(1).cast("int")
    heavy = ws.table(sums.withColumn("share", share).filter(F.col("share") > HEAVY).select("g", parts.alias("parts")), "heavy")
    # at most 3 x shards / HEAVY rows of 12 bytes
    unit = F.when(F.col("parts").isNull(), F.pmod("g", F.lit(shards * TILES))).otherwise(F.col("g"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    keyed = rows.join(F.broadcast(heavy), "g", "left").select("doc_id", "size", "tokens", "text_crc32", "g", F.col("parts").isNotNull().alias("own"), unit.alias("unit"), part.alias("part"))
    units = keyed.groupBy("own", "unit", "part").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    found = sorted(units.collect(), key=lambda r: (r.own, r.unit, r.part))  # at most shards x (TILES + 3 / HEAVY + 6)
    where = pack(np.array([[r["size"], r["tokens"], r["rows"]] for r in found], dtype=float).reshape(-1, 3), shards) if found else []
    table = spark.createDataFrame([(r.own, r.unit, r.part, int(s)) for r, s in zip(found, where, strict=True)], "own boolean, unit long, part int, shard int")
    n = max(1, -(-dims["rows"] // (shards * ROWS_OF_BUCKET)))
    placed = keyed.join(F.broadcast(table), ["own", "unit", "part"]).withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(n)).cast("int"))
    counts = placed.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select("shard", "b", (F.sum("k").over(Window.partitionBy("shard").orderBy("b")) - F.col("k")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "g", "size")))
    return ranked.join(before, ["shard", "b"]).select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))
