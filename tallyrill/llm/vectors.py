"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A vector is scaled to unit length and padded to a power of two; three rounds of random signs
and a fast Walsh-Hadamard transform rotate it; the hash is the axis, with sign, of the largest
coordinate.  TABLES tables each join HASHES such hashes (and the label) to a bucket, whose key ends in
the table's number.  Multiprobe: a vector also looks into the buckets in which one hash is replaced by
its next PROBES best axes.

Buckets that hold the same vectors in the same roles are compared once.  A bucket's members are dealt
into blocks of BLOCK by hash, and each pair of blocks is one small group, so a hot bucket becomes many
equal groups; a task takes many groups at a time.  Cosines are in double precision, labels are compared
again at the pair, and only counts of links and a spanning set of links leave a task, never pairs.  A
pair that meets in several buckets counts in one, the smallest key of the first table, which each
side's bucket keys tell.  Vectors that are equal bit for bit, with equal labels, form a class that is
sent once, with its size.

Cases: a null or zero vector, one that holds null or non-finite components, a null vec_id or a
null label links with nothing; vectors of other lengths never link; rows that share a vec_id are
vectors of their own that share a component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.components import components
from tallyrill.llm.wordhash import mix, seeds
from tallyrill.llm.workspace import Workspace, require

TABLES, HASHES, PROBES, BLOCK = 10, 3, 1, 2048
#: Low bits of a key that hold its table; rows hashed at a time; rows of small groups compared at a time; pairs checked at a time.
TABLE_BITS, ROWS, CHUNK, PAIRS = 4, 2048, 4096, 1 << 18
#: Length of one pass of the fast transform.
RADIX = 64
INDEXED = "n long, cid binary, rep long, size long, label string, v binary, keys array<long>"
MET = "n long, id long, links long, low long"


def signs(dim: int, rounds: int) -> np.ndarray:
    return np.random.default_rng(20).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(rounds, dim))


@cache
def walsh(n: int) -> np.ndarray:
    """Orthonormal Walsh-Hadamard matrix (n a power of two)."""
    return np.ones((1, 1), dtype=np.float32) if n == 1 else np.kron(np.array([[1, 1], [1, -1]], dtype=np.float32) / np.float32(2**0.5), walsh(n // 2))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row (length a power of two), orthonormal; each pass does as many levels as RADIX has."""
    n, dim = x.shape
    radix = min(dim, RADIX)
    y = x.reshape(-1, radix) @ walsh(radix)
    if radix < dim:
        y = hadamard(y.reshape(n, -1, radix).swapaxes(1, 2).reshape(n * radix, -1)).reshape(n, radix, -1).swapaxes(1, 2)
    return y.reshape(n, dim)


def axes(x: np.ndarray, function: int, best: int, flips: np.ndarray) -> np.ndarray:
    """For each row the codes of its ``best`` largest coordinates after the function's rotation."""
    for s in flips[3 * function : 3 * function + 3]:
        x = hadamard(x * s)
    size, at, out = np.abs(x), np.arange(len(x)), []
    for _ in range(min(best, x.shape[1])):
        top = size.argmax(axis=1)
        out.append(2 * top + (x[at, top] < 0))
        size[at, top] = -1
    return np.stack(out, axis=1).astype(np.uint64)


def keys(x: np.ndarray, label_hash: np.ndarray) -> np.ndarray:
    """Bucket keys (rows, TABLES + TABLES * HASHES * PROBES): each table's own bucket, then the probes table by table."""
    main, probe = [], []
    salt, dims, last = seeds(TABLES, 11), np.uint64(x.shape[1]), np.uint64((1 << TABLE_BITS) - 1)
    dim = 1 << max(1, (x.shape[1] - 1).bit_length())
    flips = signs(dim, 3 * TABLES * HASHES)
    padded = np.pad(x.astype(np.float32), ((0, 0), (0, dim - x.shape[1])))
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            found = [axes(padded, t * HASHES + k, 1 + PROBES, flips) for k in range(HASHES)]

            def key(code, t=t):
                h = label_hash + salt[t] + dims
                for c in code:
                    h = mix(h * np.uint64(31) + c)
                return ((h & ~last) | np.uint64(t)).view(np.int64)

            first = [f[:, 0] for f in found]
            main.append(key(first))
            for k in range(HASHES):
                for p in range(1, found[k].shape[1]):
                    probe.append(key([*first[:k], found[k][:, p], *first[k + 1 :]]))
    return np.stack(main + probe, axis=1)


def _scaled(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, shorter ones padded with zeros, and their lengths.  The first byte names the type."""
    found = [np.frombuffer(v, "<f4" if v[0] == 4 else "<f8", offset=1) for v in raw]
    length = np.array([len(v) for v in found])
    x = np.zeros((len(found), length.max()))
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        x[at, :size] = np.stack([found[k] for k in at])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), length


def _unit(single: bool):
    """(vec_id, label, embedding) -> (vec_id, cid, label, v); cid and v are null for vectors that cannot link."""
    kind, head = (np.dtype("<f4"), b"\x04") if single else (np.dtype("<f8"), b"\x08")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, vectors = batch.column("label").to_pylist(), batch.column("embedding")
            flat = vectors.flatten()
            holes = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # no negative zeros
            bad = np.concatenate(([0], np.cumsum(holes | ~np.isfinite(values))))
            some = np.concatenate(([0], np.cumsum(values != 0)))
            ends = np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
            usable = (bad[ends] == bad[starts]) & (some[ends] > some[starts])
            v = [head + values[a:b].tobytes() if ok and y is not None else None for a, b, ok, y in zip(starts, ends, usable, labels, strict=True)]
            cid = [None if x is None else hashlib.md5(x + y.encode(), usedforsecurity=False).digest() for x, y in zip(v, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cid, pa.binary()), batch.column("label"), pa.array(v, pa.binary())], names=["vec_id", "cid", "label", "v"])

    return task


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            x, length = _scaled(batch.column("v").to_pylist())
            text = batch.column("label").to_pylist()
            hashed = {y: int.from_bytes(hashlib.md5(y.encode(), usedforsecurity=False).digest()[:8], "little") for y in set(text)}
            label = np.array([hashed[y] for y in text], dtype=np.uint64)
            out = np.empty(len(x), dtype=object)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                found = keys(x[at, :size], label[at])
                for k, row in zip(at, found, strict=True):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])


def _met(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of rows the smallest key of the buckets that hold both in the first table in which they meet (two probes do not meet).

    Two rows that probe each other's buckets share two of them in one table.
    """
    per = (own.shape[1] - TABLES) // TABLES
    bucket, open_ = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
    for t in range(TABLES):
        a, b = own[i[open_], t], own[j[open_], t]
        probes = slice(TABLES + t * per, TABLES + (t + 1) * per)
        in_a = (a == b) | (own[j[open_], probes] == a[:, None]).any(axis=1)
        in_b = (a == b) | (own[i[open_], probes] == b[:, None]).any(axis=1)
        meet = in_a | in_b
        bucket[open_[meet]] = np.where(in_a & in_b, np.minimum(a, b), np.where(in_a, a, b))[meet]
        open_ = open_[~meet]
    return bucket


def _pairs(start: np.ndarray, end: np.ndarray, side: np.ndarray, bi: np.ndarray, bj: np.ndarray, x: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each group that may be close; groups of one size together while they are small."""
    size = end - start
    for n in np.unique(size):
        if n < 2:
            continue
        if n <= 32:
            a, b = np.triu_indices(n, 1)
            i, j = ((start[size == n][:, None] + k[None, :]).ravel() for k in (a, b))
            ok = (bi[i] == bj[i]) | (side[i] != side[j])
            yield i[ok], j[ok]
            continue
        for s in start[size == n]:
            rows = np.arange(s, s + n)
            left, right = rows[side[s : s + n] == bi[s]], rows[side[s : s + n] == bj[s]]
            for k in range(0, len(left), 256):
                i, j = np.nonzero(x[left[k : k + 256]] @ x[right].T >= near)
                i, j = left[k : k + 256][i], right[j]
                ok = (i < j) if bi[s] == bj[s] else np.ones(len(i), dtype=bool)
                yield i[ok], j[ok]


def _compare(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Whole groups -> per vector its links there, and spanning links."""
    key, bi, bj, side, n, rep, size = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "side", "n", "rep", "size"))
    x, length = _scaled(table.column("v").to_pylist())
    label = table.column("label").combine_chunks().dictionary_encode()
    label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
    own = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
    role = own[np.arange(len(x)), key & ((1 << TABLE_BITS) - 1)] == key
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]))))
    first, second = [], []
    for left, right in _pairs(new, np.append(new[1:], len(x)), side, bi, bj, x, threshold - 1e-9):
        step = max(1, min(PAIRS, (1 << 23) // x.shape[1]))
        for k in range(0, len(left), step):
            i, j = left[k : k + step], right[k : k + step]
            ok = (role[i] | role[j]) & (label[i] == label[j]) & (length[i] == length[j]) & (n[i] != n[j])
            i, j = i[ok], j[ok]
            ok = (x[i] * x[j]).sum(axis=1) >= threshold
            i, j = i[ok], j[ok]
            ok = _met(own, i, j) == key[i]
            first.append(i[ok])
            second.append(j[ok])
    i, j = (np.concatenate([*p, np.zeros(0, dtype=int)]).astype(int) for p in (first, second))
    links = np.bincount(i, weights=size[j], minlength=len(rep)) + np.bincount(j, weights=size[i], minlength=len(rep))
    # spanning links: each vector's smallest label, until nothing moves
    order = np.argsort(rep, kind="stable")
    best = np.empty(len(rep), dtype=int)
    best[order] = np.arange(len(rep))
    while True:
        low = best.copy()
        np.minimum.at(low, i, best[j])
        np.minimum.at(low, j, best[i])
        low = np.minimum(low, low[order[low]])
        if (low == best).all():
            break
        best = low
    keep = links > 0
    made = (n[keep], rep[keep], links[keep].astype(np.int64), rep[order[best]][keep])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["n", "id", "links", "low"])


def _compared(threshold: float):
    """Rows in the order of their groups -> ``_compare`` of about CHUNK rows of whole groups at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            group = np.stack([table.column(c).to_numpy() for c in ("key", "bi", "bj")])
            new = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            if len(new):  # the last group may go on in the next batch
                yield _compare(table.slice(0, new[-1]), threshold)
                table = table.slice(new[-1])
            held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield _compare(pa.Table.from_batches(held), threshold)

    return task


def near_vectors(df: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    spark = df.sparkSession
    ws = Workspace(spark, "vectors")
    single = df.schema["embedding"].dataType.elementType == T.FloatType()
    rows = require(df, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>"))
    rows = rows.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))  # without an id, links with nothing
    unit = rows.mapInArrow(_unit(single), "vec_id long, cid binary, label string, v binary")
    member = ws.table(unit.select("vec_id", "cid"), "member")
    classes = unit.filter("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = classes.select(F.monotonically_increasing_id().alias("n"), "cid", "rep", "size", "label", "v")
    index = ws.table(classes.mapInArrow(_indexed, INDEXED), "index")
    places = index.select("n", F.posexplode("keys").alias("p", "key")).select("n", "key", (F.col("p") < TABLES).alias("own"))
    # buckets with two members or more, one of them not only probing
    live = places.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("any")).filter("m > 1 and any").select("key", "m")
    members = ws.table(places.join(live, "key"), "members")
    # of buckets with the same members in the same roles, the smallest key of the first table: no pair's own bucket is lost
    marks = [F.sum(F.xxhash64("n", "own", F.lit(k)) % (1 << 40)).alias(f"mark{k}") for k in range(3)]
    alike = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *marks)
    order = F.struct(F.col("key").bitwiseAND((1 << TABLE_BITS) - 1), "key")
    chosen = alike.groupBy("m", "mark0", "mark1", "mark2").agg(F.min_by("key", order).alias("key")).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    dealt = members.select("n", "key").join(chosen, "key").withColumn("side", F.pmod(F.xxhash64("n", "key"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("n", "key", "side", F.least("side", "o").alias("bi"), F.greatest("side", "o").alias("bj"))
    dealt = dealt.join(index.drop("cid"), "n").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    met = ws.table(dealt.mapInArrow(_compared(threshold), MET), "met")
    links = met.groupBy("n").agg(F.sum("links").alias("links"))
    found = components(ws, met.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")), "components")
    perclass = index.select("n", "cid", "size", F.col("rep").alias("id")).join(links, "n", "left").join(found, "id", "left")
    perclass = ws.table(perclass.select("cid", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component")), "per-class")
    ws.drop("members", "met")
    # a vector alone in its class comes back by a join on its class, one that links with nothing has none
    out = member.join(perclass, "cid", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
