"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct word shingles.  Documents with equal sets
form a class, and only the class's smallest doc_id goes on.  Its sketch fills T bins: in round
r < T every element is thrown into a hashed bin with the value r + hash, in round T + r every
element goes to bin r; a bin keeps its smallest value and the rounds end when all bins are
full, so every coordinate fills, after O(n + T log T) throws in expectation, and the share of
equal coordinates estimates the Jaccard similarity with Chernoff-type bounds.

BANDS bands of ROWS coordinates give candidate buckets.  At similarity 0.8 a pair shares no
band with probability (1 - 0.8^6)^40 = 5e-6.  Buckets never emit their pairs.  First every member
is held against one pivot, the smallest of its buckets' smallest ids, on full sets; most groups of copies are
one component then, and their buckets are done.  Members of buckets that still span several components
form clusters (a member hangs on its smallest pivot, and the pivots of its other buckets hang on that one).  A cluster is dealt by size class
(two sizes at similarity 0.8 lie in the same or in neighbouring classes) and hash into blocks, and
each pair of blocks is one bounded group that compares full sets of different components and
returns a spanning set of links.  So every candidate is verified, with no cap, and what leaves
a group grows with its documents, not with its pairs.

Cases: null or empty text, or one without words, has an empty set and is linked with nothing;
a null doc_id is linked with nothing and is kept (its component is null); rows that share a
doc_id count as one document with the links of all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.llm.components import components
from tallyrill.llm.wordhash import NOT_SPACE, Words, chunks, mix, seeds, shingle_sets
from tallyrill.llm.workspace import Workspace, require

BANDS, ROWS = 40, 6
T = BANDS * ROWS
#: Most documents of a block, and about the most shingles of all its documents.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Members that one copy of a pivot's set is compared with.
PIVOTED = 512
SKETCH = "doc_id long, n long, f1 long, f2 long, bands array<long>"


def sketch(sets: list[np.ndarray], bins: int = T) -> np.ndarray:
    """One row of ``bins`` values for each non-empty set of distinct 64-bit hashes."""
    out = np.full(len(sets) * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    empty = out[:1].copy()[0]
    element = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    salts = seeds(2 * bins, 5)
    with np.errstate(over="ignore"):
        for r in range(2 * bins):
            h = mix(element ^ salts[r])
            place = (h >> np.uint64(40)) % np.uint64(bins) if r < bins else np.full(len(element), r - bins, dtype=np.uint64)
            np.minimum.at(out, owner * bins + place.astype(np.int64), (np.uint64(r) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
            open_sets = (out.reshape(-1, bins) == empty).any(axis=1)
            if not open_sets.any():
                break
            live = open_sets[owner]
            if not live.all():
                element, owner = element[live], owner[live]
    return out.reshape(-1, bins)


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each sketch and band."""
    with np.errstate(over="ignore"):
        parts = sketches.reshape(len(sketches), bands, rows) * seeds(rows, 6)
        return mix(parts.sum(axis=2, dtype=np.uint64) + seeds(bands, 7)).view(np.int64)


def _signatures(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in chunks(t.as_py() for t in batch.column("text")):
                sets = list(shingle_sets(Words(texts, NOT_SPACE), width))
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = band_keys(sketch([sets[k] for k in full]))
                bands: list = [None] * len(sets)
                for k, row in zip(full, keys, strict=True):
                    bands[k] = row
                with np.errstate(over="ignore"):
                    f1 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    f2 = [int(np.bitwise_xor.reduce(mix(s + np.uint64(12345))).view(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return task


def _sets(width: int):
    """(id, text) -> (id, s): the sorted distinct shingle hashes as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for at, texts in chunks(t.as_py() for t in batch.column("text")):
                sets = pa.array([s.tobytes() for s in shingle_sets(Words(texts, NOT_SPACE), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), sets], names=["id", "s"])

    return task


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 |X and Y| >= percent |X or Y|."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(percent: int):
    """Rows (a, part, id, s) of one pivot after the other, the pivot's own first -> pairs (a, b) of similar full sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            sets, part = batch.column("s"), batch.column("part").to_pylist()
            for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                mine = _set(sets[k].as_py())
                if a == b:
                    pivots = [*(pivots if at == (a, part[k]) else []), mine]
                    at = (a, part[k])
                elif any(_similar(p, mine, percent) for p in pivots):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return task


def _spanning(percent: int):
    """One pair of blocks -> links that join its components, verified on full sets."""

    def task(table: pa.Table) -> pa.Table:
        ids, comp = (table.column(c).to_numpy() for c in ("id", "c"))
        sets = [_set(s) for s in table.column("s").to_pylist()]
        size = np.array([len(s) for s in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(size) - size
        left = np.flatnonzero(np.array(table.column("left").to_pylist()))
        right = np.flatnonzero(np.array(table.column("right").to_pylist()) & (size > 0))
        if not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        other = np.concatenate([code[begin[j] : begin[j] + size[j]] for j in right])
        starts = np.cumsum(size[right]) - size[right]
        root = np.unique(comp, return_inverse=True)[1]  # present component, joined as links turn up
        mark, found = np.zeros(int(code.max()) + 1, dtype=bool), []
        for i in left:
            if (root[right] == root[i]).all():
                continue
            mine = code[begin[i] : begin[i] + size[i]]
            mark[mine] = True
            both = np.add.reduceat(mark[other].astype(np.int64), starts)
            mark[mine] = False
            for j in right[100 * both >= percent * (size[i] + size[right] - both)]:
                if root[j] != root[i]:
                    found.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return task


class Finder:
    """Classes, buckets and links of one corpus."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.ws = Workspace(docs.sparkSession, "neardup")
        self.docs, self.width, self.percent = docs.filter("doc_id is not null"), width, percent

    def signatures(self) -> DataFrame:
        return self.ws.table(self.docs.mapInArrow(_signatures(self.width), SKETCH), "signatures")

    def classes(self, signed: DataFrame) -> DataFrame:
        """Fingerprints of several documents with their smallest id."""
        found = signed.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
        return self.ws.table(found.filter("size > 1").drop("size"), "classes")

    def buckets(self, signed: DataFrame, classes: DataFrame) -> DataFrame:
        """(key, id, n) of the representatives in buckets of at least two."""
        reps = signed.filter("n > 0").join(classes, ["n", "f1", "f2"], "left").filter("rep is null or rep = doc_id")
        members = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), "n")
        shared = members.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key")
        return self.ws.table(members.join(shared, "key"), "buckets-0")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, s): the full shingle sets of the ids, computed once; several for an id that has several texts."""
        texts = self.docs.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").select("id", "text")
        return self.ws.table(texts.mapInArrow(_sets(self.width), "id long, s binary").distinct(), "sets")

    def against_pivots(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among the pairs (a, b), one for each b.  A pivot's set goes once to each PIVOTED of its members."""
        counted = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOTED).cast("int").alias("parts"))
        part = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
        members = pairs.join(counted, "a").select("a", F.col("b").alias("id"), part("b").alias("part"))
        pivots = counted.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = members.unionByName(pivots).join(sets, "id").select("a", "part", "id", "s")
        ordered = dealt.repartition("a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"))
        return self.ws.table(ordered.mapInArrow(_linked(self.percent), "a long, b long"), "edges-pivots")

    def in_blocks(self, rest: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between different components among the members of open buckets, cluster by cluster."""
        # a document hangs on the smallest head of its buckets; the heads of its other buckets hang on that one
        headed = rest.select("id", "first", F.min("first").over(Window.partitionBy("id")).alias("head"))
        chained = headed.select(F.col("head").alias("a"), "id").distinct().select("a", F.col("id").alias("b")).unionByName(headed.filter("first <> head").select(F.col("head").alias("a"), F.col("first").alias("b")).distinct())
        cluster = components(self.ws, chained, "clusters")
        members = rest.select("id", "n", "c").distinct().join(cluster.select("id", F.col("component").alias("g")), "id")
        members = self.ws.table(members.select("id", "n", "c", "g", F.floor(F.log("n") / F.log(F.lit(100.0 / self.percent)) + 1e-9).cast("int").alias("z")), "members")
        docs = F.greatest(F.lit(8), F.least(F.lit(BLOCK), (BLOCK_SHINGLES / F.max("n")).cast("int")))
        sizes = self.ws.table(members.groupBy("g", "z").agg(F.ceil(F.count(F.lit(1)) / docs).cast("int").alias("nb")), "sizes")
        own = members.join(sizes, ["g", "z"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        # the blocks that a member's block meets: of its class, of the next larger and of the next smaller one
        met = []
        for step in (0, 1, -1):
            other = sizes.select("g", (F.col("z") - step).alias("z"), F.col("nb").alias("onb"))
            each = own.join(other, ["g", "z"]).withColumn("ob", F.explode(F.sequence(F.lit(0), F.col("onb") - 1)))
            mine, theirs = F.struct("z", "b"), F.struct((F.col("z") + step).alias("z"), F.col("ob").alias("b"))
            met.append(each.select("g", "id", "c", mine.alias("side"), F.least(mine, theirs).alias("x"), F.greatest(mine, theirs).alias("y")))
        dealt = met[0].unionByName(met[1]).unionByName(met[2])
        dealt = dealt.select("g", "id", "c", (F.col("side") == F.col("x")).alias("left"), (F.col("side") == F.col("y")).alias("right"), "x", "y").join(sets, "id")
        return dealt.groupBy("g", "x", "y").applyInArrow(_spanning(self.percent), "a long, b long")

    def _close(self, p: str, m: str):
        """Sizes that allow the similarity."""
        return (F.col(p) * 100 >= F.col(m) * self.percent) & (F.col(m) * 100 >= F.col(p) * self.percent)

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(signed documents, (id, component) of linked representatives, classes)."""
        signed = self.signatures()
        classes = self.classes(signed)
        active = self.buckets(signed, classes)
        sets = self.sets(active.select("id").distinct())
        # every document is held against the smallest of its buckets' heads that is near its size
        pivots = active.groupBy("key").agg(F.min_by(F.struct("id", "n"), "id").alias("p")).select("key", F.col("p.id").alias("p"), F.col("p.n").alias("pn"))
        pairs = active.join(pivots, "key").filter((F.col("p") != F.col("id")) & self._close("pn", "n")).groupBy("id").agg(F.min("p").alias("a"))
        pairs = self.ws.table(pairs.select("a", F.col("id").alias("b")), "pairs")
        links = self.against_pivots(pairs, sets)
        found = components(self.ws, links, "components-0")
        placed = active.join(found.select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
        several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("first")).filter("lo < hi").select("key", "first")
        rest = self.ws.table(placed.join(several, "key"), "rest")
        if rest.limit(1).count():
            links = self.ws.table(links.unionByName(self.in_blocks(rest, sets)), "links")
            found = components(self.ws, links, "components-1")
            self.ws.drop("links")
        self.ws.drop("edges-pivots", "pairs", "rest")
        self.ws.drop("buckets-0", "sets", "members", "sizes")
        return signed, found, classes


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    docs = require(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    finder = Finder(docs, width, percent)
    signed, found, classes = finder.run()
    signed = signed.select("doc_id", "n", "f1", "f2")
    # a class's documents take the component of its representative
    joined = signed.join(classes, ["n", "f1", "f2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("id"))
    joined = joined.join(found, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    joined = joined.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lone = docs.filter("doc_id is null").mapInArrow(_signatures(width), SKETCH).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return joined.unionByName(lone)
