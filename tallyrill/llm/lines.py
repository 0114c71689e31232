"""Corpus-wide line deduplication over levelled sorted runs of line hashes.

A line's key is the line without [\x20\x09-\x0D] at both ends and with A-Z lower-cased; keys
of at least ``min_length`` code points count.  A key is held as a 128-bit hash.  A run is a
table sorted by hash with, per hash, the number of documents that hold it and the largest
doc_id among them.

Documents enter in batches of descending doc_id.  A hash is settled once some run counts ``min_docs``
documents for it: its keeper, the largest doc_id, is in that run or an earlier one, and no further
document can change either.  Each batch merge-anti-joins the runs' settled hashes and adds what is left
as a run of level 0, so a line that stands in every document is stored, sorted and compacted for
the first batches only.  FANOUT runs of a level are compacted into one of the next (counts add up, keepers take the
maximum), so a run is rewritten once a level, O(log batches) times.  After the last batch all
runs compact into the list of repeated keys.

Everything runs on DataFrame functions.  A hot line is pre-aggregated before every shuffle,
and the joins that bring repeated keys back to documents are plain equi-joins that adaptive
execution splits.  Texts move once, and only those of documents that lose lines.

Cases: null or empty text is one empty line; a null doc_id sorts below all and its document
loses repeated lines unless every holder has a null id; rows that share a doc_id are documents
of their own that keep or lose lines alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.llm.workspace import Workspace, require

NULL_ID = -(1 << 63)
#: Runs of a level that compact into one of the next; below the number of batches, so that compaction happens as batches come.
FANOUT = 2
BLANK = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The comparison key of a line (a Column)."""
    blanks = " \t\n\x0b\x0c\r"
    return F.translate(F.call_function("btrim", line, F.lit(blanks)), UPPER, LOWER)


def line_hash(key):
    """128 bits as a struct of two longs with independent seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(77), key).alias("h2"))


def _long_hashes(lines, min_length: int):
    """Hashes of the lines whose key counts; null for the others."""
    return F.transform(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_length), line_hash)


def entries(df: DataFrame, min_length: int) -> DataFrame:
    """(h1, h2, doc): each document's distinct counted keys."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    keys = F.array_distinct(_long_hashes(lines, min_length))
    return df.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.explode(keys).alias("h")).select("h.h1", "h.h2", "doc")


def _compact(runs: list[DataFrame]) -> DataFrame:
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return merged.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


class Runs:
    """The levelled runs of a corpus."""

    def __init__(self, ws: Workspace, min_docs: int):
        self.ws, self.min_docs, self.levels, self.made = ws, min_docs, [], 0

    def _sorted(self, run: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run-{self.made}"
        return name, self.ws.table(run.sortWithinPartitions("h1", "h2"), name)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """A batch's (h1, h2, docs, keeper) without the hashes that some run has settled."""
        for run in self.all():
            settled = run.filter(F.col("docs") >= self.min_docs).select("h1", "h2")
            batch = batch.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Anti-join a batch's entries against the runs, add the rest as a run, compact full levels."""
        run = self._sorted(self.unsettled(batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))))
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                return
            old = self.levels[level]
            run, self.levels[level] = self._sorted(_compact([r for _, r in old])), []
            self.ws.drop(*(n for n, _ in old))
            level += 1


def repeated(df: DataFrame, ws: Workspace, min_length: int = 20, min_docs: int = 3, batches: int = 3) -> tuple[DataFrame, DataFrame]:
    """(every entry, repeated keys with their keeper)."""
    every = entries(df, min_length)
    bounds = every_bounds(df, batches)
    doc = F.col("doc")
    batch = F.lit(0)
    for b in bounds:  # descending ids: batch 0 has the largest
        batch = batch + F.when(doc < F.lit(b), 1).otherwise(0)
    stored = ws.table(every.withColumn("batch", batch), "entries")
    runs = Runs(ws, min_docs)
    for k in range(len(bounds) + 1):
        runs.add(stored.filter(F.col("batch") == k).drop("batch"))
    keys = _compact(runs.all()).filter(F.col("docs") >= min_docs).select("h1", "h2", "keeper")
    return stored.drop("batch"), ws.table(keys, "repeated")


def every_bounds(df: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about equal size, largest first."""
    cuts = df.filter("doc_id is not null").stat.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    return sorted({int(c) for c in cuts}, reverse=True)


def dedup_lines(df: DataFrame, min_length: int = 20, min_docs: int = 3, batches: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): the text left of every document."""
    spark = df.sparkSession
    docs = require(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ws = Workspace(spark, "lines")
    every, keys = repeated(docs, ws, min_length, min_docs, batches)
    # a document's lost hashes, dealt into about the root of their number, so that a line is looked up among few; its keeper never loses the key
    lost = every.join(keys, ["h1", "h2"]).filter("doc <> keeper").groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    lost = ws.table(lost, "lost-hashes").withColumn("parts", F.ceil(F.sqrt(F.size("lost").cast("double"))).cast("int"))
    dealt = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.filter("lost", lambda h: F.pmod(h["h1"], F.col("parts").cast("long")) == k))
    lost = ws.table(lost.select("doc", "parts", dealt.alias("lost")), "lost")
    ws.drop("entries", "lost-hashes")
    joined = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))).join(lost, "doc", "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    joined = joined.select("doc_id", "parts", "lost", split.alias("lines"))
    near = lambda h: F.get(F.col("lost"), F.pmod(h["h1"], F.col("parts").cast("long")).cast("int"))
    stays = lambda x: ~((F.length(line_key(x)) >= min_length) & F.array_contains(near(line_hash(line_key(x))), line_hash(line_key(x))))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    counted = joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return counted.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))
