"""Toxicity scores from a counterfactually regularised linear classifier.

Features of a text: which of its words (ASCII-lower-cased, trimmed of punctuation) occur, which word
beginnings (of STEMS bytes) occur, and which of them several of its distinct words share (SHARED; identity terms count as whole words only),
each hashed to one of DIMENSIONS weights; a text is its set of features, so the order of its words
doesn't matter and neither does how often one of them recurs.  The fit minimises the log loss over
labelled texts, plus an L2 term, plus ``fairness`` times the mean squared change of the
logit when the identity terms of a text are swapped for those of another group
(counterfactual logit pairing).  Words of a group then can't carry weight by themselves, so
neutral mentions don't raise a score.  Labels, language, source and id are never features.

The fit uses at most SAMPLE labelled rows, those with the smallest md5 of their id, gathered
to the driver as the indices of their telling features, which are chosen from counts over the whole
texts of the sample (at most two for each of DIMENSIONS).  Scoring covers every whole text.

Cases: null or empty text has no features and scores the intercept's probability; without
labelled rows of both classes every score is the share of toxic labels (0.5 without labels);
repeated rows are scored alike; an empty table gives no rows; columns of other names stay as they are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.wordhash import ALNUM, Words, chunks, mix, seeds
from tallyrill.llm.workspace import Workspace, columns, mapped, require

DIMENSIONS = 1 << 18
#: Labelled rows that a fit may use.
SAMPLE = 6_000
THRESHOLD = 0.7
#: Lengths of word beginnings, and the numbers of distinct words of a text that make a shared beginning a feature of its own.
STEMS, SHARED = (4, 6, 8), (2, 4)
TELLING = 4.0

#: Groups whose terms are swapped for each other, by position: fixed lists of neutral identity terms.
IDENTITY_TERMS = (
    ("women", "woman", "female", "girl", "she", "her"),
    ("men", "man", "male", "boy", "he", "his"),
    ("muslim", "muslims", "islam", "mosque", "arab", "arabs"),
    ("christian", "christians", "christianity", "church", "european", "europeans"),
    ("jewish", "jews", "judaism", "synagogue", "israeli", "israelis"),
    ("gay", "lesbian", "homosexual", "queer", "transgender", "bisexual"),
    ("straight", "hetero", "heterosexual", "married", "cisgender", "couple"),
    ("black", "african", "africans", "asian", "mexican", "immigrant"),
    ("white", "american", "americans", "caucasian", "german", "citizen"),
)


def features(words: Words) -> Iterator[np.ndarray]:
    """Per text its sorted distinct feature indices."""
    # identity terms count as whole words only, so that a swap moves all that they contribute
    sizes = np.where(np.isin(words.hashes, _term_hashes()), 0, words.ends - words.starts)
    stems = [(words.prefix_hashes(n), sizes > n) for n in STEMS]
    salts = seeds(len(SHARED), 8)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        whole, at = np.unique(words.hashes[a:b], return_index=True)
        found = [whole]
        for hashes, long in stems:
            beginnings, count = np.unique(hashes[a:b][at][long[a:b][at]], return_counts=True)
            found.append(beginnings)
            found += [mix(beginnings[count >= n] ^ salt) for n, salt in zip(SHARED, salts, strict=True)]
        yield np.unique((np.concatenate(found) % np.uint64(DIMENSIONS)).astype(np.int32))


@functools.cache
def _term_hashes() -> np.ndarray:
    return Words([t.encode() for group in IDENTITY_TERMS for t in group], ALNUM).hashes


def swap_table() -> list[dict[int, int]]:
    """For each shift of the groups: feature of a term -> feature of its counterpart."""
    flat = [[t.encode() for t in group] for group in IDENTITY_TERMS]
    at = [[(Words([t], ALNUM).hashes % np.uint64(DIMENSIONS)).astype(int)[0].item() for t in group] for group in flat]
    return [{old: at[(g + shift) % len(at)][k] for g, group in enumerate(at) for k, old in enumerate(group)} for shift in range(1, len(at))]


class Rows:
    """A sparse 0/1 matrix by rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows]) if rows else self.col

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def transposed(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row], minlength=size)


def telling(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Features whose share differs between the classes by at least TELLING standard errors, and identity terms.

    ``count`` holds texts with each feature by class, ``n`` the texts of each class (both present).
    """
    pooled = (count[0] + count[1] + 1) / (n[0] + n[1] + 2)
    z = (count[1] / n[1] - count[0] / n[0]) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / n[0] + 1 / n[1]))
    return np.union1d(np.flatnonzero(np.abs(z) >= TELLING), np.array(sorted({f for s in swap_table() for f in s})))


def fit(rows: list[np.ndarray], labels: np.ndarray, told: np.ndarray | None = None, l2: float = 1e-4, fairness: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights by feature and the intercept; Adam over the whole sample, so that reruns agree.

    ``told`` names the features to use, where ``rows`` hold no others.
    """
    labels = np.asarray(labels, dtype=float)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        return np.zeros(DIMENSIONS), math.log(max(share, 1e-6) / max(1 - share, 1e-6)) if len(labels) else 0.0
    if told is None:
        count = np.array([np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == c]), minlength=DIMENSIONS) for c in (0, 1)])
        told = telling(count, np.array([float((labels == c).sum()) for c in (0, 1)]))
        rows = [r[np.isin(r, told)] for r in rows]
    swaps = swap_table()
    gone, come = [], []  # features that a swap removes and adds
    for row in rows:
        for swap in swaps:
            if out := [f for f in row.tolist() if f in swap]:
                gone.append(np.array(out))
                come.append(np.array([swap[f] for f in out]))
    used, index = np.unique(np.concatenate([*rows, *gone, *come, np.zeros(1, dtype=int)]), return_inverse=True)
    split = np.cumsum([len(r) for r in [*rows, *gone, *come]])
    renamed = np.split(index, split)
    x, out, new = (Rows(renamed[a:b]) for a, b in ((0, len(rows)), (len(rows), len(rows) + len(gone)), (len(rows) + len(gone), len(rows) + 2 * len(gone))))
    w, b = np.zeros(len(used)), math.log(share / (1 - share))
    weight = np.where(labels > 0, (1 - share) / share, 1.0) ** 0.5  # between natural and equal classes
    weight /= weight.mean()
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30))) - labels) * weight / x.n
        slope = x.transposed(error, len(used)) + 2 * l2 * w
        if out.n:
            change = new.times(w) - out.times(w)
            pull = 2 * fairness * change / out.n
            slope += new.transposed(pull, len(used)) - out.transposed(pull, len(used))
        g = np.append(slope, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return weights, float(b)


def _featured(df: DataFrame) -> DataFrame:
    """(y, f): labels and feature indices of labelled texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column("y")
            for at, texts in chunks(t.as_py() for t in batch.column("text")):
                found = list(features(Words(texts, ALNUM)))
                yield pa.RecordBatch.from_arrays([ys.slice(at, len(texts)), pa.array(found, pa.list_(pa.int32()))], names=["y", "f"])

    return df.select("y", "text").mapInArrow(task, "y int, f array<int>")


def _told(featured: DataFrame) -> np.ndarray | None:
    """Telling features of (y, f) from counts of at most two rows for each feature; None without rows of both classes."""
    n = {r.y: float(r["count"]) for r in featured.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    counted = featured.select("y", F.explode("f").alias("f")).groupBy("y", "f").count().toArrow()
    y, f, k = (counted.column(c).to_numpy() for c in ("y", "f", "count"))
    count = np.zeros((2, DIMENSIONS), dtype=np.int64)
    count[y, f] = k
    return telling(count, np.array([n[0], n[1]]))


def _only(featured: DataFrame, told: np.ndarray) -> DataFrame:
    """(y, f) with no features but those told."""
    shared = featured.sparkSession.sparkContext.broadcast(np.isin(np.arange(DIMENSIONS), told))  # DIMENSIONS bytes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f[shared.value[f]] for f in (np.array(f.as_py(), dtype=np.int32) for f in batch.column("f"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["y", "f"])

    return featured.mapInArrow(task, "y int, f array<int>")


def train(documents: DataFrame, labels: DataFrame, held_out=None, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled documents; ``held_out`` maps the id column to a condition of rows never learnt from."""
    marked = require(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)")
    if held_out is not None:
        marked = marked.filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = marked.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    ws = Workspace(documents.sparkSession, "toxicity")
    chosen = ws.table(chosen, "chosen")
    texts = require(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of 12 bytes
    featured = ws.table(_featured(texts), "features")
    told = _told(featured)
    if told is not None:
        featured = ws.table(_only(featured, told), "told")
    else:  # one class or none: only the share of labels counts
        featured = featured.select("y", F.array().cast("array<int>").alias("f"))
    rows = [(r.y, np.array(r.f, dtype=np.int64)) for r in featured.toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))  # sums in the same order each time
    return fit([f for _, f in rows], np.array([y for y, _ in rows]), told)


def score(df: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """All columns of ``df`` and ``name``, a double from 0 to 1, for every whole ``text``; a column of that name is replaced."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # DIMENSIONS x 4 bytes

    def scored(texts: list[str | None]) -> list[pa.Array]:
        weights, bias = shared.value
        weights, found = weights.astype(float), np.empty(len(texts))
        for at, part in chunks(texts):
            for k, f in enumerate(features(Words(part, ALNUM)), at):
                found[k] = 1 / (1 + math.exp(-min(30.0, max(-30.0, float(weights[f].sum()) + bias))))
        return [pa.array(found)]

    return mapped(df.select(*columns(df, name)), scored, [T.StructField(name, T.DoubleType())])


def held_out(key):
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1
