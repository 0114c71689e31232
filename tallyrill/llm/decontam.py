"""Benchmark decontamination: find benchmark windows in whole texts, remove spans or documents.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the ASCII-lower-cased text.  A window is
``width`` consecutive words of an item; an item of fewer words is one window of its own
length.  The windows' 64-bit hashes are scanned for by rolling window hashes of every text, and a
hit counts only after its words equal the window's.

The benchmark is cut into blocks of at most BLOCK_CHARS characters (by whole items); the driver reads
it block by block, makes each block's hash set and writes it to the shared folder, from where
each Python worker loads it: one block at a time, whatever the benchmark's size, in one narrow pass
over the texts.  So no broadcast grows with the benchmark, and nothing is shuffled.

Cases: null or empty text has no words; items without words match nothing; windows of items without an id are
hits, but no item can be named for them; repeated items and items that share windows are all named; repeated
documents are judged alike; an empty benchmark hits nothing; an empty table gives no rows; columns of other
names stay as they are.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.wordhash import ALNUM, Words, chunks, window_hashes
from tallyrill.llm.workspace import Workspace, columns, fresh, mapped, opened, require

WIDTH = 10
#: Most characters of one block; an item of more is a block by itself.
BLOCK_CHARS = 16_000_000
#: Bytes of rows that pass through all blocks together, where there are several.
GATHERED = 1 << 25
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


class Index:
    """Windows of some items: sorted hashes with the places of the windows in the items' joined words, about 25 bytes a word."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WIDTH):
        words = [[w.encode("utf-8", "surrogatepass") for w in WORD.findall((text or "").translate(ASCII_LOWER))] for _, text in items]
        kept = [k for k, own in enumerate(words) if own]
        self.names = [None if items[k][0] is None else str(items[k][0]) for k in kept]
        texts = [b" ".join(words[k]) for k in kept]
        self.words = Words(texts, ALNUM)
        count, first = np.diff(self.words.first), self.words.first[:-1]
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length -> (sorted hashes, word at which each window begins)
        for size in {min(width, int(n)) for n in count}:
            own = np.flatnonzero(np.minimum(count, width) == size)
            number = count[own] - size + 1
            at = np.repeat(first[own] - np.cumsum(number) + number, number) + np.arange(int(number.sum()))
            hashes = window_hashes(self.words.hashes, size)[at]
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], at[order]
        self.met: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def holders(self, size: int, h: np.uint64) -> dict[bytes, set[str]]:
        """The different windows of one hash, each with the items that hold it (those without an id go unnamed)."""
        key = (size, int(h))
        if key not in self.met:
            known, at = self.windows[size]
            found: dict[bytes, set[str]] = {}
            for word in at[np.searchsorted(known, h) : np.searchsorted(known, h, side="right")].tolist():
                name = self.names[int(np.searchsorted(self.words.first, word, side="right")) - 1]
                found.setdefault(self.words.text(word, size), set()).update({name} - {None})
            self.met[key] = found
        return self.met[key]


def hits(words: Words, index: Index) -> Iterator[tuple[np.ndarray, set[str]]]:
    """Per text: which of its words are hit, and the items found."""
    found: list[tuple[int, int]] = []
    for size, (known, _) in index.windows.items():
        rolling = window_hashes(words.hashes, size)
        if not len(rolling):
            continue
        at = np.searchsorted(known, rolling)
        found += [(k, size) for k in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == rolling).tolist()]
    found.sort()
    marks, k = np.zeros(len(words.starts), dtype=bool), 0
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        items: set[str] = set()
        while k < len(found) and found[k][0] < b:
            at, size = found[k]
            k += 1
            if at < a or at + size > b:  # a window over two texts
                continue
            names = index.holders(size, window_hashes(words.hashes[at : at + size], size)[0]).get(words.text(at, size))
            if names is not None:
                marks[at : at + size] = True
                items |= names
        yield marks[a:b], items


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in lists of at most BLOCK_CHARS characters, one at a time; one item may be longer."""
    held, size = [], 0
    for row in require(benchmark, "item_id", "text").toLocalIterator():
        if held and size + len(row.text or "") > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text or "")
    if held:
        yield held


#: The block that a Python worker holds: its file and index.
HELD: list = ["", None]


def _index(folder: str, name: str) -> Index:
    if HELD[0] != f"{folder}/{name}":
        where, path = opened(folder)
        with where.open_input_file(f"{path}/{name}") as f:
            HELD[:] = [f"{folder}/{name}", pickle.loads(f.read())]
    return HELD[1]


def _found(texts: list[str | None], folder: str, names: list[str]) -> Iterator[tuple[int, int, bytes, list[str]]]:
    """(words, hit words, which words are hit as a bitmap, items) of each text, one block of the benchmark after the other."""
    n, hit, items = [0] * len(texts), [None] * len(texts), [set() for _ in texts]
    for name in names:
        index = _index(folder, name)
        for at, part in chunks(texts):
            for k, (marks, found) in enumerate(hits(Words(part, ALNUM), index), at):
                n[k] = len(marks)
                if marks.any():
                    hit[k] = marks | hit[k] if hit[k] is not None else marks.copy()
                    items[k] |= found
    for k, marks in enumerate(hit):
        yield n[k], 0 if marks is None else int(marks.sum()), b"" if marks is None else np.packbits(marks).tobytes(), sorted(items[k])


def scan(df: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, list[str]]:
    """All columns of ``df`` and four more, whose names come second: words, hit words, which words are hit (a bitmap), items."""
    added = fresh(df, "n_words", "n_hit", "hit", "items")
    folder = Workspace(df.sparkSession, "benchmark").path
    where, path = opened(folder)
    where.create_dir(path)
    names = []
    for block in blocks(benchmark) if benchmark.limit(1).count() else [[]]:
        names.append(f"block-{len(names)}")
        with where.open_output_stream(f"{path}/{names[-1]}") as f:
            f.write(pickle.dumps(Index(block, width)))
    kinds = (T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.StringType()))
    arrow = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))

    def scanned(texts: list[str | None]) -> list[pa.Array]:
        rows = list(_found(texts, folder, names))
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(arrow)]

    return mapped(df, scanned, [T.StructField(c, k) for c, k in zip(added, kinds, strict=True)], gathered if len(names) > 1 else iter), added


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about GATHERED bytes, so that a block of several is loaded once for all of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def report(df: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_hit, items): what each document holds of the benchmark."""
    found, (n_words, n_hit, _, items) = scan(require(df, "doc_id", "text"), benchmark, width)
    return found.select("doc_id", F.col(n_words).alias("n_words"), F.col(n_hit).alias("n_hit"), F.col(items).alias("items"))


def decontaminate(df: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH) -> DataFrame:
    """``df`` without contaminated documents, or ("spans") with the hit words and what stands between them cut from the text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    found, (_, n_hit, hit, _) = scan(df, benchmark, width)
    if remove == "documents":
        return found.filter(F.col(n_hit) == 0).select(*columns(df))
    (clean,) = fresh(found, "clean")
    # the bitmap travels in front of its text, so that one column of strings holds both
    (body,) = fresh(found, "body")
    joined = found.withColumn(body, F.when(F.length(hit) > 0, F.concat_ws("\n", F.hex(hit), "text")))
    cut = mapped(joined.select(F.col(body).alias("text"), *(c.alias(f"k{k}") for k, c in enumerate(columns(df)))), _cut, [T.StructField(clean, T.StringType())])
    kept = [F.coalesce(F.col(clean), F.col(f"k{k}")) if c.lower() == "text" else F.col(f"k{k}") for k, c in enumerate(df.columns)]
    return cut.select(*(c.alias(n) for c, n in zip(kept, df.columns, strict=True)))


def _cut(texts: list[str | None]) -> list[pa.Array]:
    parts = [t and t.partition("\n") for t in texts]
    return [pa.array([p and cut_spans(p[2], bytes.fromhex(p[0])) for p in parts], pa.string())]


def cut_spans(text: str, hit: bytes) -> str:
    """The text without its hit words; a run of hit words goes with what stands between them."""
    marks, out, last, inside = np.unpackbits(np.frombuffer(hit, np.uint8)), [], 0, False
    for k, m in enumerate(WORD.finditer(text)):
        if marks[k] and not inside:
            out.append(text[last : m.start()])
        if marks[k]:
            last = m.end()
        inside = bool(marks[k])
    return "".join([*out, text[last:]])


def items_digest(items):
    """sha256 of the sorted, comma-joined item ids."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def brute_force(text: str | None, items: list[tuple[int, str | None]], width: int = WIDTH) -> tuple[int, int, str]:
    """n_words, n_hit and the items' digest of one text, by comparing every window; for tests."""
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    marks, names = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(ASCII_LOWER))
        size = min(width, len(own))
        for w in [own[k : k + size] for k in range(len(own) - size + 1)] if own else []:
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w:
                    marks.update(range(at, at + size))
                    names.update({str(item)} if item is not None else ())
    return len(words), len(marks), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
