"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Layout of one shard below the output folder::

    NAME.ids   token ids of all its documents, little-endian, 2 bytes (4 for vocabularies over 65 536)
    NAME.off   int64 little-endian, one more than documents: where each document starts in NAME.ids
    NAME.doc   int64 little-endian, the documents' ids

Shards cover ascending, disjoint doc_id ranges.  A shard's base (tokens of all shards
before it) is the prefix sum over the manifest, one row for each shard.  Every task
writes under a name of its own, and only the names in the manifest count, so files of
lost or repeated attempts are never read.

Cases: null or empty text is a document with the end id only; a null doc_id is stored as
the smallest int64, sorts first and is read back as null; rows that share a doc_id are
documents of their own, in any order among themselves; an empty table gives no shards.
Texts are cut only where no token can span (see ``WordEncoder``), so the ids equal those of the whole text; with
tokenizers of other kinds whole texts go to the library.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.llm.wordhash import mix, seeds
from tallyrill.llm.workspace import Workspace, opened, require

NULL_ID = -(1 << 63)
MANIFEST = T.StructType([T.StructField("name", T.StringType()), T.StructField("first_doc", T.LongType()), T.StructField("last_doc", T.LongType()), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])
#: Most documents, and most tokens of several documents, that are read at once.
READ_DOCUMENTS, READ_TOKENS = 10_000, 1 << 22
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Words that one Python worker remembers; a full table keeps those it met in several batches.
REMEMBERED = 1 << 20
#: Words longer than this many characters are encoded each time.
LONG = 64
#: Characters after which a long text is cut at its next blank.
PIECE = 1 << 20
#: The pre-token pattern that ``WordEncoder`` reproduces, and the normalisers before it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
class TextEncoder:
    """Encodes whole texts with any tokenizer of the library."""

    def __init__(self, tokenizer, end_id: int, dtype: str):
        self.tokenizer, self.dtype, self.end = tokenizer, np.dtype(dtype), end_id

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, one after the other; their numbers)."""
        end = np.array([self.end], dtype=self.dtype)
        found = [np.append(own, end) for own in self.ids([t or "" for t in texts])]
        return (np.concatenate(found) if found else end[:0]), np.array([len(f) for f in found], dtype=np.int64)


#: Code points from here on, and those of LEFT, are left to the library: composition, case and classes need more than a table there.
LIMIT = 0x250
LEFT = (*range(0x1C, 0x20), 0x130, 0x23A, 0x23E)
BLANK, LETTER, NUMBER, OTHER, FOREIGN = range(5)


def _classes() -> np.ndarray:
    """Class of every UTF-16 code unit."""
    import unicodedata

    out = np.full(1 << 16, FOREIGN, dtype=np.uint8)
    for c in range(LIMIT):
        if c not in LEFT:
            kind = unicodedata.category(chr(c))[0]
            out[c] = BLANK if chr(c).isspace() else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    return out


class WordEncoder(TextEncoder):
    """Encodes texts below U+0250 word by word with whole-array operations and remembers the words' ids.

    A batch is one array of UTF-16 code units; its pre-tokens are the runs of equal class, numbers one by one, with the
    contractions of WORD_PATTERN.  A pre-token's hash comes from prefix sums of value(c) * R^i modulo 2^64; an
    open-addressing table gives the place of its ids, and only words not met before go to the library.  Two words of
    one length with equal 64-bit hashes would be taken for each other (about 1e-13 for each new word and full table).
    """

    R = 0x9E3779B97F4A7C15

    def __init__(self, tokenizer, end_id: int, dtype: str):
        super().__init__(tokenizer, end_id, dtype)
        suffix = json.loads(tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.classes = _classes()
        self.lower = np.array([ord(chr(c).lower()) if c not in LEFT else c for c in range(LIMIT)], dtype=np.uint16)
        self.values = seeds(int(self.lower.max()) + 1, 31)[self.lower]  # either case alike
        self.power = self.inverse = np.ones(1, dtype=np.uint64)
        self._clear()

    @staticmethod
    def knows(definition: dict) -> bool:
        """Whether the tokenizer cuts and folds text as this class does."""
        pre, norm = definition.get("pre_tokenizer") or {}, definition.get("normalizer") or {}
        steps = pre.get("pretokenizers", [])
        return (
            definition["model"].get("type", "BPE") == "BPE" and bool(definition["model"].get("end_of_word_suffix")) and not definition["model"].get("continuing_subword_prefix")
            and norm.get("normalizers") == WORD_NORMALIZERS and len(steps) == 2
            and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed"
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and all(t["content"].startswith("<|") for t in definition.get("added_tokens", []))
        )

    def _clear(self) -> None:
        size = 2 * REMEMBERED
        self.keys = np.zeros(size, dtype=np.uint64)  # 0: free
        self.at, self.count, self.length, self.met = (np.zeros(size, dtype=t) for t in (np.int64, np.int32, np.uint8, np.uint8))
        self.known, self.used, self.store = 0, 0, np.zeros(1 << 16, dtype=self.dtype)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, self.R, dtype=np.uint64), dtype=np.uint64)))
                self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, pow(self.R, -1, 1 << 64), dtype=np.uint64), dtype=np.uint64)))

    def _keep(self, ids: np.ndarray) -> int:
        """Append ids to the store; returns where they begin."""
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store[: self.used], np.zeros(max(len(self.store), len(ids)), dtype=self.dtype)))
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _find(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Slot of each word by hash and length, -1 where it is unknown."""
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == h, slot, -1)
        open_ = np.flatnonzero((there != h) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            there = self.keys[slot[open_]]
            hit = there == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (there != 0)]
        out[(out >= 0) & (self.length[out] != size)] = -1
        return out

    def _insert(self, h: np.ndarray) -> np.ndarray:
        """Slots for distinct unknown hashes."""
        mask = len(self.keys) - 1
        slot, open_ = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            self.keys[slot[free[first]]] = h[free[first]]
            open_ = open_[self.keys[slot[open_]] != h[open_]]
            slot[open_] = (slot[open_] + 1) & mask
        self.known += len(h)
        return slot

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(where each word's ids begin in the store, their numbers): joined by blanks and cut after each word-end token."""
        at, count = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int32)
        for k in range(0, len(words), 1_000):
            part = words[k : k + 1_000]
            ids = self.ids([" ".join(part)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                each = self.ids(part)
                ids, cuts = np.concatenate(each), np.cumsum([len(e) for e in each])
            own = np.diff(cuts, prepend=0)
            at[k : k + len(part)], count[k : k + len(part)] = self._keep(ids) + cuts - own, own
        return at, count

    def _forget(self) -> None:
        """Empty a full table but for the words met in several batches, where those are at most half of it."""
        kept = np.flatnonzero((self.keys != 0) & (self.met > 1))
        if 2 * len(kept) > REMEMBERED:
            kept = kept[:0]
        old = {name: getattr(self, name)[kept] for name in ("keys", "at", "count", "length")}
        ids = self.store[np.repeat(old["at"] - np.cumsum(old["count"]) + old["count"], old["count"]) + np.arange(int(old["count"].sum()))]
        self._clear()
        slot = self._insert(old["keys"])
        self.at[slot], self.count[slot], self.length[slot] = self._keep(ids) + np.cumsum(old["count"]) - old["count"], old["count"], old["length"]

    def _spans(self, code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens; the array ends with a blank."""
        word = kind != BLANK
        first = word & (kind == NUMBER)
        first[0] = word[0]
        first[1:] |= word[1:] & (kind[1:] != kind[:-1])
        quote = np.flatnonzero(code == 39)
        quote = quote[first[quote] & (kind[quote + 1] == LETTER)]
        if len(quote):  # an apostrophe that begins a token takes the letters of a contraction
            one, two = self.lower[code[quote + 1]], self.lower[code[np.minimum(quote + 2, len(code) - 1)]]
            pair = lambda a, b: (one == ord(a)) & (two == ord(b))
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(pair("r", "e") | pair("v", "e") | pair("l", "l"), 3, 0))
            quote, size = quote[size > 0], size[size > 0]
            first[quote + 1] = False
            after = quote + size
            first[after] |= kind[after] == LETTER
        last = word.copy()
        last[:-1] &= first[1:] | ~word[1:]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _words(self, raw: list[bytes], code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts without end ids, their numbers)."""
        starts, ends = self._spans(code, kind)
        bounds = np.searchsorted(starts, np.cumsum([len(r) // 2 + 1 for r in raw]))
        if not len(starts):
            return self.store[:0], np.zeros(len(raw), dtype=np.int64)
        self._powers(len(code) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate(([np.uint64(0)], np.cumsum(self.values[code] * self.power[: len(code)], dtype=np.uint64)))
            h = mix((total[ends] - total[starts]) * self.inverse[starts]) | np.uint64(1)
        size = ends - starts
        slot = self._find(h, size)
        new = np.flatnonzero((slot < 0) & (size <= LONG))
        word = lambda k: code[starts[k] : ends[k]].tobytes().decode("utf-16-le").lower()
        if len(new):
            fresh, which, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            if self.known + len(fresh) > REMEMBERED or self.used > 16 * REMEMBERED:
                self._forget()
                slot = self._find(h, size)
                new = np.flatnonzero((slot < 0) & (size <= LONG))
                fresh, which, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            at, count = self._learn([word(k) for k in new[which].tolist()])
            if self.known + len(fresh) <= REMEMBERED:
                places = self._insert(fresh)
                self.at[places], self.count[places], self.length[places] = at, count, size[new[which]]
        seen = slot >= 0
        self.met[slot[seen]] = np.minimum(self.met[slot[seen]], 200) + 1
        where, number = self.at[slot], self.count[slot].astype(np.int64)
        if len(new):
            where[new], number[new] = at[inverse], count[inverse]
        long = np.flatnonzero(size > LONG)
        if len(long):
            where[long], number[long] = self._learn([word(k) for k in long.tolist()])
        done = np.cumsum(number)
        ids = self.store[np.repeat(where - done + number, number) + np.arange(int(done[-1]))]
        upto = np.concatenate(([0], done))[bounds]
        return ids, np.diff(upto, prepend=0)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        cut = [list(_pieces(t)) if t else [] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        pieces = [p for c in cut for p in c]
        raw = [p.encode("utf-16-le", "surrogatepass") for p in pieces]
        code, kind = self._joined(raw)
        foreign = np.searchsorted(np.cumsum([len(r) // 2 + 1 for r in raw]), np.flatnonzero(kind == FOREIGN), side="right")
        left = np.zeros(len(texts), dtype=bool)  # texts that go to the library, in pieces too since blanks part tokens
        left[owner[np.unique(foreign)]] = True
        left[owner[[k for k, p in enumerate(pieces) if "<|" in p]]] = True
        own = np.flatnonzero(~left[owner])
        if len(own) < len(raw):
            raw = [raw[k] for k in own]
            code, kind = self._joined(raw)
        found: dict[int, np.ndarray] = {}
        if raw:
            ids, number = self._words(raw, code, kind)
            found = dict(zip(own.tolist(), np.split(ids, np.cumsum(number)[:-1]), strict=True))
        if other := np.flatnonzero(left[owner]).tolist():
            found.update(zip(other, self.ids([pieces[k] for k in other]), strict=True))
        end, out, k, counts = np.array([self.end], dtype=self.dtype), [], 0, np.ones(len(texts), dtype=np.int64)
        for i, c in enumerate(cut):
            for _ in c:
                out.append(found[k])
                counts[i] += len(found[k])
                k += 1
            out.append(end)
        return (np.concatenate(out) if out else end[:0]), counts

    def _joined(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code units of all texts, each closed by a newline, and their classes."""
        code = np.frombuffer(b"".join(r + b"\n\x00" for r in raw), dtype="<u2")
        return code, self.classes[code]


def _pieces(text: str) -> Iterator[str]:
    """The text, cut before a blank or newline after each PIECE characters."""
    at = 0
    while len(text) - at > PIECE:
        found = CUT.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


CUT = re.compile("[ \n]")
#: One encoder for each tokenizer in a Python worker, kept from task to task.
ENCODERS: dict[tuple, TextEncoder] = {}


def encoder_of(path: str, end_id: int, dtype: str) -> TextEncoder:
    """The encoder for a tokenizer's file; words are remembered only where its own definition allows it."""
    if (path, end_id, dtype) not in ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = WordEncoder if WordEncoder.knows(json.loads(tokenizer.to_str())) else TextEncoder
        ENCODERS[path, end_id, dtype] = kind(tokenizer, end_id, dtype)
    return ENCODERS[path, end_id, dtype]


def _sized(texts: pa.Array, ids: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Slices of a batch of about ``limit`` characters."""
    held, keys, size = [], [], 0
    for text, key in zip(texts, ids, strict=True):
        held.append(text.as_py())
        keys.append(key.as_py())
        size += len(held[-1] or "")
        if size >= limit:
            yield held, keys
            held, keys, size = [], [], 0
    if held:
        yield held, keys


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Encode (doc_id, text) and write the shards; returns the manifest, one row for each shard."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    filesystem, place = opened(folder)
    filesystem.create_dir(place)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = name = None
        offsets, docs = [0], []
        for batch in batches:
            for texts, ids in _sized(batch.column("text"), batch.column("doc_id")):
                if encoder is None:
                    encoder, name = encoder_of(tokenizer, end_id, dtype), uuid.uuid4().hex
                    where, path = opened(folder)
                    out = where.open_output_stream(f"{path}/{name}.ids")
                found, counts = encoder(texts)
                out.write(found.tobytes())
                offsets += (offsets[-1] + np.cumsum(counts)).tolist()
                docs += [NULL_ID if i is None else i for i in ids]
        if encoder is None:
            return
        out.close()
        for suffix, values in (("off", offsets), ("doc", docs)):
            with where.open_output_stream(f"{path}/{name}.{suffix}") as side:
                side.write(np.array(values, dtype="<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "first_doc": pa.array([docs[0]], pa.int64()), "last_doc": pa.array([docs[-1]], pa.int64()), "documents": pa.array([len(docs)], pa.int64()), "tokens": pa.array([offsets[-1]], pa.int64())})

    key = F.coalesce("doc_id", F.lit(NULL_ID))
    # rows that share an id are dealt by their text as well, so that one id may fill several shards
    ordered = require(df, "doc_id", "text").repartitionByRange(key, F.xxhash64("text")).sortWithinPartitions(key)
    ws = Workspace(df.sparkSession, "token-manifest")
    return ws.table(ordered.mapInArrow(task, MANIFEST), "manifest")


def based(manifest: DataFrame) -> list[tuple]:
    """Shards with their bases: (name, documents, tokens, base), in doc_id order.  One row for each write task."""
    rows, base, out = sorted(manifest.collect(), key=lambda r: (r.first_doc, r.last_doc, r.name)), 0, []
    for r in rows:
        out.append((r.name, r.documents, r.tokens, base))
        base += r.tokens
    return out


class _Values:
    """A file of numbers: memory-mapped on a local file system, read by ranges on any other."""

    def __init__(self, where, path: str, kind):
        from pyarrow import fs

        self.kind = np.dtype(kind)
        size = where.get_file_info(path).size
        self.n = size // self.kind.itemsize
        self.mapped = np.memmap(path, dtype=self.kind, mode="r") if size and isinstance(where, fs.LocalFileSystem) else None
        self.file = None if self.mapped is not None else where.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return np.asarray(self.mapped[part])
        a, b = part.start, min(part.stop, self.n)
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def read(spark: SparkSession, folder: str, shards: list[tuple], vocabulary: int) -> DataFrame:
    """One row for each document from the files: where it starts, its length, and the crc32 of its ids as uint32."""
    dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = opened(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                sides = [_Values(where, f"{path}/{shard['name']}.{k}", t) for k, t in (("ids", dtype), ("off", "<i8"), ("doc", "<i8"))]
                ids, off, doc = sides
                if doc.n != shard["documents"] or ids.n != shard["tokens"]:
                    raise ValueError(f"shard {shard['name']} is incomplete")
                a = 0
                while a < doc.n:
                    b = min(a + READ_DOCUMENTS, doc.n)
                    ends = off[a : b + 1]
                    b = a + max(1, int(np.searchsorted(ends - ends[0], READ_TOKENS, side="right")) - 1)  # whole documents, one at least
                    ends, part = ends[: b - a + 1], doc[a:b]
                    held = ids[int(ends[0]) : int(ends[-1])]
                    sums = [zlib.crc32(held[i:j].astype("<u4").tobytes()) for i, j in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int64(), mask=np.asarray(part) == NULL_ID), pa.array(ends[:-1] + shard["base"]), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    a = b
                for side in sides:
                    side.close()

    table = spark.createDataFrame(shards, "name string, documents long, tokens long, base long")
    return table.repartition(max(1, len(shards))).mapInArrow(task, READ)


def token_files(df: DataFrame, tokenizer: str, end_id: int = 1, vocabulary: int = 49_408) -> DataFrame:
    """Write the table's token files into the shared folder and return what they hold."""
    folder = Workspace(df.sparkSession, "token-files").path
    shards = based(write(df, folder, tokenizer, end_id, vocabulary))
    return read(df.sparkSession, folder, shards, vocabulary)
