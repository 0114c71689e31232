"""Token ids against the library, word memory, and reads by range."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from tallyrill.llm import tokens

LETTERS = list("abcdeéñüßstrvmlld'''  \n\t.,!?_-0123456789²½ªºµÀŒœŸ\x85\xa0ǅŉȺƁȾABCSTRVMLLD")
FIXED = [None, "", "漢字 <|endoftext|> it's", "x" * 500 + " y", "e\u0301a '\u0301s", "<|startoftext|>a", "'s't're've'm'll'd 'sx ''s '", "İstanbul ΑΣ", "a\x1cb", " ", "'"]


def drawn(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.choice([0, 1, 3, 10, 40, 300]))) for _ in range(n)] + FIXED


def same(encoder, library, texts):
    ids, counts = encoder(texts)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", tokens.WordEncoder), ("byte_bpe_50k.json", tokens.TextEncoder)])
def test_ids_equal_those_of_the_library(name, kind):
    encoder = tokens.encoder_of(public_tokenizers.path(name), 1, "<u2")
    assert type(encoder) is kind
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for seed in range(8):
        same(encoder, library, drawn(seed))
    same(encoder, library, [])
    same(encoder, library, [None])


def test_a_full_memory_forgets_and_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 256)
    monkeypatch.setattr(tokens, "PIECE", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoder = tokens.WordEncoder(library, 1, "<u2")
    for seed in range(12):
        same(encoder, library, drawn(seed, 60))
        assert encoder.known <= 256
    assert "".join(tokens._pieces("ab " * 100)) == "ab " * 100


def test_read_by_range_equals_the_mapped_file(tmp_path):
    values = np.arange(1000, dtype="<i8")
    values.tofile(tmp_path / "v")
    for where, path in ((fs.LocalFileSystem(), str(tmp_path / "v")), (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "v")):
        side = tokens._Values(where, path, "<i8")
        assert side.n == 1000 and side[10:20].tolist() == list(range(10, 20)) and side[998:1005].tolist() == [998, 999]
        side.close()


def test_rows_that_share_an_id_and_any_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(tokens, "READ_DOCUMENTS", 3)
    rows = [(7, f"the same id {k}") for k in range(20)] + [(None, "none"), (None, "none"), (1, "漢字 ünd"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name, size in (("word_bpe_49k.json", 49_408), ("byte_bpe_50k.json", 50_257)):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        found = tokens.token_files(df, public_tokenizers.path(name), end_id=1, vocabulary=size).collect()
        found.sort(key=lambda r: r.start)
        assert [r.doc_id for r in found] == [None, None, 1, *[7] * 20, 9]
        assert all(b.start == a.start + a.n_tokens for a, b in zip(found[:-1], found[1:], strict=True)) and found[0].start == 0
        crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
        assert sorted(r.ids_crc32 for r in found) == sorted(crc(t) for _, t in rows)
