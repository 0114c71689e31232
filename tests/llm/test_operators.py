"""Small fixtures with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tallyrill.llm import decontam, lines, mixing, neardup, queries, secrets, sharding, tokens, toxicity, urls, vectors
from tallyrill.llm.wordhash import ALNUM, NOT_SPACE, Words

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LINE = "This line stands in many documents."
BASE = " ".join(f"{WORDS[i * i % 20]}{i}" for i in range(60))
DOCS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE.replace("beta1 ", "other "), "a"), (4, None, None), (5, "", "b"), (6, f"x\n{LINE}\ny", "b"), (7, f"  {LINE.upper()}\nz", "b"),
    (8, f"{LINE}\n{LINE}", "c"), (9, "word " * 30_000, "c"), (None, "no id here", "c"), (10, "Ünïcode 漢字 <|endoftext|> it's\ttokens ΑΣ", "a"), (11, 'password = "Zx81Qm4Lk09Pv7Tr"', "a"),
    (12, " ".join(BASE.split()[10:25]) + " trailing", "b"),
]
SCHEMA = "doc_id long, text string, source string, score double, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 0.5, 7) for i, t, s in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.default_tokenizer())
    rows = {r.doc_id: r for r in tokens.token_files(docs, queries.default_tokenizer()).collect()}
    start = 0
    for i, text, _ in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_files(empty, queries.default_tokenizer()).count() == 0


def test_toxicity(spark, docs, empty):
    rows = [(100 + i, ("you horrid brute " if i % 4 == 0 else "a calm kind day ") + ("women " if i % 4 == 0 else "men ") + WORDS[i % 20], None, None, None) for i in range(200)]
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, SCHEMA), labels)
    probe = spark.createDataFrame([(1, "horrid brute"), (2, "women"), (3, None), (4, "kind men")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert found[1] > 0.7 and max(found[2], found[3], found[4]) < 0.5 and abs(found[2] - found[3]) < 0.2
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).filter("score <> 0.5").count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_query_holds_out_rows(spark, tmp_path):
    import zlib as z

    text = lambda i: f"horrid brute {WORDS[i % 20]}" if i % 4 == 0 else f"calm day {WORDS[i % 20]}"
    out = lambda i: z.crc32(str(i).encode()) % 3 == 1
    spark.createDataFrame([(i, text(i)) for i in range(300)] + [(0, text(0)), (None, "horrid brute"), (500, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = []
    for wrong in (False, True):  # labels of held-out rows turned round change nothing
        spark.createDataFrame([(i, int(i % 4 == 0) ^ int(wrong and out(i))) for i in range(300)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        found.append(sorted((tuple(r) for r in queries.op2_toxicity(spark, str(tmp_path)).collect()), key=str))
    assert found[0] == found[1] and len(found[0]) == 303
    for i, held, score, predicted in found[0]:
        assert held == (i is not None and out(i)) and predicted == int(score >= 0.7) and 0 <= score <= 1
        assert predicted == int(i is None or (i < 300 and i % 4 == 0))


def test_lines(docs, empty):
    rows = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert [(rows[i].n_lines, rows[i].n_dropped, rows[i].kept) for i in (6, 7, 8)] == [(3, 1, "x\ny"), (2, 1, "z"), (2, 0, f"{LINE}\n{LINE}")]
    assert rows[4].kept == rows[5].kept == "" and rows[None].kept == "no id here" and len(rows) == len(DOCS)
    assert lines.dedup_lines(empty).count() == 0


def test_settled_lines_stay_out_of_later_runs(spark, monkeypatch):
    from tallyrill.llm.workspace import Workspace

    hot, rows = "A line that stands in every single document.", []
    for i in range(60):
        rows.append((i, "\n".join([hot, f"line {i % 7} with twenty or more letters", f"own line of the document {i}", "short"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored, results = [], []
    for decides in (True, False):
        if not decides:
            monkeypatch.setattr(lines.Runs, "unsettled", lambda self, batch: batch)
        ws, sizes = Workspace(spark, "test-runs"), []
        keep = ws.table
        monkeypatch.setattr(ws, "table", lambda df, name, keep=keep, sizes=sizes: (out := keep(df, name), sizes.append(out.count() if name.startswith("run-") else 0))[0])
        _, keys = lines.repeated(docs, ws, batches=4)
        results.append(sorted((r.h1, r.h2, r.keeper) for r in keys.collect()))
        stored.append(sum(sizes))
    assert results[0] == results[1] and len(results[0]) == 8 and stored[0] < stored[1], stored


def test_many_lost_lines_of_one_document(spark):
    body = "\n".join(f"line number {k} of a long list" for k in range(6_000))
    rows = [(i, f"{body}\nlast {i}") for i in range(3)]
    found = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(found[i].n_lines, found[i].n_dropped, found[i].kept) for i in (0, 1)] == [(6_001, 6_000, f"last {i}") for i in (0, 1)]
    assert found[2].n_dropped == 0 and found[2].kept == rows[2][1]


def test_decontamination(spark, docs, empty):
    bench = [(1, BASE[:200]), (2, "no id"), (3, None), (None, "x y"), (4, BASE[:200])]
    table = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, n long")
    for r in decontam.report(docs, table).collect():
        text = next(t for i, t, _ in DOCS if i == r.doc_id)
        want = decontam.brute_force(text, bench)
        assert (r.n_words, r.n_hit, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) == want
    kept = decontam.decontaminate(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 10, 11}
    for r in decontam.report(docs, spark.createDataFrame([(None, "no ID here"), (None, "x")], "item_id long, text string")).collect():
        assert (r.n_hit, r["items"]) == ({None: 3, 6: 1}.get(r.doc_id, 0), [])
    cut = decontam.decontaminate(docs, table, "spans")
    assert cut.count() == len(DOCS) and decontam.report(cut, table).filter("n_hit > 0").count() == 0
    assert decontam.report(empty, table).count() == 0 and decontam.report(docs, table.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_in_several_blocks(docs, spark, monkeypatch):
    bench = [(k, " ".join(BASE.split()[3 * k : 3 * k + 12])) for k in range(15)] + [(90, "word"), (91, None)]
    table = spark.createDataFrame(bench, "item_id long, text string").coalesce(1)
    whole = sorted(map(str, decontam.report(docs, table).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    assert len(list(decontam.blocks(table))) > 5
    assert sorted(map(str, decontam.report(docs, table).collect())) == whole
    for r in decontam.report(docs, table).collect():
        assert (r.n_words, r.n_hit) == decontam.brute_force(next(t for i, t, _ in DOCS if i == r.doc_id), bench)[:2]


def test_columns_of_any_name_stay(docs, spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, BASE[100:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(6, 0), (9, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["score", "n_words", "n_hit", "hit", "Items", "key", "row", "position", "size", "taken", "tie", "at", "target", "a.b", "kept", "__row"]
    rows = [(i, t, "en", s, 1, *range(len(names))) for i, t, s in [*DOCS, (1, BASE, "a"), (8, "other", "b"), (None, None, None)]]
    odd = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{n}` int' for n in names)}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        left = out.collect()
        assert left and all(tuple(r[5:]) == tuple(range(len(names))) for r in left), name
        assert {(r.doc_id, r.text) for r in left} <= {(r[0], r[1]) for r in rows}, name
    spans = decontam.decontaminate(odd, spark.createDataFrame([(1, BASE)], "item_id long, text string"), "spans")
    assert spans.columns == odd.columns and spans.count() == len(rows)
    assert toxicity.score(odd, (np.zeros(toxicity.DIMENSIONS), 0.0)).filter("score <> 0.5").count() == 0


def test_near_duplicates(spark, docs, empty):
    rows = {r.doc_id: r for r in neardup.near_duplicates(docs, 4).collect()}
    assert [rows[i].component_id for i in (1, 2, 3, 4, 5, 9)] == [1, 1, 1, 4, 5, 9]
    assert rows[None].kept and rows[4].n_shingles == 0 and rows[9].n_shingles == 1 and not rows[3].kept
    assert neardup.near_duplicates(empty).count() == 0


def test_chain_of_edits_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts, words = [], BASE.split()
    for i in range(150):
        words = list(words) if i % 5 else BASE.split()
        for _ in range(2):
            words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
        texts.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(57)} for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()}
    assert found == {i: find(i) for i in sets}


def test_sketch_fills_every_bin_and_estimates():
    a = np.arange(300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = neardup.sketch([a[:250], a[50:300], a[:1]])
    assert (s < np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 200 / 300) < 0.12


def test_secrets(docs, empty):
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    text = next(t for i, t, _ in DOCS if i == 11)
    m = re.search(secrets.ASSIGN.replace("(?i)", ""), text)
    assert rows[11].n_assign == 1 and (rows[11].base[0].s, rows[11].base[0].e) == m.span()
    assert rows[4].spans == [] and secrets.find_secrets(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r["taken"] <= 3 * r["size"] and 0 <= r.position <= 1
    for own in by.values():
        assert sum(r.taken for r in own) == int(own[0].target + 0.5) and own[0].target <= 3 * own[0].source_size
    assert mixing.mix(empty).count() == 0 and mixing.curriculum(docs).columns == docs.columns


def test_vectors(spark):
    a = [1.0] + [0.1] * 7
    rows = [(1, a, 1), (2, a, 1), (3, [1.01] + [0.1] * 7, 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0] * 8, 1), (8, [float("nan")] * 8, 1), (9, [-x for x in a], 1), (None, a, 1), (10, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert found[1] == (2, 1, True) and found[3] == (2, 1, False) and found[4] == (0, 4, True)
    assert all(found[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 10)) and len(found) == len(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 3).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len(rows) == len(DOCS) and len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert sharding.shard(empty).count() == 0
    packed = sharding.pack(np.random.default_rng(1).random((500, 3)) + 0.1, 8)
    assert set(packed) == set(range(8))
    hot = np.vstack([[[40.0, 40.0, 1.0]] * 3, np.random.default_rng(2).random((200, 3))])
    assert len(set(sharding.pack(hot, 8)[:3])) == 3  # each of the largest in a shard of its own
    assert not len(sharding.pack(np.zeros((0, 3)), 8)) and len(sharding.pack(np.zeros((5, 3)), 8)) == 5


def test_shards_are_even_and_name_their_rows(spark):
    import zlib

    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(WORDS, size=int(rng.integers(1, 80))))) for k in range(1_500)] + [(7, "same"), (7, "same"), (None, None), (None, "x"), (2_000, "é" * 3)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in found) == want
    size = [sum(r["size"] for r in found if r.shard == s) for s in range(6)]
    assert max(size) - min(size) <= 0.002 * sum(size) / 6
    tokens_of = [sum(r.tokens for r in found if r.shard == s) for s in range(6)]
    rows_of = [sum(r.shard == s for r in found) for s in range(6)]
    assert max(tokens_of) - min(tokens_of) <= 0.005 * sum(tokens_of) / 6 and max(rows_of) - min(rows_of) <= 3, (tokens_of, rows_of)
    for s in range(6):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_urls(spark):
    cases = [(1, "http://a.Example.COM/en/7x?q", "example.com/en/7", "allow"), (2, "https://notexample.com/en/", "com/en/", "block"), (3, None, None, "allow"), (4, "no scheme", None, "allow"), (5, "x://spam-farm.org/a", None, "block"), (6, "http://h.net#x/de/", None, "allow")]
    df = spark.createDataFrame([(i, u, "h") for i, u, _, _ in cases], "page_id long, url string, host string")
    found = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert found == {i: (rule, verdict) for i, _, rule, verdict in cases}
    assert urls.judge(df.limit(0)).count() == 0


def test_more_rules_than_any_bound(spark, monkeypatch):
    rules = [("block", f"host{k}.example/p{k}/") for k in range(12_000)] + [("allow", "host7.example/p7/keep"), ("block", "/nohost")]
    rows = [(k, f"http://www.HOST{k}.example/p{k}/x") for k in range(0, 12_000, 600)] + [(-1, "http://host7.example/p7/keep/me"), (-2, "http://host7.example/p8/"), (-3, "http://host7.example/p7/keep/me")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = {k: (f"host{k}.example/p{k}/", "block") for k in range(0, 12_000, 600)} | dict.fromkeys((-1, -3), ("host7.example/p7/keep", "allow")) | {-2: (None, "allow")}
    for bound in (urls.BROADCAST_BYTES, 0):
        monkeypatch.setattr(urls, "BROADCAST_BYTES", bound)
        found = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules, ()).collect()}
        assert found == want
    assert {r.verdict for r in urls.judge(pages, (), ()).collect()} == {"allow"}


def test_word_hashes_agree_across_batches():
    one = Words([b"Some Words here", b"", b"words"], NOT_SPACE)
    two = Words([b"words"], NOT_SPACE)
    assert one.hashes[1] == two.hashes[0] == one.hashes[3] and list(one.first) == [0, 3, 3, 4]


def test_toxicity_learns_from_all_features_of_a_long_text(spark):
    features = lambda text: next(toxicity.features(Words([text.encode()], ALNUM)))
    base = " ".join(f"w{i}" for i in range(12_000))
    word = next(w for w in (f"q{i:03}" for i in range(1000)) if features(w)[0] > features(base)[8_000])
    rows = [(i, f"{base} {word}" if i % 2 else base) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    found = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id < 2"), model).collect()}
    assert found[0] < 0.3 and found[1] > 0.7


def test_curriculum_takes_each_row_by_itself(spark):
    rows = [(None, "word " * (5 + k % 7), ("a", "b", "c")[k % 3], k) for k in range(60)] + [(7, f"few words {k}", "a", 100 + k) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k long")
    want = {}
    for r in mixing.mix(docs, carried=("k",)).collect():
        want[r.k] = sum(c.words * 2 >= r.size for c in r.copies)
    assert len(set(want.values())) > 1
    size, taken, got = {}, {}, [r.k for r in mixing.curriculum(docs).collect()]
    for _, text, source, k in rows:
        taken[source] = taken.get(source, 0) + got.count(k) * len(text.split())
        size[source] = max(size.get(source, 0), len(text.split()))
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert all(abs(taken[s] - target[s]) <= size[s] for s in size), (taken, target)
