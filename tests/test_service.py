import json

import pytest

from tallyrill.operators.engine import Engine
from tallyrill.plans import experiment, market, models, service
from tallyrill.sources.store import StoreError

from .test_market import linear, synthetic


def payload(n, **change):
    recent = {"accessionNumber": [f"0000000042-24-{k:06d}" for k in range(n)], "form": [("10-K", "S-1", "8-K/A")[k % 3] for k in range(n)], "acceptanceDateTime": [f"2024-01-{k % 28 + 1:02d}T10:00:00.000Z" for k in range(n)], "primaryDocument": [f"doc{k}.htm" for k in range(n)]}
    return json.dumps({"cik": "42", "tickers": ["oak"], "filings": {"recent": {**recent, **change}}})


def test_filings(spark):
    rows = [("oak", "0000000042", payload(50)), ("oak", "0000000043", payload(3)), ("elm", "0000000042", payload(3)), ("oak", "0000000042", "{"), ("Oak ", "0000000042", payload(3, form=["10-K"])), ("oak", "0000000042", payload(1, primaryDocument=["../x"]))]
    df = spark.createDataFrame(rows, "symbol string, cik string, payload string")
    found = service.filings(df).collect()
    good = [r for r in found if r.fault is None]
    assert len(good) == 20 and {r.form for r in good} == {"10-K", "8-K/A"}
    assert good[0].url.startswith("https://www.sec.gov/Archives/edgar/data/42/000000004224") and good == sorted(good, key=lambda r: (-r.published_at, [-ord(c) for c in r.accession]))
    assert sorted(r.fault for r in found if r.fault) == ["arrays", "cik", "document", "payload", "symbol"]
    stored = spark.createDataFrame([("A", f"a{k // 2}", 1_000 + k, 1_000 + 2 * k) for k in range(10)], "symbol string, accession string, published_at bigint, retrieved_at bigint")
    assert [(r.accession, r.published_at) for r in service.filings_at(stored, 1_012).orderBy("published_at").collect()] == [("a1", 1_003), ("a2", 1_005), ("a3", 1_006)]


def test_artifacts(spark):
    body = bytes(k * 7 % 251 for k in range(5_000))
    rows = service.artifact_rows(spark.createDataFrame([("r", "model", bytearray(body)), ("r", "card", bytearray(b"x"))], "run_id string, kind string, payload binary"))
    assert rows.count() == 4
    whole = {r.kind: r for r in service.artifacts(rows).collect()}
    assert bytes(whole["model"].payload) == body and whole["model"].fault is None and bytes(whole["card"].payload) == b"x"
    assert service.artifacts(rows.filter("chunk <> 1")).filter("kind = 'model'").first().fault == "sequence"
    swapped = rows.selectExpr("run_id", "kind", "chunk", "case when kind = 'card' then unhex('79') else payload end as payload", "digest", "chunks")
    assert service.artifacts(swapped).filter("kind = 'card'").first().fault == "checksum"
    with pytest.raises(Exception, match="8 MiB"):
        service.artifact_rows(spark.createDataFrame([("r", "k", bytearray())], "run_id string, kind string, payload binary")).collect()


def test_forecasts_are_written_once_and_jobs_run_once(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute("create table forecasts (run string, ts int, predicted int, actual int, primary key (run, ts))")
    rows = lambda v: spark.createDataFrame([("r", 1, v, 0), ("r", 2, 7, 0)], "run string, ts bigint, predicted bigint, actual bigint")
    assert engine.run(lambda tx: service.put_once(tx, "forecasts", rows(5), ["predicted"])) == 2
    engine.execute("update forecasts set actual = 9 index by run = 'r'")
    assert engine.run(lambda tx: service.put_once(tx, "forecasts", rows(5), ["predicted"])) == 0
    with pytest.raises(StoreError, match="immutable"):
        engine.run(lambda tx: service.put_once(tx, "forecasts", rows(6), ["predicted"]))
    assert {r.actual for r in engine.execute("select actual from forecasts").collect()} == {9}
    jobs = service.Jobs(engine, ("report",))
    job, new = jobs.submit("report", '{"b": 1, "a": 2}', "key-number-1")
    assert new and jobs.submit("report", '{"a":2,"b":1}', "key-number-1") == (job, False)
    with pytest.raises(StoreError):
        jobs.submit("report", "{}", "key-number-1")
    assert jobs.claim()["request"] == '{"a":2,"b":1}' and jobs.claim() is None
    assert jobs.finish(job, "done") and not jobs.finish(job) and not jobs.cancel(job)
    other, _ = jobs.submit("report", "{}")
    jobs.claim()
    assert jobs.cancel(other) and jobs.recover() == 1


def test_small_rules(spark):
    assert service.canonical_object("") == "{}"
    for bad in ("[]", "x", '{"a": "' + "b" * 2000 + '"}'):
        with pytest.raises(ValueError):
            service.canonical_object(bad)
    good = b'{"outlook": "flat", "evidence_ids": ["e1"], "abstain_reason": ""}'
    assert service.decode_answer(good)["evidence_ids"] == ["e1"]
    for bad in (b"", good + b"{}", good.replace(b'"flat"', b"null"), good.replace(b"outlook", b"other"), good.replace(b'"abstain_reason"', b'"outlook"'), b"[" * 5000, good.replace(b'["e1"]', b"[1]")):
        with pytest.raises(ValueError):
            service.decode_answer(bad)
    assert service.markdown("a|b\n*c*") == "a\\|b \\*c\\*" and service.model_card([{"n": "x_y", "v": 0.5}]).splitlines()[2] == "| x\\_y | 0.500000 |"
    df = spark.range(5).withColumnRenamed("id", "version")
    assert service.at_most(df, 5).count() == 5 and service.latest_version(df) == 4 and service.latest_version(df.limit(0)) == 0
    with pytest.raises(ValueError, match="split the range"):
        service.at_most(df, 4)
    cases = spark.createDataFrame([("up", "up", ["a", "b"], ["a"]), ("abstain", "abstain", [], ["a"]), ("abstain", "up", ["c"], ["c"])], "expected string, outlook string, cited array<string>, supported array<string>")
    row = service.scorecard(cases).first()
    assert (row.cases, row.correct, round(row.citation_precision, 3), row.abstention_recall) == (3, 2, 0.667, 0.5)


def test_overview(spark):
    bars = linear(spark, 30)
    forecasts = spark.createDataFrame([("SYM", 1, 5), ("SYM", 2, 6), ("SYM", 1 << 40, 7)], "symbol string, as_of_ts bigint, predicted bigint")
    row = service.overview(bars, market.features(bars), forecasts).first()
    assert (row.predicted, row.sma_5, row.close) == (6, 127_000_000, 129_000_000)


def test_experiment_matches_known_scores(spark):
    sampled = market.samples(synthetic(spark)).cache()
    chosen = experiment.tuning(sampled).cache()
    best = {r.family: json.loads(r.spec) for r in chosen.filter("chosen").collect()}
    assert best["ridge"] == {"alpha": 0.01} and best["moving-average"] == {"window": 5} and chosen.filter("selected").count() == 1
    found = experiment.experiment(sampled, chosen=chosen).cache()
    rows = {(r.family, r["mode"]): r for r in experiment.report(found).collect()}
    assert {k: round(rows[k, "holdout"].mae, 6) for k in experiment.FAMILIES} == {"persistence": 0.443923, "moving-average": 0.866318, "ridge": 0.424135, "stumps": 0.427774}
    assert all(r.n == 117 for r in rows.values()) and rows["persistence", "walk-forward"].mae == rows["persistence", "holdout"].mae
    assert rows["ridge", "walk-forward"].mae != rows["ridge", "holdout"].mae and round(rows["ridge", "holdout"].improvement, 4) == round(1 - 0.424135 / 0.443923, 4)
    assert found.filter("mode = 'walk-forward'").select("fold").distinct().count() == 6
    model = models.fit("ridge", {"alpha": 0.1}, *(lambda p: (p[experiment.INPUTS].to_numpy(), p["y"].to_numpy()))(sampled.toPandas()))
    assert experiment.replay(sampled, json.dumps(model)).count() == sampled.count()
    for bad in ({"kind": "x"}, {**model, "scale": [0.0] * 7}, {**model, "weights": [1.0]}, {"kind": "moving-average", "window": 7}, {"kind": "stumps", "intercept": 0.0, "stumps": [[9, 0.0, 0.0, 0.0]]}):
        with pytest.raises(ValueError):
            experiment.validated(bad)


def test_leaks_and_short_parts_are_refused(spark):
    rows = market.samples(synthetic(spark)).toPandas().sort_values("ts")
    with pytest.raises(ValueError, match="overlap"):
        experiment.calibrated("persistence", {}, rows.iloc[:100], rows.iloc[100:150], 0.9)
    with pytest.raises(ValueError, match="history"):
        experiment.calibrated("persistence", {}, rows.iloc[:39], rows.iloc[60:100], 0.9)
