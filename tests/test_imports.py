import json

import pytest

from tallyrill.operators.engine import Engine
from tallyrill.sources import imports
from tallyrill.streaming import sync

DAY, MONDAY = 86_400, 1_783_296_000  # 2026-07-06


def written(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_in_any_column_order(spark, tmp_path):
    path = written(tmp_path / "bars.csv", "Open,TIMESTAMP,high,low,Close,volume", "99.5,2026-01-02,101,99,100,1000", "", '"100.5",2026-01-03 00:00:00,102,100,101,1001', "101,1767484800,102,100,101.25,7", "101,2026-01-05T01:00:00+01:00,102,100,101,8")
    rows = imports.checked(imports.csv_bars(spark, path, " sym ", "1D")).orderBy("ts").collect()
    assert [r.ts for r in rows] == [1_767_312_000, 1_767_398_400, 1_767_484_800, 1_767_571_200]
    assert rows[0].symbol == "SYM" and rows[0].interval == "1d" and rows[2].adjusted_close == 101_250_000 and rows[0].open == 99_500_000


@pytest.mark.parametrize(
    ("line", "reason"),
    [("x,1,1,1,1,1", "timestamp"), ("2026-01-02,0,1,1,1,1", "open"), ("2026-01-02,1,NaN,1,1,1", "high"), ("2026-01-02,1,1,1,1,many", "volume"), ("2026-01-02,5,4,1,1,1", "high below"), ("2026-01-02,1,1,1,1,1,9", "too many fields"), ("2026-13-02,1,1,1,1,1", "timestamp"), ("2026-01-02,1,1", "low")],
)
def test_csv_errors_name_their_line(spark, tmp_path, line, reason):
    path = written(tmp_path / "bars.csv", "timestamp,open,high,low,close,volume", "2026-01-02,1,1,1,1,1", "", line, "also bad")
    with pytest.raises(imports.RowError, match=f"^line 4: {reason}$"):
        imports.checked(imports.csv_bars(spark, path, "SYM", "1d"))


def test_csv_headers(spark, tmp_path):
    for name, lines in (("a", ["timestamp,open,high,low,close"]), ("b", ["timestamp,open,high,low,close,volume,OPEN"])):
        with pytest.raises(imports.RowError, match="line 1"):
            imports.csv_bars(spark, written(tmp_path / name, *lines), "SYM", "1d")
    only_header = written(tmp_path / "c", "timestamp,open,high,low,close,volume,adjusted_close")
    assert imports.checked(imports.csv_bars(spark, only_header, "SYM", "1d")).count() == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = written(tmp_path / "long.txt", *(f"row {k}" for k in range(1, 20_001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = imports.numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 1
        assert rows.count() == 20_000 and rows.filter("value <> concat('row ', line)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_saved_replies(spark):
    bars = json.dumps({"values": [{"datetime": "2026-07-06", "open": "1", "high": "2.5", "low": "1", "close": "2", "volume": "5"}, {"datetime": "2026-07-07", "open": "2", "high": "2", "low": "2", "close": "2"}]})
    rows = imports.checked(imports.reply_bars(spark.createDataFrame([("sym", bars), ("none", "{}"), ("bad", "not json")], "symbol string, body string"))).orderBy("ts").collect()
    assert [(r.symbol, r.ts, r.high, r.volume) for r in rows] == [("SYM", MONDAY, 2_500_000, 5), ("SYM", MONDAY + DAY, 2_000_000, 0)]
    body = json.dumps({"splits": [{"date": "2026-07-06", "from_factor": 1, "to_factor": 2}], "dividends": [{"ex_date": "2026-07-07", "amount": "0.25", "currency": "USD"}]})
    actions = imports.reply_actions(spark.createDataFrame([("sym", body), ("none", None)], "symbol string, body string")).orderBy("ex_date").collect()
    assert [(a.action_type, a.amount, a.split_to) for a in actions] == [("split", 0, 2), ("dividend", 250_000, 0)] and len(actions[0].raw_digest) == 64


def test_retries():
    naps, replies = [], iter([imports.Busy(), imports.Busy(3.0), "body"])

    def get():
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    assert imports.fetched(get, sleep=naps.append) == "body" and naps == [0.25, 3.0]
    assert [imports.pause(k) for k in (0, 1, 4, 9)] == [0.25, 0.5, 4.0, 5.0]
    with pytest.raises(ValueError, match="more than"):
        imports.fetched(lambda: "long", limit=3)


class Saved:
    name, max_points = "saved", 2

    def __init__(self, spark, closes):
        self.spark, self.closes, self.asked = spark, closes, []

    def bars(self, symbol, first, last):
        self.asked.append((first, last))
        if symbol == "BAD":
            raise ValueError("unknown symbol")
        px = lambda i: self.closes[i] * 1_000_000
        rows = [(symbol, MONDAY + i * DAY, px(i), px(i), px(i), px(i), 1) for i in range(len(self.closes)) if first <= MONDAY + i * DAY <= last]
        return self.spark.createDataFrame(rows, "symbol string, ts bigint, open bigint, high bigint, low bigint, close bigint, volume bigint")


def test_sync_resumes_with_overlap(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    sync.set_up(engine)
    sync.set_up(engine)
    last = MONDAY + 4 * DAY
    first = sync.sync(engine, Saved(spark, [10, 11, 12, 13, 14]), "SYM", MONDAY, last, DAY, "r1")
    assert first == {"pages": 3, "received": 5, "inserted": 5, "updated": 0, "unchanged": 0}
    again = Saved(spark, [10, 11, 12, 99, 14])
    second = sync.sync(engine, again, "SYM", MONDAY, last, DAY, "r2")
    assert second == {"pages": 2, "received": 3, "inserted": 0, "updated": 1, "unchanged": 2} and again.asked[0][0] == MONDAY + 2 * DAY
    done, failed = sync.sync_all(engine, Saved(spark, [10]), ["BAD", "OTHER"], MONDAY, MONDAY, DAY, "r3")
    assert done["OTHER"]["inserted"] == 1 and failed == {"BAD": "unknown symbol"}
    runs = {r.run_id: r for r in engine.execute("select * from runs").collect()}
    assert runs["r3:BAD"].status == "failed" and runs["r2"].status == "done" and len(runs) == 4
