import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrill.operators.binder import bounds, constant
from tallyrill.operators.engine import Engine, Mutation, query
from tallyrill.operators.syntax import QueryError, parse
from tallyrill.sources.store import ConflictError, Store, StoreError, TableSpec

CREW = TableSpec("crew", [("id", "bigint"), ("name", "string"), ("age", "bigint")], ["id"], [["age", "name"]]).checked()
ROWS = [(1, "Mira", 41), (2, "Tomas", 58), (3, "Wanda", 41), (4, "Yuri", 90)]


def value(text):
    return constant(parse(f"select {text} from t").items[0][0])


def test_precedence_and_wrap():
    assert value("1 + 2 * 3") == 7
    assert value("9223372036854775807 + 1") == -(1 << 63)
    assert value("-7 / 2") == -3
    assert value("not 1 = 2 and true") is True
    assert value("'a' + 'b'") == "ab"


@pytest.mark.parametrize("text", ["select", "select 'x from t", "select a from t limit -1", "select ? from t", "select 1 < 2 < 3 from t", "drop table", "select a from t; select"])
def test_errors_carry_an_offset(text):
    with pytest.raises(QueryError, match="byte"):
        parse(text)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_parser_never_crashes(text):
    try:
        parse(text)
    except QueryError:
        pass


def test_bounds():
    of = lambda t: bounds(parse(f"select a from t index by {t}").index_by)
    assert of("30 > a")[0].op == "<"
    assert of("(a, b) >= (1, 'x')")[0].values == (1, "x")
    for bad in ("a != 1", "a = 1 and a < 3", "a > 1 and a > 5", "a + 1 > 2"):
        with pytest.raises(QueryError):
            of(bad)


def test_select_over_frames(spark):
    df = spark.createDataFrame(ROWS, "id bigint, name string, age bigint")
    ask = lambda t: [tuple(r) for r in query(spark, t, df, CREW).collect()]
    assert ask("select name, age + 1 from crew index by age = 41 where name != 'Wanda'") == [("Mira", 42)]
    assert [r[0] for r in ask("select id from crew index by age < 85 and age >= 41")] == [2, 3, 1]
    assert ask("select id from crew limit 1, 2") == [(2,), (3,)]
    assert ask("select id from crew index by (age, name) > (41, 'Mira')") == [(3,), (2,), (4,)]
    for bad in ("select name + 1 from crew", "select id from crew where age", "select id from crew index by name = 'x'", "select nope from crew"):
        with pytest.raises(QueryError):
            query(spark, bad, df, CREW)


def test_division_by_zero_only_where_reached(spark):
    df = spark.createDataFrame(ROWS, "id bigint, name string, age bigint")
    assert query(spark, "select id from crew where id != 1 and 10 / (id - 1) > 4", df, CREW).count() == 2
    with pytest.raises(Exception, match="division by zero"):
        query(spark, "select 10 / (id - 1) from crew", df, CREW).collect()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_tuple_bound_is_pushed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(ROWS, "id bigint, name string, age bigint").write.parquet(path)
    plan = query(spark, "select id from crew index by (age, name) > (41, 'Mira') limit 2", spark.read.parquet(path), CREW)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(age,41)" in plan and "TakeOrderedAndProject" in plan


def test_statements_and_transactions(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute("create table crew (name string, age int, id int, index (age, name), primary key (id),)")
    assert [c for c, _ in engine.tables()[0].columns] == ["id", "name", "age"]
    assert engine.execute("insert into crew (id, name, age) values (1, 'Mira', 41), (2, 'Tomas', 58), (3, 'Wanda', 41), (4, 'Yuri', 90)").rows_affected == 4
    with pytest.raises(StoreError):
        engine.execute("insert into crew (id, name, age) values (9, 'x', 1), (1, 'y', 2)")
    assert engine.execute("update crew set age = age + 1 index by id = 3").rows_affected == 1
    assert engine.execute("update crew set age = age").rows_affected == 0
    assert [r.id for r in engine.execute("select id from crew index by age >= 42 and age < 66").collect()] == [3, 2]
    tx = engine.begin()
    assert tx.execute("delete from crew where age > 75").rows_affected == 1
    assert tx.execute("select * from crew").count() == 3 and engine.execute("select * from crew").count() == 4
    other = engine.begin()
    other.execute("update crew set age = 1 where id = 1")
    tx.commit()
    with pytest.raises(ConflictError):
        other.commit()
    assert engine.begin().delete_range("delete from crew index by id >= 1", 2) == Mutation(2, "deleted", True)
    with pytest.raises(StoreError, match="change 1"):
        engine.begin().apply_batch([("upsert", "crew", {"id": 9, "name": "n", "age": 1}), ("upsert", "nope", {})])
    engine.store.backup(str(tmp_path / "copy"))
    copy = Engine(spark, str(tmp_path / "copy"), read_only=True)
    assert copy.execute("select * from crew").count() == 3
    with pytest.raises(StoreError):
        copy.execute("delete from crew")
    assert engine.execute("select name from @table").collect()[0].name == "crew"
    assert engine.execute("drop table crew").rows_affected == 6


STOCK = "create table stock (shelf string, code int, units int, primary key (code))"


def test_concurrent_creates_get_ids_of_their_own(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    one, two = engine.begin(), engine.begin()
    one.execute("create table a (k int, primary key (k), index (v, k), v string)")
    two.execute("create table b (k int, primary key (k))")
    one.commit()
    two.commit()
    assert sorted(i for t in engine.tables() for i in t.ids) == [3, 4, 5]
    assert engine.execute("select value from @meta").collect()[0].value == 6


def test_vacuum_spares_open_transactions(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute(STOCK)
    engine.execute("insert into stock (code, shelf, units) values (1, 'left', 5)")
    tx = engine.begin()
    tx.execute("insert into stock (code, shelf, units) values (2, 'right', 7)")
    engine.execute("create table other (k int, primary key (k))")
    assert engine.store.vacuum() == 0
    tx.commit()
    assert engine.execute("select * from stock").count() == 2
    assert engine.store.vacuum(age=0) > 0 and len(engine.store.versions()) == 1
    assert engine.execute("select units from stock").count() == 2


def test_batches_fold_and_fail_whole(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute(STOCK)
    row = lambda k, n: {"code": k, "shelf": f"s{k}", "units": n}
    tx = engine.begin()
    batch = [("insert", "stock", row(k, 0)) for k in range(500)] + [("update", "stock", row(k, 9)) for k in range(0, 500, 2)]
    batch += [("delete", "stock", {"code": 3}), ("delete", "stock", {"code": 9999}), ("insert", "stock", row(3, 4)), ("upsert", "stock", row(5, 0))]
    assert tx.apply_batch(batch).rows_affected == 500 + 250 + 2
    for bad, at in ([("insert", "stock", row(3, 1))], 0), ([("delete", "stock", row(3, 1)), ("update", "stock", row(3, 1))], 1), ([("upsert", "stock", {"code": 1})], 0), ([("upsert", "stock", {**row(1, 1), "units": "x"})], 0):
        with pytest.raises(StoreError, match=f"change {at}"):
            tx.apply_batch(bad)
    tx.commit()
    rows = {r.code: r.units for r in engine.execute("select code, units from stock").collect()}
    assert len(rows) == 500 and rows[3] == 4 and rows[4] == 9 and rows[5] == 0
    tx = engine.begin()
    assert tx.apply_batch([("delete", "stock", {"code": k}) for k in range(490)]).rows_affected == 490
    tx.commit()
    assert engine.execute("select * from stock").count() == 10 and engine.store.stats()["rows"] == 10


def test_limits_beyond_32_bits(spark):
    df = spark.createDataFrame(ROWS, "id bigint, name string, age bigint")
    ask = lambda t: [r.id for r in query(spark, t, df, CREW).collect()]
    assert ask(f"select id from crew limit {2**33}") == [1, 2, 3, 4]
    assert ask(f"select id from crew limit 1, {2**33}") == [2, 3, 4]
    assert ask(f"select id from crew limit {2**33}, 5") == []


def test_hint_chooses_the_order(spark):
    from tallyrill.operators.engine import select

    df = spark.createDataFrame(ROWS, "id bigint, name string, age bigint")
    ask = lambda hint: [r.id for r in select(spark, df, CREW, parse("select id from crew"), hint).collect()]
    assert ask(["id"]) == [1, 2, 3, 4] and ask(["age", "name"]) == sorted((r[0] for r in ROWS), key=lambda i: (ROWS[i - 1][2], ROWS[i - 1][1]))
    with pytest.raises(QueryError):
        ask(["name"])


def test_crash_before_publish_changes_nothing(tmp_path):
    store = Store(str(tmp_path / "db"))
    now = store.load(0)
    store.hook = lambda stage: (_ for _ in ()).throw(OSError("lost"))
    now.version = 1
    with pytest.raises(OSError):
        store.publish(now)
    assert Store(str(tmp_path / "db")).versions() == [0]
    assert Store(str(tmp_path / "db")).publish(now) and not Store(str(tmp_path / "db")).publish(now)
