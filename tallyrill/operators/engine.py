"""Statements, transactions and row operations over a store or over given DataFrames."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.operators import syntax
from tallyrill.operators.binder import column, constant, quoted, scan, type_of, wrapping
from tallyrill.operators.syntax import QueryError, parse
from tallyrill.sources.store import ConflictError, Manifest, Store, StoreError, TableSpec


@dataclass
class Mutation:
    """What a statement changed."""

    rows_affected: int
    message: str = ""
    more: bool = False


def select(spark: SparkSession, df: DataFrame, spec: TableSpec, statement: syntax.Select, hint: list[str] | None = None) -> DataFrame:
    """A SELECT as a plan: bounds, filter, order, offset and limit, projection."""
    columns = dict(spec.columns)
    with wrapping(spark):
        out = scanned(df, spec, statement, hint)
        items = statement.items
        if any(n.op == "col" and n.value == "*" for n, _ in items):
            if len(items) != 1:
                raise QueryError("* stands alone")
            return out.select(*(quoted(c) for c in columns))
        return out.select(*(column(n, columns).alias(name) for n, name in items))


def scanned(df: DataFrame, spec: TableSpec, statement: syntax.Scan, hint: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """A statement's rows; without ``ordered`` they are sorted only where an offset or limit depends on it."""
    columns = dict(spec.columns)
    out, order = scan(df, columns, spec.indexes, spec.key, statement.index_by, hint)
    if statement.where is not None:
        if type_of(statement.where, columns) != "boolean":
            raise QueryError("FILTER takes a condition")
        out = out.filter(column(statement.where, columns))
    if not ordered and not statement.offset and statement.limit is None:
        return out
    out = out.orderBy(*order)
    if max(statement.offset or 0, statement.limit or 0) >= 2**31:
        return _beyond(out, statement.offset or 0, statement.limit)
    out = out.offset(statement.offset) if statement.offset else out
    return out if statement.limit is None else out.limit(statement.limit)


def _beyond(df: DataFrame, offset: int, limit: int | None) -> DataFrame:
    """OFFSET and LIMIT beyond the plan's 32-bit numbers: rows by their 64-bit place in the order."""
    end = offset + limit if limit is not None else None
    placed = df.rdd.zipWithIndex().filter(lambda r: r[1] >= offset and (end is None or r[1] < end))
    return df.sparkSession.createDataFrame(placed.map(lambda r: r[0]), df.schema)


def insert(df: DataFrame, spec: TableSpec, statement: syntax.Insert) -> DataFrame:
    """The statement's rows as a DataFrame in table order."""
    columns = dict(spec.columns)
    if sorted(statement.columns) != sorted(columns):
        raise QueryError("INSERT names every column once")
    rows = []
    for row in statement.rows:
        if len(row) != len(statement.columns):
            raise QueryError("a row has another number of values than columns")
        values = {}
        for c, node in zip(statement.columns, row, strict=True):
            if type_of(node, {}) != columns[c]:
                raise QueryError(f"column {c} takes {columns[c]}")
            values[c] = constant(node)
        rows.append(tuple(values[c] for c in columns))
    return df.sparkSession.createDataFrame(rows, schema_of(spec))


def schema_of(spec: TableSpec) -> str:
    return ", ".join(f"{quoted(c)} {t} not null" for c, t in spec.columns)


def updated(spark: SparkSession, df: DataFrame, spec: TableSpec, statement: syntax.Update) -> DataFrame:
    """New versions of the rows that an UPDATE really changes; right sides see the old row."""
    columns, sets = dict(spec.columns), dict(statement.sets)
    for c, node in sets.items():
        if c in spec.key:
            raise QueryError(f"{c} belongs to the primary key")
        if c not in columns or type_of(node, columns) != columns[c]:
            raise QueryError(f"can't set {c}")
    with wrapping(spark):
        chosen = scanned(df, spec, statement, ordered=False)
        new = [column(sets[c], columns).alias(c) if c in sets else F.col(quoted(c)) for c in columns]
        differs = F.lit(False)
        for c in sets:
            differs = differs | (F.col(quoted(c)) != column(sets[c], columns))
        return chosen.filter(differs).select(*new)


def upserted(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with ``rows`` in place of the rows of their keys."""
    return df.join(rows.select(*(quoted(k) for k in key)), key, "left_anti").select(*(quoted(c) for c in df.columns)).unionByName(rows.select(*(quoted(c) for c in df.columns)))


def classify(df: DataFrame, rows: DataFrame, key: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``merge_class``: inserted, updated or unchanged against ``df``; ``ignore`` columns don't count."""
    plain = [c for c in df.columns if c not in key and c not in ignore]
    old = df.select(*(F.col(quoted(k)) for k in key), F.struct(*(F.col(quoted(c)) for c in plain)).alias("__old"), F.lit(True).alias("__there"))
    same = F.struct(*(F.col(quoted(c)) for c in plain)) == F.col("__old")
    label = F.when(F.col("__there").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return rows.join(old, key, "left").select(*(F.col(quoted(c)) for c in rows.columns), label.alias("merge_class"))


class Transaction:
    """Reads one version; writes stay its own until ``commit``."""

    def __init__(self, engine: "Engine"):
        self.engine, self.spark = engine, engine.spark
        self.base = engine.store.load(engine.store.latest())
        self.now = copy.deepcopy(self.base)
        self.read: set[tuple[str, str]] = set()  # (table, key text or * for a range)
        self.wrote: dict[str, set[str] | None] = {}  # None: the whole table
        self.created: set[str] = set()
        self.done = False

    def spec(self, name: str) -> TableSpec:
        if name in ("@table", "@meta"):
            kinds = [("name", "string"), ("definition", "string")] if name == "@table" else [("key", "string"), ("value", "bigint")]
            return TableSpec(name, kinds, [kinds[0][0]], [[kinds[0][0]]])
        if name not in self.now.tables:
            raise StoreError(f"table not found: {name}")
        spec = dict(self.now.tables[name]["spec"])
        spec["columns"] = [tuple(c) for c in spec["columns"]]
        return TableSpec(**spec)

    def frame(self, name: str) -> DataFrame:
        spec = self.spec(name)
        if name == "@table":
            import json

            rows = [(n, json.dumps(t["spec"])) for n, t in sorted(self.now.tables.items())]
            return self.spark.createDataFrame(rows, schema_of(spec))
        if name == "@meta":
            return self.spark.createDataFrame([("next_prefix", self.now.next_id)], schema_of(spec))
        self.read.add((name, "*"))
        files = self.now.tables[name]["files"]
        schema = schema_of(spec).replace(" not null", "")
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def execute(self, text: str, hint: list[str] | None = None) -> DataFrame | Mutation:
        self._open()
        s = parse(text)
        if isinstance(s, syntax.Select):
            return select(self.spark, self.frame(s.table), self.spec(s.table), s, hint)
        if isinstance(s, syntax.Create):
            return self.create(TableSpec(s.table, s.columns, s.key, s.indexes))
        if isinstance(s, syntax.Drop):
            return self.drop(s.table)
        if s.table.startswith("@"):
            raise StoreError("catalog tables can't be written")
        spec, df = self.spec(s.table), self.frame(s.table)
        if isinstance(s, syntax.Insert):
            return self.put(s.table, insert(df, spec, s), "insert")
        if isinstance(s, syntax.Update):
            return self.put(s.table, updated(self.spark, df, spec, s), "update")
        with wrapping(self.spark):
            doomed = scanned(df, spec, s, ordered=False).select(*(quoted(k) for k in spec.key))
        return self.remove(s.table, doomed)

    def create(self, spec: TableSpec) -> Mutation:
        self._open()
        spec = spec.checked()
        if spec.name in self.now.tables:
            raise StoreError(f"table exists: {spec.name}")
        spec.ids = list(range(self.now.next_id, self.now.next_id + len(spec.indexes)))
        self.now.next_id += len(spec.indexes)
        self.now.tables[spec.name] = {"spec": spec.__dict__.copy(), "files": [], "rows": 0}
        self.wrote[spec.name] = None
        self.created.add(spec.name)
        return Mutation(0, "created")

    def drop(self, name: str) -> Mutation:
        self._open()
        if name.startswith("@"):
            raise StoreError("reserved table")
        spec = self.spec(name)
        rows = self.now.tables.pop(name)["rows"]
        self.wrote[name] = None
        return Mutation(rows * len(spec.indexes), "dropped")

    def put(self, name: str, rows: DataFrame, mode: str = "upsert") -> Mutation:
        """insert (no key may exist), update (every key must) or upsert; counts rows that change."""
        self._open()
        spec, df = self.spec(name), self.frame(name)
        rows = self._kept(rows.select(*(quoted(c) for c, _ in spec.columns)))
        n = rows.count()
        if rows.select(*(quoted(k) for k in spec.key)).distinct().count() != n:
            raise StoreError("a key stands twice among the rows")
        if n and rows.filter(" or ".join(f"{quoted(c)} is null" for c, _ in spec.columns)).limit(1).count():
            raise StoreError("every column needs a value")
        classes = {r.merge_class: r["count"] for r in classify(df, rows, spec.key).groupBy("merge_class").count().collect()}
        if mode == "insert" and sum(classes.values()) != classes.get("inserted", 0):
            raise StoreError("duplicate primary key")
        if mode == "update" and classes.get("inserted"):
            raise StoreError("row not found")
        changed = classes.get("inserted", 0) + classes.get("updated", 0)
        if changed:
            if changed == classes.get("inserted"):  # only new keys: one more file
                self.now.tables[name]["files"] = [*self.now.tables[name]["files"], self._write(classify(df, rows, spec.key).filter("merge_class = 'inserted'").drop("merge_class"), spec)]
            else:
                self.now.tables[name]["files"] = [self._write(upserted(df, rows, spec.key), spec)]
            self.now.tables[name]["rows"] += classes.get("inserted", 0)
            self._mark(name, rows, spec)
        return Mutation(changed, mode)

    def remove(self, name: str, keys: DataFrame, limit: int | None = None) -> Mutation:
        """Delete the rows of the keys, at most ``limit`` in the order given."""
        self._open()
        spec, df = self.spec(name), self.frame(name)
        keys = self._kept(keys if limit is None else keys.limit(limit + 1))
        n = keys.count()
        more = limit is not None and n > limit
        if more:
            keys, n = self._kept(keys.orderBy(*spec.key).limit(limit)), limit
        if n:
            self.now.tables[name]["files"] = [self._write(df.join(keys, spec.key, "left_anti"), spec)]
            self.now.tables[name]["rows"] -= n
            self._mark(name, keys, spec)
        return Mutation(n, "deleted", more)

    def delete_range(self, text: str, limit: int = 1000) -> Mutation:
        """The first ``limit`` rows (at most 10 000) of a DELETE's scan, and whether more are left."""
        if not 0 < limit <= 10_000:
            raise StoreError("limit must be from 1 to 10000")
        s = parse(text)
        spec = self.spec(s.table)
        with wrapping(self.spark):
            return self.remove(s.table, scanned(self.frame(s.table), spec, s).select(*(quoted(k) for k in spec.key)), limit)

    def apply_batch(self, changes: list[tuple[str, str, dict]]) -> Mutation:
        """(mode, table, row) changes in order, all or none; errors name the change's number.

        The old rows of the keys are read once for each table, the changes are played through in order,
        and what is left of them, one row or none for each key, is written at once.
        """
        self._open()
        if len(changes) > 10_000:
            raise StoreError("at most 10000 changes")
        keys, specs = {}, {}
        for k, (mode, name, row) in enumerate(changes):
            try:
                spec = specs.setdefault(name, self.spec(name))
                if name.startswith("@"):
                    raise StoreError("catalog tables can't be written")
                if mode not in ("insert", "update", "upsert", "delete"):
                    raise StoreError(f"unknown mode {mode}")
                for c, kind in spec.columns:
                    if (mode != "delete" or c in spec.key) and type(row[c]) is not {"bigint": int, "string": str}[kind]:
                        raise StoreError(f"column {c} takes {kind}")
                keys.setdefault(name, {})[tuple(row[c] for c in spec.key)] = None
            except KeyError as error:
                raise StoreError(f"change {k}: no value for {error}") from error
            except StoreError as error:
                raise StoreError(f"change {k}: {error}") from error
        old: dict[str, dict[tuple, tuple]] = {}
        for name, own in keys.items():
            spec = specs[name]
            wanted = self.spark.createDataFrame([*own], ", ".join(f"{quoted(c)} {t}" for c, t in spec.columns if c in spec.key))
            found = self.frame(name).join(F.broadcast(wanted), spec.key, "left_semi").select(*(quoted(c) for c, _ in spec.columns))  # at most 10 000 keys
            old[name] = {tuple(r[c] for c in spec.key): tuple(r) for r in found.collect()}
        now, total = {n: dict(rows) for n, rows in old.items()}, 0
        for k, (mode, name, row) in enumerate(changes):
            spec, rows = specs[name], now[name]
            key = tuple(row[c] for c in spec.key)
            if mode == "insert" and key in rows:
                raise StoreError(f"change {k}: duplicate primary key")
            if mode == "update" and key not in rows:
                raise StoreError(f"change {k}: row not found")
            new = None if mode == "delete" else tuple(row[c] for c, _ in spec.columns)
            total += rows.get(key) != new
            rows.pop(key, None)
            if new is not None:
                rows[key] = new
        for name, rows in now.items():
            spec, before = specs[name], old[name]
            gone = [k for k in before if k not in rows]
            put = [r for k, r in rows.items() if before.get(k) != r]
            if gone or put:
                self._replace(name, [k for k in before if k in gone or rows[k] != before[k]], put)
        return Mutation(total, "batch")

    def _replace(self, name: str, keys: list[tuple], rows: list[tuple]) -> None:
        """Take out the rows of the keys, which exist, and add the rows."""
        spec, table = self.spec(name), self.now.tables[name]
        fresh = self._kept(self.spark.createDataFrame(rows, schema_of(spec)))
        if keys:
            gone = self.spark.createDataFrame(keys, ", ".join(f"{quoted(c)} {t}" for c, t in spec.columns if c in spec.key))
            left = self.frame(name).join(F.broadcast(gone), spec.key, "left_anti").select(*(quoted(c) for c, _ in spec.columns))
            table["files"] = [self._write(left.unionByName(fresh), spec)]
        elif rows:
            table["files"] = [*table["files"], self._write(fresh, spec)]
        table["rows"] += len(rows) - len(keys)
        self._mark(name, fresh, spec)

    def commit(self) -> int:
        """Publish; returns the version that now holds the changes."""
        self._open()
        self.done = True
        if not self.wrote:
            return self.base.version
        store = self.engine.store
        while True:
            latest = store.load(store.latest())
            self._check(latest)
            merged, next_id = copy.deepcopy(latest), latest.next_id
            for name in self.wrote:
                if name in self.now.tables:
                    merged.tables[name] = copy.deepcopy(self.now.tables[name])
                    if name in self.created:  # index ids are given out here, so that no two commits share one
                        spec = merged.tables[name]["spec"]
                        spec["ids"] = list(range(next_id, next_id + len(spec["indexes"])))
                        next_id += len(spec["indexes"])
                else:
                    merged.tables.pop(name, None)
            wrote = [{"table": n, "keys": sorted(k) if k is not None else None} for n, k in self.wrote.items()]
            if store.publish(Manifest(latest.version + 1, next_id, merged.tables, wrote)):
                return latest.version + 1

    def abort(self) -> None:
        self.done = True

    def _check(self, latest: Manifest) -> None:
        touched = {t for t, _ in self.read} | set(self.wrote)
        for version in range(self.base.version + 1, latest.version + 1):
            for change in self.engine.store.load(version).wrote:
                if change["table"] in touched:
                    raise ConflictError(f"version {version} changed {change['table']}")

    def _open(self) -> None:
        if self.done:
            raise StoreError("the transaction has ended")

    def _kept(self, rows: DataFrame) -> DataFrame:
        """A change-set is written once, so that counting and publishing see the same rows."""
        if self.engine.store.read_only:
            raise StoreError("the store is read-only")
        path = self.engine.store.new_file()
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _write(self, rows: DataFrame, spec: TableSpec) -> str:
        path = self.engine.store.new_file()
        rows.select(*(quoted(c) for c, _ in spec.columns)).sortWithinPartitions(*(quoted(k) for k in spec.key)).write.parquet(path)
        return path

    def _mark(self, name: str, rows: DataFrame, spec: TableSpec) -> None:
        self.wrote[name] = None


class Engine:
    """A store with a session."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.store = spark, Store(root, read_only)

    def begin(self) -> Transaction:
        return Transaction(self)

    def execute(self, text: str, hint: list[str] | None = None) -> DataFrame | Mutation:
        """One statement in a transaction of its own."""
        tx = self.begin()
        out = tx.execute(text, hint)
        tx.commit()
        return out

    def run(self, work: Callable[[Transaction], object], attempts: int = 4):
        """``work`` in a transaction, again if it conflicts."""
        for left in range(attempts - 1, -1, -1):
            tx = self.begin()
            try:
                out = work(tx)
                tx.commit()
                return out
            except ConflictError:
                if not left:
                    raise

    def tables(self) -> list[TableSpec]:
        tx = self.begin()
        return [tx.spec(n) for n in sorted(tx.now.tables)]


def query(spark: SparkSession, text: str, df: DataFrame, spec: TableSpec) -> DataFrame:
    """A SELECT over a DataFrame that stands for the table."""
    return select(spark, df, spec, parse(text))
