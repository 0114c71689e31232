"""Types, constants and columns of expressions, and INDEX BY bounds.

Operands are type-checked before Spark sees them, so nothing is cast silently.  ``+ - *`` wrap
around in 64 bits; ``/`` truncates toward zero and fails on zero; negating the smallest
integer fails.  Plans are built with ANSI arithmetic off (``wrapping``), which Spark fixes when
an expression is resolved; the caller's setting comes back at once.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.operators.syntax import Node, QueryError

LOW, SPAN = -(1 << 63), 1 << 64
COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@contextlib.contextmanager
def wrapping(spark: SparkSession):
    """ANSI arithmetic off while a plan is built."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def wrap(n: int) -> int:
    return (n - LOW) % SPAN + LOW


def type_of(node: Node, columns: dict[str, str]) -> str:
    """bigint, string or boolean; fails on unknown columns and operands that don't fit."""
    if node.op in ("int", "str", "bool"):
        return {"int": "bigint", "str": "string", "bool": "boolean"}[node.op]
    if node.op == "col":
        if node.value not in columns:
            raise QueryError(f"unknown column {node.value!r} at byte {node.at}")
        return columns[node.value]
    if node.op == "tuple":
        raise QueryError(f"a tuple stands only in INDEX BY, at byte {node.at}")
    kinds = [type_of(k, columns) for k in node.kids]
    if node.op in ("and", "or", "not"):
        want, out = "boolean", "boolean"
    elif node.op == "neg":
        want, out = "bigint", "bigint"
    elif node.op in COMPARE:
        want, out = kinds[0], "boolean"
    elif node.op == "+" and kinds == ["string", "string"]:
        return "string"
    else:
        want, out = "bigint", "bigint"
    if any(k != want for k in kinds):
        raise QueryError(f"operator {node.op} at byte {node.at} doesn't take {' and '.join(kinds)}")
    return out


def constant(node: Node):
    """The value of an expression without columns."""
    type_of(node, {})
    if node.op in ("int", "str", "bool"):
        return node.value
    a, *rest = [constant(k) for k in node.kids]
    b = rest[0] if rest else None
    if node.op in COMPARE:
        return COMPARE[node.op](a.encode() if isinstance(a, str) else a, b.encode() if isinstance(b, str) else b)
    if node.op == "neg":
        if a == LOW:
            raise QueryError("integer overflow")
        return -a
    if node.op == "/":
        if b == 0:
            raise QueryError("division by zero")
        return wrap(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
    if node.op in "+-*":
        return a + b if isinstance(a, str) else wrap({"+": a + b, "-": a - b}.get(node.op, a * b) if node.op != "*" else a * b)
    return {"and": lambda: a and b, "or": lambda: a or b, "not": lambda: not a}[node.op]()


def column(node: Node, columns: dict[str, str]) -> Column:
    """The Column of a checked expression; build it within ``wrapping``."""
    kind = type_of(node, columns)
    if node.op == "int":
        return F.lit(node.value).cast("bigint")
    if node.op in ("str", "bool"):
        return F.lit(node.value)
    if node.op == "col":
        return F.col(quoted(node.value))
    a, *rest = [column(k, columns) for k in node.kids]
    b = rest[0] if rest else None
    if node.op in COMPARE:
        return COMPARE[node.op](a, b)
    if node.op == "not":
        return ~a
    if node.op in ("and", "or"):
        if guarded(node):  # errors only where the reference order reaches them
            return F.when(a, b).otherwise(F.lit(False)) if node.op == "and" else F.when(a, F.lit(True)).otherwise(b)
        return a & b if node.op == "and" else a | b
    if node.op == "neg":
        return F.when(a == F.lit(LOW), F.raise_error(F.lit("integer overflow")).cast("bigint")).otherwise(-a)
    if node.op == "/":
        return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(F.call_function("div", a, b))
    if kind == "string":
        return F.concat(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[node.op]


def guarded(node: Node) -> bool:
    """Whether evaluation can fail."""
    return node.op in ("/", "neg") and not (node.op == "neg" and node.kids[0].op == "int") or any(guarded(k) for k in node.kids)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Bound:
    columns: tuple[str, ...]
    op: str
    values: tuple


def bounds(node: Node | None) -> list[Bound]:
    """INDEX BY as one comparison or two; an equality stands alone."""
    flat: list[Node] = []

    def walk(n: Node) -> None:
        if n.op == "and":
            for k in n.kids:
                walk(k)
        else:
            flat.append(n)

    if node is None:
        return []
    walk(node)
    out = [_bound(n) for n in flat]
    if len(out) > 2 or len(out) == 2 and any(b.op == "=" for b in out):
        raise QueryError("INDEX BY takes one comparison or a two-sided range")
    if len(out) == 2 and (out[0].op[0] == out[1].op[0]):
        raise QueryError("bounds must have opposite directions")
    return out


def _bound(node: Node) -> Bound:
    if node.op not in COMPARE or node.op == "!=":
        raise QueryError("INDEX BY takes =, <, <=, > or >=")

    def split(n: Node) -> tuple[Node, ...]:
        return n.kids if n.op == "tuple" else (n,)

    left, right = node.kids
    op = node.op
    if not all(n.op == "col" for n in split(left)):
        left, right, op = right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
    columns, values = split(left), split(right)
    if not all(n.op == "col" for n in columns) or len(columns) != len(values):
        raise QueryError("INDEX BY compares a tuple of columns to as many constants")
    return Bound(tuple(n.value for n in columns), op, tuple(constant(n) for n in values))


def lexicographic(bound: Bound) -> Column:
    """The bound over its columns only, in a form that reaches the scan as pushed filters."""
    cols = [F.col(quoted(c)) for c in bound.columns]
    if bound.op == "=":
        out = cols[0] == F.lit(bound.values[0])
        for c, v in zip(cols[1:], bound.values[1:], strict=True):
            out = out & (c == F.lit(v))
        return out
    strict = COMPARE[bound.op[0]]
    out = COMPARE[bound.op](cols[-1], F.lit(bound.values[-1]))
    for c, v in list(zip(cols, bound.values, strict=True))[-2::-1]:
        out = strict(c, F.lit(v)) | ((c == F.lit(v)) & out)
    if len(cols) > 1:  # the leading column's own range prunes row groups
        out = COMPARE[bound.op[0] + "="](cols[0], F.lit(bound.values[0])) & out
    return out


def scan(df: DataFrame, columns: dict[str, str], indexes: list[list[str]], key: list[str], index_by: Node | None, hint: list[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """The rows within the bounds, and the order that the chosen index gives them."""
    limits = bounds(index_by)
    chosen = next((i for i in indexes if (hint is None or i == hint) and all(list(b.columns) == i[: len(b.columns)] for b in limits)), None)
    if chosen is None:
        raise QueryError(f"no index covers {[list(b.columns) for b in limits]}")
    for b in limits:
        for c, v in zip(b.columns, b.values, strict=True):
            kind = "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "string"
            if columns[c] != kind:
                raise QueryError(f"column {c} of type {columns[c]} can't be compared with {kind}")
        df = df.filter(lexicographic(b))
    down = bool(limits) and limits[0].op[0] == "<"
    order = [*chosen, *(k for k in key if k not in chosen)]
    return df, [F.col(quoted(c)).desc() if down else F.col(quoted(c)).asc() for c in order]
