"""Lexer and parser of the table language; errors carry the byte offset.

Operators bind, from loosest: OR, AND, NOT, one comparison, + and -, * and /, sign.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A statement that can't be read, bound or run."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, number, string, punct, end
    text: str
    at: int


@dataclass(frozen=True)
class Node:
    """op: int, str, bool, col, tuple, neg, not, or a binary operator's symbol."""

    op: str
    value: Any = None
    kids: tuple["Node", ...] = ()
    at: int = 0


@dataclass
class Scan:
    table: str = ""
    index_by: Node | None = None
    where: Node | None = None
    offset: int = 0
    limit: int | None = None


@dataclass
class Select(Scan):
    items: list[tuple[Node, str]] = field(default_factory=list)


@dataclass
class Insert:
    table: str
    columns: list[str]
    rows: list[list[Node]]


@dataclass
class Update(Scan):
    sets: list[tuple[str, Node]] = field(default_factory=list)


@dataclass
class Delete(Scan):
    pass


@dataclass
class Create:
    table: str
    columns: list[tuple[str, str]]
    key: list[str]
    indexes: list[list[str]]


@dataclass
class Drop:
    table: str


TYPES = {"string": "string", "bytes": "string", "text": "string", "int": "bigint", "int64": "bigint", "integer": "bigint"}
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
LEXEME = re.compile(r"""(?P<skip>\s+|--[^\n]*)|(?P<name>(?:[^\W\d]|@)[\w@]*)|(?P<number>[0-9]+)|(?P<string>'(?:''|\\.|[^'\\])*'|"(?:""|\\.|[^"\\])*")|(?P<punct><=|>=|!=|<>|==|[(),;=<>+\-*/])""", re.DOTALL)


def lex(text: str) -> list[Token]:
    out, at = [], 0
    offset = lambda k: len(text[:k].encode("utf-8", "surrogatepass"))
    while at < len(text):
        m = LEXEME.match(text, at)
        if m is None:
            what = "unterminated string" if text[at] in "'\"" else f"invalid character {text[at]!r}"
            raise QueryError(f"{what} at byte {offset(at)}")
        if m.lastgroup != "skip":
            value = m[0]
            if m.lastgroup == "string":
                quote, body = value[0], value[1:-1]
                value = re.sub(rf"\\(.)|{quote}{quote}", lambda e, q=quote: ESCAPES.get(e[1], e[1]) if e[1] else q, body, flags=re.DOTALL)
            out.append(Token(m.lastgroup, value, offset(at)))
        at = m.end()
    return [*out, Token("end", "", offset(at))]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = lex(text), 0, 0

    def fail(self, what: str):
        raise QueryError(f"parse error at byte {self.here.at}: {what}")

    @property
    def here(self) -> Token:
        return self.tokens[self.at]

    def punct(self, *texts: str) -> str | None:
        if self.here.kind == "punct" and self.here.text in texts:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def word(self, *words: str) -> bool:
        part = self.tokens[self.at : self.at + len(words)]
        if len(part) == len(words) and all(t.kind == "name" and t.text.lower() == w for t, w in zip(part, words, strict=True)):
            self.at += len(words)
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.punct(text) or text.isalpha() and self.word(text)):
            self.fail(f"expected {text!r}, got {self.here.text!r}")

    def name(self) -> str:
        if self.here.kind != "name":
            self.fail(f"expected a name, got {self.here.text!r}")
        self.at += 1
        return self.tokens[self.at - 1].text

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.punct(","):
            out.append(self.name())
        self.need(")")
        return out

    def whole(self):
        out = self.statement()
        self.punct(";")
        if self.here.kind != "end":
            self.fail("one statement only")
        return out

    def statement(self):
        if self.word("create", "table"):
            return self.create()
        if self.word("drop", "table"):
            return Drop(self.name())
        if self.word("select"):
            return self.select()
        if self.word("insert", "into"):
            return self.insert()
        if self.word("update"):
            return self.update()
        if self.word("delete", "from"):
            return self.clauses(Delete(self.name()))
        return self.fail("expected CREATE, DROP, SELECT, INSERT, UPDATE or DELETE")

    def create(self) -> Create:
        table, columns, key, indexes = self.name(), [], [], []
        self.need("(")
        while not self.punct(")"):
            if self.word("primary", "key"):
                if key:
                    self.fail("a second PRIMARY KEY")
                key = self.names()
            elif self.here.kind == "name" and self.here.text.lower() == "index" and (self.tokens[self.at + 1].text == "(" or self.tokens[self.at + 2].text == "("):
                self.at += 1
                if self.here.kind == "name":
                    self.name()  # an index's name has no meaning
                indexes.append(self.names())
            else:
                column, kind = self.name(), self.name().lower()
                if kind not in TYPES:
                    self.fail(f"unknown type {kind!r}")
                columns.append((column, TYPES[kind]))
            if not self.punct(","):
                self.need(")")
                break
        return Create(table, columns, key, indexes)

    def select(self) -> Select:
        items = []
        while True:
            if self.here.kind == "punct" and self.here.text == "*":
                node = Node("col", "*", at=self.here.at)
                self.at += 1
            else:
                node = self.either()
            name = self.name() if self.word("as") else node.value if node.op == "col" else f"expr{len(items) + 1}"
            items.append((node, name))
            if not self.punct(","):
                break
        self.need("from")
        return self.clauses(Select(self.name(), items=items))

    def insert(self) -> Insert:
        table, columns, rows = self.name(), self.names(), []
        self.need("values")
        while True:
            self.need("(")
            row = [self.either()]
            while self.punct(","):
                row.append(self.either())
            self.need(")")
            rows.append(row)
            if not self.punct(","):
                return Insert(table, columns, rows)

    def update(self) -> Update:
        out = Update(self.name())
        self.need("set")
        while True:
            column = self.name()
            self.need("=")
            out.sets.append((column, self.either()))
            if not self.punct(","):
                return self.clauses(out)

    def clauses(self, scan):
        if self.word("index", "by"):
            scan.index_by = self.either()
        if self.word("filter") or self.word("where"):
            scan.where = self.either()
        if self.word("limit"):
            scan.limit = self.count()
            if self.punct(","):
                scan.offset, scan.limit = scan.limit, self.count()
        return scan

    def count(self) -> int:
        if self.here.kind != "number" or int(self.here.text) >= 1 << 63:
            self.fail("LIMIT takes non-negative integers")
        self.at += 1
        return int(self.tokens[self.at - 1].text)

    def left(self, below, symbols: dict[str, str], words: bool = False) -> Node:
        out = below()
        while True:
            at = self.here.at
            symbol = next((s for s in symbols if self.word(s)), None) if words else self.punct(*symbols)
            if symbol is None:
                return out
            out = Node(symbols[symbol], None, (out, below()), at)

    def either(self) -> Node:
        self.depth += 1
        if self.depth > 200:
            self.fail("expression nested too deeply")
        out = self.left(self.all_of, {"or": "or"}, True)
        self.depth -= 1
        return out

    def all_of(self) -> Node:
        return self.left(self.negated, {"and": "and"}, True)

    def negated(self) -> Node:
        at, n = self.here.at, 0
        while self.word("not"):
            n += 1
        out = self.compared()
        for _ in range(n):
            out = Node("not", None, (out,), at)
        return out

    def compared(self) -> Node:
        out, at = self.added(), self.here.at
        if symbol := self.punct("=", "==", "!=", "<>", "<", "<=", ">", ">="):
            return Node({"==": "=", "<>": "!="}.get(symbol, symbol), None, (out, self.added()), at)
        return out

    def added(self) -> Node:
        return self.left(self.multiplied, {"+": "+", "-": "-"})

    def multiplied(self) -> Node:
        return self.left(self.signed, {"*": "*", "/": "/"})

    def signed(self) -> Node:
        at, signs = self.here.at, []
        while sign := self.punct("+", "-"):
            signs.append(sign)
        out = self.atom()
        for _ in range(signs.count("-")):
            out = Node("neg", None, (out,), at)
        return out

    def atom(self) -> Node:
        token = self.here
        self.at += 1
        if token.kind == "number":
            if int(token.text) >= 1 << 63:
                self.at -= 1
                self.fail("integer out of range")
            return Node("int", int(token.text), at=token.at)
        if token.kind == "string":
            return Node("str", token.text, at=token.at)
        if token.kind == "name":
            if token.text.lower() in ("true", "false"):
                return Node("bool", token.text.lower() == "true", at=token.at)
            return Node("col", token.text, at=token.at)
        if token.kind == "punct" and token.text == "(":
            kids = [self.either()]
            while self.punct(","):
                kids.append(self.either())
            self.need(")")
            return kids[0] if len(kids) == 1 else Node("tuple", None, tuple(kids), token.at)
        self.at -= 1
        return self.fail(f"expected an expression, got {token.text!r}")


def parse(text: str):
    return Parser(text).whole()
