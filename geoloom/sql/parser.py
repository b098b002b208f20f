"""Tokens and syntax trees of the SELECT dialect.

    SELECT [DISTINCT|ALL] * | expr [[AS] alias], ... FROM table [alias]
      [WHERE expr] [ORDER BY field [ASC|DESC], ...] [LIMIT n] [OFFSET n]

There are no joins, groups or sub-queries; aggregates are over the whole table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|\d+(?:[eE][-+]?\d+)?)|'(?P<str>(?:[^']|'')*)'|"(?P<quoted>(?:[^"]|"")*)"|(?P<name>[A-Za-z_\x80-\U0010ffff][\w]*)|(?P<op><>|!=|<=|>=|[-+*/%=<>(),.]))""",
    re.S,
)


class SqlError(ValueError):
    """The statement isn't in the dialect, or doesn't fit the layer."""


@dataclass(frozen=True)
class Token:
    kind: str  # num, str, name, quoted, op, end
    text: str

    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    sql = sql.rstrip().rstrip(";")
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m or m.end() == at:
            if not sql[at:].strip():
                break
            raise SqlError(f"unexpected text at {sql[at : at + 20]!r}")
        kind = m.lastgroup
        text = m[kind]
        if kind == "str":
            text = text.replace("''", "'")
        if kind == "quoted":
            text = text.replace('""', '"')
        out.append(Token(kind, text))
        at = m.end()
    return [*out, Token("end", "")]


@dataclass
class Node:
    """op: lit, col, call, cast, star, or an operator's name; args are nodes, and `value` what belongs to the op itself."""

    op: str
    args: list[Node] = field(default_factory=list)
    value: object = None


@dataclass
class Select:
    items: list[tuple[Node, str | None]]
    table: str
    alias: str | None
    distinct: bool = False
    where: Node | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    source: str | None = None  # FROM 'source'.table


RESERVED = frozenset("SELECT DISTINCT ALL FROM WHERE ORDER BY LIMIT OFFSET AS AND OR NOT IN BETWEEN LIKE ILIKE ESCAPE IS NULL CAST ASC DESC UNION JOIN LEFT ON".split())
COMPARE = frozenset(["=", "<>", "!=", "<", "<=", ">", ">="])


class Parser:
    def __init__(self, sql: str):
        self.toks, self.at = tokens(sql), 0

    def peek(self, *words: str) -> bool:
        t = self.toks[self.at]
        return t.word() in words or (t.kind == "op" and t.text in words)

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SqlError(f"expected {word} before {self.toks[self.at].text!r}")

    def name(self) -> str:
        t = self.toks[self.at]
        if t.kind == "quoted" or (t.kind == "name" and t.word() not in RESERVED):
            self.at += 1
            return t.text
        raise SqlError(f"expected a name before {t.text!r}")

    def integer(self) -> int:
        t = self.toks[self.at]
        if t.kind != "num" or not t.text.isdigit():
            raise SqlError("expected a whole number")
        self.at += 1
        return int(t.text)

    def end(self) -> None:
        if self.toks[self.at].kind != "end":
            raise SqlError(f"unexpected {self.toks[self.at].text!r}")

    def select(self) -> Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        if not distinct:
            self.take("ALL")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("FROM")
        t = self.toks[self.at]
        if t.kind == "str":
            self.at += 1
            table = t.text
        else:
            table = self.name()
        source = None
        if self.take("."):
            source, table = table if t.kind == "str" else None, self.name()
        alias = None
        if self.take("AS") or self.toks[self.at].kind in ("name", "quoted") and self.toks[self.at].word() not in RESERVED:
            alias = self.name()
        out = Select(items, table, alias, distinct, source=source)
        if self.take("WHERE"):
            out.where = self.expr()
        if self.take("ORDER"):
            self.need("BY")
            while True:
                key = self.name()
                if self.take("."):
                    key = self.name()
                down = self.take("DESC")
                if not down:
                    self.take("ASC")
                out.order.append((key, down))
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            out.limit = self.integer()
        if self.take("OFFSET"):
            out.offset = self.integer()
        self.end()
        return out

    def item(self) -> tuple[Node, str | None]:
        if self.take("*"):
            return Node("star"), None
        e = self.expr()
        if self.take("AS"):
            return e, self.name()
        if self.toks[self.at].kind in ("name", "quoted") and self.toks[self.at].word() not in RESERVED:
            return e, self.name()
        return e, None

    def expr(self) -> Node:
        left = self.conj()
        while self.take("OR"):
            left = Node("or", [left, self.conj()])
        return left

    def conj(self) -> Node:
        left = self.negated()
        while self.take("AND"):
            left = Node("and", [left, self.negated()])
        return left

    def negated(self) -> Node:
        return Node("not", [self.negated()]) if self.take("NOT") else self.compared()

    def compared(self) -> Node:
        left = self.sum()
        while True:
            t = self.toks[self.at]
            if t.kind == "op" and t.text in COMPARE:
                self.at += 1
                left = Node("<>" if t.text == "!=" else t.text, [left, self.sum()])
                continue
            if self.take("IS"):
                negative = self.take("NOT")
                self.need("NULL")
                left = Node("isnull", [left])
                left = Node("not", [left]) if negative else left
                continue
            negative = self.peek("NOT") and self.toks[self.at + 1].word() in ("IN", "BETWEEN", "LIKE", "ILIKE")
            self.at += negative
            if self.take("IN"):
                self.need("(")
                items = [self.sum()]
                while self.take(","):
                    items.append(self.sum())
                self.need(")")
                left = Node("in", [left, *items])
            elif self.take("BETWEEN"):
                low = self.sum()
                self.need("AND")
                left = Node("between", [left, low, self.sum()])
            elif self.peek("LIKE", "ILIKE"):
                op = self.toks[self.at].word().lower()
                self.at += 1
                args = [left, self.sum()]
                if self.take("ESCAPE"):
                    args.append(self.sum())
                left = Node(op, args)
            else:
                return left
            left = Node("not", [left]) if negative else left

    def sum(self) -> Node:
        left = self.product()
        while self.peek("+", "-"):
            op = self.toks[self.at].text
            self.at += 1
            left = Node(op, [left, self.product()])
        return left

    def product(self) -> Node:
        left = self.unary()
        while self.peek("*", "/", "%"):
            op = self.toks[self.at].text
            self.at += 1
            left = Node(op, [left, self.unary()])
        return left

    def unary(self) -> Node:
        if self.take("-"):
            inner = self.unary()
            if inner.op == "lit" and isinstance(inner.value, int | float) and not isinstance(inner.value, bool):
                return Node("lit", value=-inner.value)
            return inner if inner.op == "lit" and isinstance(inner.value, str) else Node("neg", [inner])
        self.take("+")
        return self.primary()

    def primary(self) -> Node:
        t = self.toks[self.at]
        if t.kind == "num":
            self.at += 1
            return Node("lit", value=int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "str":
            self.at += 1
            return Node("lit", value=t.text)
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("NULL"):
            return Node("lit")
        if self.take("CAST"):
            self.need("(")
            e = self.expr()
            self.need("AS")
            kind, sizes = self.name().upper(), []
            if self.take("("):
                sizes.append(self.integer())
                if self.take(","):
                    sizes.append(self.integer())
                self.need(")")
            self.need(")")
            return Node("cast", [e], (kind, sizes))
        name = self.name()
        if self.take("("):
            distinct = self.take("DISTINCT")
            args = []
            if self.take("*"):
                args.append(Node("star"))
            elif not self.peek(")"):
                args.append(self.expr())
                while self.take(","):
                    args.append(self.expr())
            self.need(")")
            return Node("call", args, (name.upper(), distinct))
        if self.take("."):
            return Node("col", value=(name, self.name()))
        return Node("col", value=(None, name))


def parse_select(sql: str) -> Select:
    return Parser(sql).select()


def parse_expr(sql: str) -> Node:
    p = Parser(sql)
    out = p.expr()
    p.end()
    return out
