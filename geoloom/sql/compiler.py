"""Binds syntax trees to a layer's schema and gives DataFrame columns.

What differs from Spark SQL: names and strings compare without regard to ASCII case; `/` on integers truncates; a zero
divisor gives 2147483647; null items of IN are skipped; SUBSTR counts a negative start from the end and clamps it; CAST
takes the numeric prefix of a string; nulls sort first; aggregates ignore ORDER BY, LIMIT and OFFSET.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import geometry as g
from geoloom.functions.cast import prefix_double, prefix_long

from .parser import Node, Select, SqlError, parse_expr, parse_select

DIV_ZERO = 2147483647
AGGREGATES = frozenset(["COUNT", "SUM", "AVG", "MIN", "MAX"])


@dataclass
class Bound:
    col: Column
    kind: str  # int, real, str, bool, null
    literal: object = None
    is_literal: bool = False
    bare: Column | None = None  # a string column as stored, for comparisons that a scan can use


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType | T.IntegralType):
        return "int"
    if isinstance(t, T.FractionalType | T.DecimalType):
        return "real"
    return "str"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fields that every layer with geometry has; a prefix of three letters before them is read over.
SPECIAL = re.compile(r"(?:[a-z]{3}_)?(geometry|geom_wkt|geom_area|style)")


def fold(c: Column) -> Column:
    """ASCII letters in lower case; others stay."""
    return F.translate(c, UPPER, LOWER)


def folded(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def case_variants(text: str) -> list[str]:
    return ["".join(x) for x in product(*[(c.lower(), c.upper()) if c.isascii() and c.isalpha() else (c,) for c in text])]


class Compiler:
    def __init__(self, schema: T.StructType, table: str | None = None, alias: str | None = None):
        self.fields = {f.name.lower(): f for f in schema}
        self.names = {x.lower() for x in (table, alias) if x}

    def column(self, qualifier: str | None, name: str) -> Bound:
        if qualifier is not None and self.names and qualifier.lower() not in self.names:
            raise SqlError(f"unknown table {qualifier}")
        f = self.fields.get(name.lower())
        if f is None and "geom" in self.fields and (m := SPECIAL.fullmatch(name.lower())):
            return self.special(m[1])
        if f is None:
            raise SqlError(f"unknown field {name}")
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            return Bound(c.cast("int"), "int")
        if isinstance(f.dataType, T.DateType | T.TimestampType):
            return Bound(c.cast("string"), "str")
        return Bound(c, _kind(f.dataType), bare=c)

    def special(self, name: str) -> Bound:
        """The type name, text, area or style of the geometry."""
        geom = F.col(f"`{self.fields['geom'].name}`")
        if name == "style":
            return Bound(F.lit(None).cast("string"), "str")
        if name == "geom_area":
            return Bound(g.geometry_udf(g.area, "double")(geom), "real")
        return Bound(g.geometry_udf(g.to_wkt if name == "geom_wkt" else lambda x: g.NAMES[x[0]].upper(), "string")(geom), "str")

    def bind(self, n: Node) -> Bound:
        if n.op == "lit":
            v = n.value
            kind = "null" if v is None else "str" if isinstance(v, str) else "real" if isinstance(v, float) else "int"
            return Bound(F.lit(v), kind, v, True)
        if n.op == "col":
            return self.column(*n.value)
        if n.op in ("and", "or"):
            a, b = (self.truth(x) for x in n.args)
            return Bound(a & b if n.op == "and" else a | b, "bool")
        if n.op == "not":
            return Bound(~self.truth(n.args[0]), "bool")
        if n.op == "isnull":
            return Bound(self.bind(n.args[0]).col.isNull(), "bool")
        if n.op in ("=", "<>", "<", "<=", ">", ">="):
            return Bound(self.compare(n.op, *(self.bind(x) for x in n.args)), "bool")
        if n.op == "between":
            x, low, high = (self.bind(a) for a in n.args)
            return Bound(self.compare(">=", x, low) & self.compare("<=", x, high), "bool")
        if n.op == "in":
            x, *items = (self.bind(a) for a in n.args)
            items = [i for i in items if i.kind != "null"]
            if not items:
                return Bound(F.when(x.col.isNotNull(), F.lit(False)), "bool")
            out = self.compare("=", x, items[0])
            for i in items[1:]:
                out = out | self.compare("=", x, i)
            return Bound(out, "bool")
        if n.op in ("like", "ilike"):
            x, p, *esc = (self.bind(a) for a in n.args)
            return Bound(self.like(x, p, esc[0].literal if esc else None, n.op == "ilike"), "bool")
        if n.op == "neg":
            x = self.bind(n.args[0])
            return Bound(-x.col, x.kind)
        if n.op in "+-*/%":
            return self.arithmetic(n.op, *(self.bind(x) for x in n.args))
        if n.op == "cast":
            return self.cast(self.bind(n.args[0]), *n.value)
        if n.op == "call":
            return self.call(n)
        raise SqlError(f"{n.op} can't stand here")

    def truth(self, n: Node) -> Column:
        b = self.bind(n)
        if b.kind == "bool":
            return b.col
        if b.kind in ("int", "real"):
            return b.col != 0
        if b.kind == "null":
            return F.lit(None).cast("boolean")
        raise SqlError("a string isn't a condition")

    @staticmethod
    def _number(b: Bound) -> Bound:
        """A string literal next to a number is read as one."""
        if b.is_literal and b.kind == "str":
            try:
                v = int(b.literal)
                return Bound(F.lit(v), "int", v, True)
            except ValueError:
                try:
                    return Bound(F.lit(float(b.literal)), "real", float(b.literal), True)
                except ValueError:
                    raise SqlError(f"{b.literal!r} isn't a number") from None
        return b

    def compare(self, op: str, a: Bound, b: Bound) -> Column:
        if "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        if (a.kind == "str") != (b.kind == "str"):
            a, b = self._number(a), self._number(b)
            if (a.kind == "str") != (b.kind == "str"):
                raise SqlError("a string can't be compared with a number")
        if a.kind != "str":
            x, y = a.col, b.col
        elif op == "=" and (lit := b if b.is_literal else a if a.is_literal else None) is not None and (other := a if lit is b else b).bare is not None:
            # An equality that a scan can prune by: the string itself, or the few ways to write it.
            letters = sum(c.isascii() and c.isalpha() for c in lit.literal)
            if letters <= 4:
                ways = case_variants(lit.literal)
                return other.bare == ways[0] if len(ways) == 1 else other.bare.isin(ways)
            return fold(other.bare) == F.lit(folded(lit.literal))
        else:
            x, y = fold(a.col), fold(b.col)
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    @staticmethod
    def like(x: Bound, p: Bound, escape: str | None, any_case: bool) -> Column:
        if x.kind != "str" or not p.is_literal or not isinstance(p.literal, str):
            raise SqlError("LIKE wants a string and a pattern")
        pattern, out, k = p.literal, "", 0
        while k < len(pattern):  # to Spark's pattern, whose escape is a backslash
            c = pattern[k]
            if escape and c == escape and k + 1 < len(pattern):
                k += 1
                out += "\\" + pattern[k] if pattern[k] in "%_\\" else pattern[k]
            else:
                out += "\\\\" if c == "\\" else c
            k += 1
        return fold(x.col).like(folded(out)) if any_case else x.col.like(out)

    def arithmetic(self, op: str, a: Bound, b: Bound) -> Bound:
        if op == "+" and a.kind == b.kind == "str":
            return Bound(F.concat(a.col, b.col), "str")
        a, b = self._number(a), self._number(b)
        if "str" in (a.kind, b.kind):
            raise SqlError(f"{op} wants numbers")
        if "null" in (a.kind, b.kind):
            return Bound(F.lit(None).cast("double"), "real")
        whole = a.kind in ("int", "bool") and b.kind in ("int", "bool")
        t = "bigint" if whole else "double"
        x, y = a.col.cast(t), b.col.cast(t)
        kind = "int" if whole else "real"
        if op in "+-*":
            return Bound({"+": x + y, "-": x - y, "*": x * y}[op], kind)
        zero = F.lit(DIV_ZERO).cast(t)
        safe = F.when(y != 0, y)
        if op == "/":
            value = F.call_function("div", x, safe) if whole else x / safe
        else:
            value = x % safe
        return Bound(F.when(y == 0, F.when(x.isNotNull(), zero)).otherwise(value), kind)

    def cast(self, x: Bound, kind: str, sizes: list[int]) -> Bound:
        whole = prefix_long(x.col) if x.kind == "str" else x.col.cast("double").cast("bigint") if x.kind == "real" else x.col.cast("bigint")
        real = prefix_double(x.col) if x.kind == "str" else x.col.cast("double")
        if kind in ("INTEGER", "INT"):
            low, high = F.lit(-(2**31)), F.lit(2**31 - 1)
            return Bound(F.when(whole.isNotNull(), F.greatest(low, F.least(high, whole))).cast("int"), "int")
        if kind == "BIGINT":
            return Bound(whole, "int")
        if kind == "SMALLINT":  # wraps
            return Bound((F.pmod(whole + 32768, F.lit(65536)) - 32768).cast("smallint"), "int")
        if kind == "BOOLEAN":
            return Bound(F.when(whole.isNotNull(), (whole != 0).cast("int")), "int")
        if kind in ("FLOAT", "REAL", "DOUBLE", "NUMERIC"):
            return Bound(real, "real")
        if kind in ("CHARACTER", "VARCHAR", "TEXT"):
            text = x.col.cast("string")
            return Bound(F.substring(text, 1, sizes[0]) if sizes else text, "str")
        if kind in ("DATE", "TIME", "TIMESTAMP"):
            return Bound(x.col.cast("string"), "str")
        raise SqlError(f"unknown type {kind}")

    def call(self, n: Node) -> Bound:
        name, distinct = n.value
        if name in AGGREGATES:
            return self.aggregate(name, distinct, n.args)
        args = [self.bind(a) for a in n.args]
        if name == "CONCAT":
            if any(a.kind not in ("str", "null") for a in args):
                raise SqlError("CONCAT wants strings")
            return Bound(F.concat(*[a.col.cast("string") for a in args]), "str")
        if name == "SUBSTR" and len(args) in (2, 3):
            text, start = args[0].col, args[1].col.cast("int")
            first = F.when(start < 0, F.greatest(F.length(text) + start, F.lit(0)) + 1).otherwise(F.greatest(start, F.lit(1)))
            size = args[2].col.cast("int") if len(args) == 3 else F.lit(2**31 - 1)
            return Bound(F.substring(text, first, size), "str")
        raise SqlError(f"unknown function {name}")

    def aggregate(self, name: str, distinct: bool, args: list[Node]) -> Bound:
        if len(args) != 1 or (distinct and name != "COUNT"):
            raise SqlError(f"{name} wants one argument")
        if args[0].op == "star":
            if name != "COUNT":
                raise SqlError("only COUNT takes *")
            return Bound(F.count(F.lit(1)), "int")
        x = self.bind(args[0])
        if name == "COUNT":
            return Bound(F.count_distinct(x.col) if distinct else F.count(x.col), "int")
        if name in ("SUM", "AVG") and x.kind == "str":
            raise SqlError(f"{name} wants numbers")
        if name == "SUM":
            return Bound(F.sum(x.col.cast("bigint" if x.kind == "int" else "double")), x.kind)
        if name == "AVG":
            return Bound(F.avg(x.col.cast("double")), "real")
        return Bound(F.min(x.col) if name == "MIN" else F.max(x.col), x.kind)


def has_aggregate(n: Node) -> bool:
    return (n.op == "call" and n.value[0] in AGGREGATES) or any(has_aggregate(a) for a in n.args)


def default_name(n: Node, k: int) -> str:
    if n.op == "col":
        return n.value[1] if n.value[0] is None else f"{n.value[0]}.{n.value[1]}"
    if n.op == "call" and n.args:
        return f"{n.value[0]}_{n.args[0].value[1] if n.args[0].op == 'col' else '*'}"
    return f"FIELD_{k + 1}"


def where(df: DataFrame, condition: str) -> DataFrame:
    """The rows for which the condition is true."""
    return df.filter(Compiler(df.schema).truth(parse_expr(condition)))


def execute_sql(layers: dict[str, DataFrame] | DataFrame, sql: str, fid: str | None = None, opener: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Runs one SELECT. layers: by name, or one DataFrame for any name. fid: the column that FID means, and the last sort key.
    opener: gives the table of a second data source (FROM 'source'.table)."""
    s: Select = parse_select(sql)
    if isinstance(layers, DataFrame):
        df = layers
    else:
        found = {k.lower(): v for k, v in layers.items()}
        if s.source and opener:
            found[s.table.lower()] = opener(s.source)
        if s.table.lower() not in found:
            raise SqlError(f"unknown table {s.table}")
        df = found[s.table.lower()]
    c = Compiler(df.schema, s.table, s.alias)
    if fid is not None and "fid" not in c.fields:
        c.fields["fid"] = df.schema[fid]
    if s.where is not None:
        df = df.filter(c.truth(s.where))
    aggregates = [has_aggregate(n) for n, _ in s.items]
    if any(aggregates):
        if not all(aggregates):
            raise SqlError("fields and aggregates can't be mixed")
        return df.agg(*[c.bind(n).col.alias(a or default_name(n, k)) for k, (n, a) in enumerate(s.items)])
    if s.distinct:
        if len(s.items) != 1 or s.items[0][0].op == "star":
            raise SqlError("DISTINCT wants one field")
        n, a = s.items[0]
        return df.select(c.bind(n).col.alias(a or default_name(n, 0))).distinct()
    if s.order:
        keys = [c.column(None, name).col for name, _ in s.order]
        keys = [k.desc_nulls_last() if down else k.asc_nulls_first() for k, (_, down) in zip(keys, s.order, strict=True)]
        df = df.orderBy(*keys, *([F.col(fid)] if fid else []))
    if s.offset:
        df = df.offset(s.offset)
    if s.limit is not None:
        df = df.limit(s.limit)
    cols: list[Column] = []
    for k, (n, a) in enumerate(s.items):
        cols += [F.col(f"`{f}`") for f in df.columns] if n.op == "star" else [c.bind(n).col.alias(a or default_name(n, k))]
    return df.select(*cols)
