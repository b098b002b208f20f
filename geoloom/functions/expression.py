"""Infix pixel expressions as columns: `(a - b) / (a + b)`, comparisons, `x ? y : z` as if(x, y, z), and functions."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixel import ieee_div

FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "exp": F.exp, "ln": F.log, "log": F.log, "log10": F.log10, "log2": F.log2,
    "sqrt": F.sqrt, "abs": F.abs, "sign": F.signum, "rint": F.rint, "floor": F.floor, "ceil": F.ceil, "pow": F.pow, "min": F.least, "max": F.greatest,
    "sum": lambda *x: sum(x[1:], x[0]), "avg": lambda *x: sum(x[1:], x[0]) / len(x), "if": lambda c, a, b: F.when(c, a).otherwise(b),
}
COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: ieee_div, ast.Pow: F.pow, ast.Mod: lambda a, b: a % b}


def expression(text: str, names: dict[str, Column]) -> Column:
    """The column of an expression over named columns; only arithmetic, comparisons and known functions are read."""
    text = text.replace("^", "**").replace("&&", " and ").replace("||", " or ").replace("if(", "iff(")

    def build(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return build(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name) and n.id in names:
            return names[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in BINARY:
            return BINARY[type(n.op)](build(n.left), build(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub | ast.UAdd | ast.Not):
            x = build(n.operand)
            return -x if isinstance(n.op, ast.USub) else ~x if isinstance(n.op, ast.Not) else x
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in COMPARE:
            return COMPARE[type(n.ops[0])](build(n.left), build(n.comparators[0]))
        if isinstance(n, ast.BoolOp):
            out = build(n.values[0])
            for v in n.values[1:]:
                out = out & build(v) if isinstance(n.op, ast.And) else out | build(v)
            return out
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            fn = FUNCTIONS.get("if" if n.func.id == "iff" else n.func.id)
            if fn is not None:
                return fn(*[build(a) for a in n.args])
        raise ValueError(f"can't read {ast.unparse(n)!r}")

    return build(ast.parse(text, mode="eval"))
