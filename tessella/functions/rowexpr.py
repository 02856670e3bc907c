"""Plain Python functions as column expressions.

The body of a function is read once and becomes one Catalyst expression, so
that no Python worker runs and the expression takes part in code generation.
Comparisons and logic give whole numbers 0 and 1.
"""

from __future__ import annotations

import ast
import inspect
import operator
import textwrap
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}
COMPARISONS = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def as_number(truth: Column) -> Column:
    return truth.cast("long")


def as_truth(value: Column) -> Column:
    return value != 0


class Compiler(ast.NodeVisitor):
    """Turns the nodes of one function into Columns; anything it has no method for is a SyntaxError."""

    def __init__(self, bound: dict[str, Column]):
        self.names = dict(bound)

    def generic_visit(self, node: ast.AST):
        raise SyntaxError(f"{type(node).__name__} has no column expression (line {getattr(node, 'lineno', '?')})")

    def body(self, statements: list[ast.stmt]) -> Column:
        """The value of the first return, else of the last expression."""
        value = None
        for s in statements:
            if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
                continue  # a docstring
            value = self.visit(s)
            if isinstance(s, ast.Return):
                return value
        if value is None:
            raise SyntaxError("the function has no value")
        return value

    def visit_Return(self, node: ast.Return) -> Column:
        if node.value is None:
            raise SyntaxError("return without a value")
        return self.visit(node.value)

    def visit_Expr(self, node: ast.Expr) -> Column:
        return self.visit(node.value)

    def visit_BinOp(self, node: ast.BinOp) -> Column:
        op = ARITHMETIC.get(type(node.op)) or self.generic_visit(node.op)
        return op(self.visit(node.left), self.visit(node.right))

    def visit_Compare(self, node: ast.Compare) -> Column:
        if len(node.ops) != 1:
            raise SyntaxError("one comparison at a time")
        op = COMPARISONS.get(type(node.ops[0])) or self.generic_visit(node.ops[0])
        return as_number(op(self.visit(node.left), self.visit(node.comparators[0])))

    def visit_BoolOp(self, node: ast.BoolOp) -> Column:
        parts = [as_truth(self.visit(v)) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return as_number(out)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Column:
        if isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return F.lit(-node.operand.value)
        if not isinstance(node.op, ast.Not):
            self.generic_visit(node.op)
        return as_number(~as_truth(self.visit(node.operand)))

    def visit_IfExp(self, node: ast.IfExp) -> Column:
        return F.when(as_truth(self.visit(node.test)), self.visit(node.body)).otherwise(self.visit(node.orelse))

    def visit_NamedExpr(self, node: ast.NamedExpr) -> Column:
        self.names[node.target.id] = self.visit(node.value)
        return self.names[node.target.id]

    def visit_Constant(self, node: ast.Constant) -> Column:
        if isinstance(node.value, bool):
            return F.lit(int(node.value)).cast("long")
        if isinstance(node.value, int):
            return F.lit(node.value).cast("long")
        if isinstance(node.value, float):
            return F.lit(node.value)
        raise SyntaxError(f"{node.value!r} is no number")

    def visit_Name(self, node: ast.Name) -> Column:
        if node.id not in self.names:
            raise NameError(f"{node.id} is not bound")
        return self.names[node.id]


def bind(value) -> Column:
    """A column stays one, a string names one, a number is a constant."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    if isinstance(value, (bool, int)):
        return F.lit(int(value)).cast("long")
    if isinstance(value, float):
        return F.lit(value)
    raise TypeError(f"{type(value).__name__} can't be an argument")


def row_expr(fn: Callable) -> Callable[..., Column]:
    """Decorator: calling the function with columns, column names and numbers gives a Column."""
    tree = ast.parse(textwrap.dedent(inspect.getsource(fn)))
    node = next(n for n in tree.body if isinstance(n, ast.FunctionDef))
    spec = node.args
    if spec.vararg or spec.kwarg or spec.kwonlyargs or spec.posonlyargs or spec.defaults:
        raise SyntaxError("plain parameters only")
    names = [a.arg for a in spec.args]

    def call(*args, **kwargs) -> Column:
        given = dict(zip(names, args, strict=False)) | kwargs
        if len(args) > len(names) or set(given) != set(names):
            raise TypeError(f"{fn.__name__} takes {names}")
        return Compiler({k: bind(v) for k, v in given.items()}).body(node.body)

    call.__name__, call.__doc__ = fn.__name__, fn.__doc__
    call(**{n: F.lit(1).cast("long") for n in names}) if _active() else None  # errors show at definition where a session runs
    return call


def _active() -> bool:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() is not None
