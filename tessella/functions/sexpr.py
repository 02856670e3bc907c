"""S-expressions as column expressions, e.g. ``( + ( * a x ) y )``."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.rowexpr import as_number, as_truth, bind

ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}
COMPARISONS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def tokenize(code: str) -> list[str]:
    return code.replace("(", " ( ").replace(")", " ) ").split()


def parse(code: str):
    """Nested lists of numbers and symbols; the text must hold one expression."""
    stack: list[list] = [[]]
    for token in tokenize(code):
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1:
                raise SyntaxError("unexpected )")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(atom(token))
    if len(stack) > 1 or not stack[0]:
        raise SyntaxError("unexpected end")
    if len(stack[0]) > 1:
        raise SyntaxError("more than one expression")
    return stack[0][0]


def atom(token: str) -> int | float | str:
    """A whole number, else a number, else a symbol."""
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            continue
    return token


def evaluate(tree, names: dict[str, Column]) -> Column:
    if isinstance(tree, (int, float)):
        return bind(tree)
    if isinstance(tree, str):
        if tree not in names:
            raise NameError(f"{tree} is not bound")
        return names[tree]
    if not tree or not isinstance(tree[0], str):
        raise ValueError("an operation must begin with its name")
    op, args = tree[0], tree[1:]

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{op} takes {what}")

    if op in ARITHMETIC or op in COMPARISONS:
        need(len(args) == 2, "two operands")
        a, b = (evaluate(x, names) for x in args)
        return ARITHMETIC[op](a, b) if op in ARITHMETIC else as_number(COMPARISONS[op](a, b))
    if op in ("and", "or"):
        need(len(args) >= 2, "two operands or more")
        parts = [as_truth(evaluate(x, names)) for x in args]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "and" else out | p
        return as_number(out)
    if op == "not":
        need(len(args) == 1, "one operand")
        return as_number(~as_truth(evaluate(args[0], names)))
    if op == "if":
        need(len(args) == 3, "three operands")
        test, a, b = (evaluate(x, names) for x in args)
        return F.when(as_truth(test), a).otherwise(b)
    if op == ":=":
        need(len(args) == 2 and isinstance(args[0], str), "a name and a value")
        names[args[0]] = evaluate(args[1], names)
        return names[args[0]]
    if op == "return":
        need(len(args) == 1, "one operand")
        return evaluate(args[0], names)
    if op == "begin":
        need(len(args) >= 1, "one operand or more")
        for x in args:
            value = evaluate(x, names)
            if isinstance(x, list) and x and x[0] == "return":
                break
        return value
    raise ValueError(f"unknown operation {op}")


def sexpr(code: str, **names) -> Column:
    """The column of an s-expression over named columns and numbers."""
    return evaluate(parse(code), {k: bind(v) for k, v in names.items()})
