"""Quantity formulas written by users, compiled to Spark columns.

A formula is arithmetic over named variables with ceil, floor, sqrt, abs and
round (ties to even). Anything that fails - a syntax error, an unknown name, a
division by zero, a missing value, a result beyond all numbers - makes the whole
formula 0.0. Formulas are
configuration: the distinct ones are compiled on the driver behind a check of
their number, and the rows never leave the executors.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FORMULAS = 100_000
CHOICES = 200


class FormulaError(ValueError):
    pass


def _double(c: Column) -> Column:
    return c.cast("double")


def _unless_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


WHOLE_FROM = 2.0**53  # doubles from here on are whole already

_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / _unless_zero(b),
    ast.FloorDiv: lambda a, b: _double(F.floor(a / _unless_zero(b))),
    ast.Mod: lambda a, b: a - b * _double(F.floor(a / _unless_zero(b))),
    ast.Pow: lambda a, b: F.pow(a, b),
}

_CALLS = {
    "ceil": lambda a: F.when(F.abs(a) < WHOLE_FROM, _double(F.ceil(a))).otherwise(a),
    "floor": lambda a: F.when(F.abs(a) < WHOLE_FROM, _double(F.floor(a))).otherwise(a),
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "abs": F.abs,
    "round": lambda a: _double(F.bround(a, 0)),
}


def names_in(formula: str) -> set[str]:
    """Variable names a formula refers to; empty when it does not parse."""
    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except (SyntaxError, ValueError):
        return set()
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called


def _build(node: ast.AST, variables: Mapping[str, Column]) -> Column:
    match node:
        case ast.Expression():
            return _build(node.body, variables)
        case ast.Constant(value=bool() | str() | bytes() | None):
            raise FormulaError("only numbers are allowed")
        case ast.Constant(value=int() | float() as number):
            return F.lit(float(number))
        case ast.Name(id=name) if name in variables:
            return _double(variables[name])
        case ast.UnaryOp(op=ast.USub(), operand=operand):
            return -_build(operand, variables)
        case ast.UnaryOp(op=ast.UAdd(), operand=operand):
            return _build(operand, variables)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            return _BINARY[type(op)](_build(left, variables), _build(right, variables))
        case ast.Call(func=ast.Name(id="round"), args=[arg, ast.Constant(value=int() as digits)], keywords=[]):
            return _double(F.bround(_build(arg, variables), digits))
        case ast.Call(func=ast.Name(id=name), args=[arg], keywords=[]) if name in _CALLS:
            return _CALLS[name](_build(arg, variables))
    raise FormulaError(f"not allowed here: {ast.dump(node)}")


def compile_formula(formula: str, variables: Mapping[str, Column]) -> Column:
    """The formula as a double column that is never null."""
    text = (formula or "").strip()
    try:
        return F.lit(float(text))
    except ValueError:
        pass
    try:
        value = _build(ast.parse(text, mode="eval"), variables)
    except (FormulaError, SyntaxError, ValueError, RecursionError):
        return F.lit(0.0)
    return F.coalesce(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value), F.lit(0.0))


def distinct_formulas(table: DataFrame, column: str, limit: int = MAX_FORMULAS) -> list[str]:
    """The different formulas of a rule table, refused beyond `limit`."""
    rows = table.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} different formulas; split the rule set")
    return sorted(r[0] for r in rows)


def evaluate(formula: Column, formulas: Sequence[str], variables: Mapping[str, Column]) -> Column:
    """Value of the formula each row names, out of the given formulas."""
    # flat choices of bounded length, one beside the other: nothing is nested in what came before
    choices = []
    for i in range(0, len(formulas), CHOICES):
        chosen = None
        for text in formulas[i : i + CHOICES]:
            value = compile_formula(text, variables)
            chosen = F.when(formula == F.lit(text), value) if chosen is None else chosen.when(formula == F.lit(text), value)
        choices.append(chosen)
    return F.coalesce(*choices, F.lit(0.0))


def chain_levels(definitions: Mapping[str, str]) -> tuple[list[list[str]], list[str]]:
    """Group named formulas so that each level needs only earlier ones.

    The second result lists the names on or behind a cycle.
    """
    needs = {n: names_in(f) & definitions.keys() for n, f in definitions.items()}
    levels: list[list[str]] = []
    done: set[str] = set()
    while True:
        ready = sorted(n for n, d in needs.items() if n not in done and d <= done)
        if not ready:
            return levels, sorted(needs.keys() - done)
        levels.append(ready)
        done.update(ready)


def with_chained(df: DataFrame, definitions: Mapping[str, str], variables: Sequence[str]) -> DataFrame:
    """Add one column per named formula; formulas may refer to each other.

    A formula in a cycle yields 0.0 and is named in `formula_errors`.
    """
    levels, cyclic = chain_levels(definitions)
    known = {v: F.col(v) for v in variables}
    for level in levels:
        df = df.withColumns({n: compile_formula(definitions[n], known) for n in level})
        known.update({n: F.col(n) for n in level})
    errors = F.array(*[F.lit(n) for n in cyclic]) if cyclic else F.array().cast("array<string>")
    return df.withColumns({**{n: F.lit(0.0) for n in cyclic}, "formula_errors": errors})
