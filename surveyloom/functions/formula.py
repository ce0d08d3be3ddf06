"""A small formula language compiled to a Column: arithmetic, aggregates of arrays, ROUND."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(.))")


class FormulaError(ValueError):
    """A formula that cannot be compiled."""


def _array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.lit(1), F.size(x))


_FUNCTIONS = {
    "AVG": _array_mean,
    "SUM": lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v),
    "COUNT": lambda x: F.size(x).cast("double"),
    "MIN": F.array_min,
    "MAX": F.array_max,
}


def compile_formula(text: str, variables: dict[str, Column], arrays: frozenset[str] = frozenset()) -> Column:
    """Compile ``text`` over named columns; those in ``arrays`` hold arrays of doubles.

    An array outside a function stands for its mean.  Division by zero is an error when the
    query runs; unknown names, and anything left over, are errors here.
    """
    tokens = [m.groups() for m in _TOKEN.finditer(text) if m.group().strip()]
    at = 0

    def peek() -> str | None:
        return None if at >= len(tokens) else next(x for x in tokens[at] if x is not None)

    def take(want: str | None = None) -> str:
        nonlocal at
        got = peek()
        if got is None or (want is not None and got != want):
            raise FormulaError(f"expected {want or 'a value'}, got {got or 'the end'} in {text!r}")
        at += 1
        return got

    def lookup(name: str) -> Column:
        if name not in variables:
            raise FormulaError(f"unknown name {name!r}")
        return variables[name]

    def factor() -> Column:
        got = take()
        if got == "-":
            return -factor()
        if got == "(":
            inner = total()
            take(")")
            return inner
        if got[0].isdigit():
            return F.lit(float(got))
        if not (got[0].isalpha() or got[0] == "_"):
            raise FormulaError(f"unexpected {got!r}")
        name = got.upper()
        if peek() == "(" and (name in _FUNCTIONS or name == "ROUND"):
            take("(")
            if name in _FUNCTIONS and peek() in arrays:
                value = _FUNCTIONS[name](lookup(take()))
            else:
                inner = total()
                value = F.round(inner, 0) if name == "ROUND" else F.lit(1.0) if name == "COUNT" else inner
            take(")")
            return value
        return _array_mean(lookup(got)) if got in arrays else lookup(got)

    def product() -> Column:
        left = factor()
        while peek() in ("*", "/"):
            if take() == "*":
                left = left * factor()
            else:
                right = factor()
                left = left / F.when(right == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(right)
        return left

    def total() -> Column:
        left = product()
        while peek() in ("+", "-"):
            left = left + product() if take() == "+" else left - product()
        return left

    out = total()
    if peek() is not None:
        raise FormulaError(f"unexpected {peek()!r} in {text!r}")
    return out
