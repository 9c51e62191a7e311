"""Are two answers the same? Closed forms, numbers within a tolerance, choices, and evidence for an answer."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .code import parse


def number(text: Column) -> Column:
    """The first number of a text, without thousands marks; a percent sign divides by 100."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    value = F.regexp_extract(plain, r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*(%?)", 1).try_cast("double")
    percent = F.regexp_extract(plain, r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*(%?)", 2) == "%"
    return F.when(percent, value / 100).otherwise(value)


def close(said: Column, truth: Column, share: float = 0.03) -> Column:
    """Strictly within a share of the truth, on either side of zero; unreadable is wrong."""
    a, b = truth * (1 - share), truth * (1 + share)
    return F.coalesce((said > F.least(a, b)) & (said < F.greatest(a, b)), F.lit(False))


def same_choice(said: Column, truth: Column) -> Column:
    """The answer begins with the choice, whatever the case."""
    return F.coalesce(F.startswith(F.lower(F.trim(said)), F.lower(F.trim(truth))), F.lit(False))


def same_closed_form(said: Column, truth: Column, tolerance: float = 1e-6) -> Column:
    """Equal texts, or numbers that differ by less than the tolerance."""
    return F.coalesce(said == truth, F.lit(False)) | F.coalesce(F.abs(said.try_cast("double") - truth.try_cast("double")) < tolerance, F.lit(False))


def _literals(code: str | None) -> set[str]:
    return {str(n.value) for n in ast.walk(parse(code) or ast.Module([], [])) if isinstance(n, ast.Constant)}


@F.pandas_udf(T.StringType())
def evidence(answer: pd.Series, code: pd.Series, printed: pd.Series) -> pd.Series:
    """Where an answer comes from: `printed` by the program, a `literal` in it, or `none`."""

    def one(a, c, p):
        if a is None:
            return None
        if any(a == line.strip() for line in (p or "").split("\n")):
            return "printed"
        return "literal" if a in _literals(c) else "none"

    return pd.Series([one(*x) for x in zip(answer, code, printed)], dtype=object)


class _Keep(ast.NodeTransformer):
    def __init__(self, name: str, instead: str):
        self.name, self.instead, self.changed = name, instead, 0

    def visit_Name(self, node):
        if node.id == self.name and isinstance(node.ctx, (ast.Store, ast.Del)):
            self.changed += 1
            return ast.copy_location(ast.Name(self.instead, node.ctx), node)
        return node

    def visit_FunctionDef(self, node):
        self.generic_visit(node)
        if node.name == self.name:
            self.changed += 1
            node.name = self.instead
        return node


def protected(code: str, name: str = "final_answer") -> tuple[str, int]:
    """The program with its own definitions of a provided function renamed, so that calls still reach the provided one; how many were."""
    tree = parse(code)
    if tree is None:
        return code, 0
    keep = _Keep(name, f"_own_{name}")
    tree = keep.visit(tree)
    return (ast.unparse(ast.fix_missing_locations(tree)), keep.changed) if keep.changed else (code, 0)
