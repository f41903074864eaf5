"""Design-matrix columns for model terms.

A term is a tuple of regressors; a regressor is the name of a numeric column or
a ``Factor``. ``crossed(a, b)`` is every main effect and product of its
arguments. Factors are coded the way R and its descendants do: full dummies when
nothing in the model spans them yet, treatment contrasts otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain, combinations, product

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Factor:
    """A categorical column; ``levels`` are sorted, ``reference`` is the left-out level."""

    name: str
    levels: tuple[str, ...]
    reference: str | None = None

    @property
    def label(self) -> str:
        return f"C({self.name})" if self.reference is None else f"C({self.name}, Treatment('{self.reference}'))"

    def contrasts(self) -> tuple[str, ...]:
        base = self.levels[0] if self.reference is None else self.reference
        return tuple(level for level in self.levels if level != base)


Term = tuple  # of str | Factor


def crossed(*parts) -> list[Term]:
    """``a * b * c``: all main effects, then all products, shorter ones first."""
    return [tuple(chain.from_iterable(_flat(p) for p in pick))
            for size in range(1, len(parts) + 1) for pick in combinations(parts, size)]


def _flat(part) -> tuple:
    return part if isinstance(part, tuple) else (part,)


def term_text(term: Term) -> str:
    return ":".join(r.label if isinstance(r, Factor) else r for r in term)


def _subsets(factors: tuple) -> Iterable[frozenset]:
    return (frozenset(s) for n in range(len(factors) + 1) for s in combinations(factors, n))


def _codings(factors: tuple, spanned: set[frozenset]) -> list[dict[Factor, bool]]:
    """Codings of a factor product as {factor: full?}, covering the part not yet spanned.

    The product of full dummies is the sum of all products of contrasts over
    subsets of its factors. Subsets already in the model are left out, and two
    pieces that differ in one factor merge into one with full dummies.
    """
    pieces = [{f: False for f in factors if f in s} for s in _subsets(factors) if s not in spanned]
    merged = True
    while merged:
        merged = False
        for small, large in product(pieces, pieces):
            extra = [f for f in large if f not in small]
            same = all(large.get(f) == full for f, full in small.items())
            if len(large) == len(small) + 1 and len(extra) == 1 and same and not large[extra[0]]:
                joined = {f: True if f == extra[0] else large[f] for f in factors if f in large}
                pieces = [joined if p is large else p for p in pieces if p is not small]
                merged = True
                break
    return pieces


def design_cells(terms: list[Term], intercept: bool = True) -> dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...]]]:
    """Name -> (numeric columns, (factor column, level) pairs) whose product is a column of the design, in term order."""
    out: dict[str, tuple] = {"Intercept": ((), ())} if intercept else {}
    spanned: dict[frozenset, set[frozenset]] = {frozenset(): {frozenset()} if intercept else set()}
    for term in dict.fromkeys(terms):
        numbers = tuple(r for r in term if not isinstance(r, Factor))
        factors = tuple(r for r in term if isinstance(r, Factor))
        done = spanned.setdefault(frozenset(numbers), set())
        for coding in _codings(factors, done):
            choices = [[(f, level, full) for level in (f.levels if full else f.contrasts())]
                       for f, full in coding.items()]
            for pick in product(*choices):
                labels = {f: f"{f.label}[{level}]" if full else f"{f.label}[T.{level}]" for f, level, full in pick}
                shown = [r if not isinstance(r, Factor) else labels[r] for r in term
                         if not isinstance(r, Factor) or r in labels]
                out[":".join(shown) or "Intercept"] = (numbers, tuple((f.name, level) for f, level, _ in pick))
        done.update(_subsets(factors))
    return out


def design_columns(terms: list[Term], intercept: bool = True) -> dict[str, Column]:
    """Name -> column expression of the design matrix, in term order."""
    out = {}
    for name, (numbers, levels) in design_cells(terms, intercept).items():
        value = F.lit(1.0)
        for n in numbers:
            value = value * F.col(f"`{n}`").cast("double")
        for f, level in levels:
            value = value * F.when(F.col(f"`{f}`") == level, 1.0).when(F.col(f"`{f}`").isNotNull(), 0.0)
        out[name] = value
    return out
