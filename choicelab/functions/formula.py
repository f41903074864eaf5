"""Model formulas as terms: ``v ~ 0 + x * C(f, Treatment('P')) + x:y``.

``0 +`` leaves out the intercept, ``a:b`` is a product, ``a * b`` is ``a + b + a:b``
and parentheses group. Terms come in order of their number of factors, repeated ones once.
"""

from __future__ import annotations

import re

from choicelab.functions.design import Factor, Term

_TOKEN = re.compile(r"\s*(?:C\(\s*(?P<factor>\w+)\s*(?:,\s*Treatment\(\s*'(?P<level>[^']*)'\s*\)\s*)?\)|(?P<name>[A-Za-z_]\w*)|(?P<sign>[01+*:()]))")


def _tokens(text: str, levels: dict[str, tuple[str, ...]]) -> list:
    """Signs as text, regressors as one-part terms."""
    found, at = [], 0
    text = text.strip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise ValueError(f"formula not understood at {text[at:]!r}")
        if match["sign"]:
            found.append(match["sign"])
        elif match["name"]:
            found.append((match["name"],))
        else:
            found.append((Factor(match["factor"], tuple(sorted(levels[match["factor"]])), match["level"]),))
        at = match.end()
    return found


def _product(left: list[Term], right: list[Term]) -> list[Term]:
    return [tuple(dict.fromkeys((*a, *b))) for a in left for b in right]


def _sum(tokens: list) -> list[Term]:
    """Consume a sum up to its closing parenthesis or the end."""
    terms = _crossed(tokens)
    while tokens and tokens[0] == "+":
        tokens.pop(0)
        terms = terms + _crossed(tokens)
    return terms


def _crossed(tokens: list) -> list[Term]:
    terms = _joined(tokens)
    while tokens and tokens[0] == "*":
        tokens.pop(0)
        other = _joined(tokens)
        terms = terms + other + _product(terms, other)
    return terms


def _joined(tokens: list) -> list[Term]:
    terms = _single(tokens)
    while tokens and tokens[0] == ":":
        tokens.pop(0)
        terms = _product(terms, _single(tokens))
    return terms


def _single(tokens: list) -> list[Term]:
    if not tokens:
        raise ValueError("formula ends early")
    token = tokens.pop(0)
    if token == "(":
        terms = _sum(tokens)
        if not tokens or tokens.pop(0) != ")":
            raise ValueError("formula lacks a closing parenthesis")
        return terms
    if isinstance(token, str):
        raise ValueError(f"formula has {token!r} where a regressor belongs")
    return [token]


def parse_formula(text: str, levels: dict[str, tuple[str, ...]]) -> tuple[str, bool, list[Term]]:
    """Response, intercept and terms. ``levels`` lists the levels of every ``C(...)``."""
    response, _, right = text.partition("~")
    tokens = _tokens(right, levels)
    intercept = True
    if tokens and tokens[0] in ("0", "1"):
        intercept = tokens.pop(0) == "1"
        if tokens and tokens.pop(0) != "+":
            raise ValueError("formula lacks a + after its intercept")
    terms = _sum(tokens) if tokens else []
    if tokens:
        raise ValueError(f"formula not understood at {tokens[0]!r}")
    return response.strip(), intercept, sorted(dict.fromkeys(terms), key=len)
