"""Subjective value of pain, net value and acceptance probability.

Signs: ``net_value`` is pain value minus money for every form, so a positive
net value speaks against accepting and ``accept_probability`` falls with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale of the pain term and of the net value inside the logit.
PAIN_SCALE = 0.1
NET_SCALE = 0.01


def _scaled(k: Column, pain: Column) -> Column:
    return k * pain * F.lit(PAIN_SCALE)


FORMS: dict[str, Callable[[Column, Column], Column]] = {
    "none": lambda k, pain: pain * F.lit(PAIN_SCALE),
    "linear": _scaled,
    "para": lambda k, pain: _scaled(k, pain * pain),
    "cubic": lambda k, pain: _scaled(k, pain * pain * pain),
    "hyper": lambda k, pain: F.try_divide(F.lit(PAIN_SCALE), 1 - k * pain),
    "expo": lambda k, pain: F.exp(_scaled(k, pain)),
    "root": lambda k, pain: F.when(k * pain >= 0, F.sqrt(_scaled(k, pain))),
    "logarithmic": lambda k, pain: F.when(k * pain > 0, F.ln(_scaled(k, pain))),
}


def register_form(name: str, build: Callable[[Column, Column], Column]) -> None:
    """Make a user-defined value function available by name."""
    FORMS[name] = build


def sv_pain(k: Column, pain: Column, form: str) -> Column:
    return FORMS[form](k, pain)


def sv_pain_by_name(k: Column, pain: Column, form: Column, forms: list[str]) -> Column:
    """Pain value where the form differs from row to row."""
    picked = F.lit(None).cast("double")
    for name in reversed(forms):
        picked = F.when(form == name, FORMS[name](k, pain)).otherwise(picked)
    return picked


def net_value(pain_value: Column, money: Column) -> Column:
    return pain_value - money


def stored_value(k: Column, pain: Column, form: str) -> Column:
    """Pain value as it is stored and compared with money: form ``none`` keeps the raw level."""
    return pain.cast("double") if form == "none" else sv_pain(k, pain, form)


def stored_value_by_name(k: Column, pain: Column, form: Column, forms: list[str]) -> Column:
    scaled = sv_pain_by_name(k, pain, form, [f for f in forms if f != "none"])
    return F.when(form == "none", pain.cast("double")).otherwise(scaled) if "none" in forms else scaled


def accept_logit(beta: Column, net: Column) -> Column:
    return -(beta * (net * F.lit(NET_SCALE)))


def accept_probability(beta: Column, net: Column) -> Column:
    return 1 / (1 + F.exp(beta * (net * F.lit(NET_SCALE))))


def bernoulli_loglik(accepted: Column, logit: Column) -> Column:
    """Log-likelihood of a choice, stable for logits of any size."""
    signed = F.when(accepted == 1, logit).otherwise(-logit)
    return F.least(signed, F.lit(0.0)) - F.log1p(F.exp(-F.abs(signed)))
