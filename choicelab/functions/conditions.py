"""Condition codes of a (money, pain) offer. A null level gives a null code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Artefact classes that mark a signal component for removal.
ARTEFACT_LABELS = [
    "channel noise",
    "eye blink",
    "muscle artifact",
    "line noise",
    "heart beat",
    "eye movement",
    "other",
]


def acceptance_pair(money: Column, pain: Column) -> Column:
    """I when the levels are equal, M when money is higher, P when pain is."""
    return F.when(money == pain, "I").when(money > pain, "M").when(money < pain, "P")


def overall_value(money: Column, pain: Column, cut: float = 5) -> Column:
    return F.when(money + pain <= cut, "low_OV").when(money + pain > cut, "high_OV")


def absolute_value(money: Column, pain: Column, cut: float = 2) -> Column:
    gap = F.abs(money - pain)
    return F.when(gap < cut, "low_abs").when(gap > cut, "high_abs").when(gap == cut, "mid_abs")


def _stronger(money: Column, pain: Column) -> Column:
    return F.when(money > pain, "_h_money").when(money <= pain, "_h_pain")


def ov_money_pain(money: Column, pain: Column, cut: float = 5) -> Column:
    """Overall value crossed with the stronger side (ties count as pain)."""
    level = F.when(money + pain > cut, "h_OV").when(money + pain <= cut, "low_OV")
    return F.concat(level, _stronger(money, pain))


def abs_money_pain(money: Column, pain: Column, cut: float = 2) -> Column:
    """Absolute value crossed with the stronger side; the middle level is not split."""
    level = absolute_value(money, pain, cut)
    return F.when(level == "mid_abs", level).otherwise(F.concat(level, _stronger(money, pain)))


def flag_component(label: Column, prob: Column, cut: float = 0.70) -> Column:
    """True when a component is an artefact with enough certainty."""
    return label.isin(ARTEFACT_LABELS) & (prob > cut)


CONDITIONS = {
    "acceptance_pair": acceptance_pair,
    "OV_value": overall_value,
    "Abs_value": absolute_value,
    "OV_Money_Pain": ov_money_pain,
    "Abs_Money_Pain": abs_money_pain,
}
