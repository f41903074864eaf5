"""Column expressions: text to numbers, recoding, scaling, logistic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def to_number(c: Column) -> Column:
    """Text to double; anything that is not a number, and NaN, becomes null.

    The cast reads Java notation as well ("3d", "1f", "0x1p3"), which is text here.
    """
    text = F.rtrim(c.cast("string"))
    suffixed = F.right(text, F.lit(1)).isin("d", "D", "f", "F") & ~F.endswith(F.lower(text), F.lit("inf"))
    number = text.try_cast("double")
    return F.when(~suffixed & ~F.contains(F.lower(text), F.lit("x")) & ~F.isnan(number), number)


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def parse_prefixed_int(c: Column, prefix: str) -> Column:
    """``'m3'`` -> 3 for prefix ``m``; text without the prefix becomes null."""
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1).try_cast("int"))


def parse_level_strip(c: Column, letter: str = "m") -> Column:
    """Remove every ``letter`` and quote mark, then read an integer."""
    return F.replace(F.replace(c, F.lit(letter), F.lit("")), F.lit("'"), F.lit("")).try_cast("int")


def numbered_label(n: Column, stem: str = "trial_", width: int = 3) -> Column:
    """``7`` -> ``trial_007``; wider numbers are kept whole."""
    digits = n.cast("string")
    return F.concat(F.lit(stem), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def sanitize_name(c: Column) -> Column:
    """Make a parameter name safe for file systems."""
    flat = F.translate(c, ":([)]", "_____")
    return F.regexp_replace(flat, r"T\.(M|P|low)", "T_$1")


def recode(c: Column, codes: dict[str, int], strip: str = "") -> Column:
    """Code of a label after removing ``strip``; unknown labels become null."""
    if strip:
        c = F.replace(c, F.lit(strip), F.lit(""))
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c)


def reverse_score(c: Column, lo: int = 1, hi: int = 4) -> Column:
    """Mirror an item inside its scale; values outside are left alone."""
    return F.when(c.between(lo, hi), F.lit(lo + hi) - c).otherwise(c)


def flip_rt(rt: Column, response: Column) -> Column:
    """Negative reaction time on rejected trials."""
    return F.when(response == 0, -rt).otherwise(rt)


def unit_scale(c: Column, factor: float) -> Column:
    """Seconds to milliseconds (1e3), volts to microvolts (1e6), ..."""
    return c * F.lit(float(factor))


def inv_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))
