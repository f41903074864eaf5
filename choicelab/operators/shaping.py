"""Projection, renaming, row selection and simple ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.functions import columns as fc
from choicelab.functions.conditions import CONDITIONS
from choicelab.operators.ranking import col


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*map(col, cols))


def alias_columns(df: DataFrame, copies: dict[str, str]) -> DataFrame:
    """Add copies of columns: ``{new: existing}``."""
    return df.withColumns({new: col(old) for new, old in copies.items()})


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: fc.to_number(col(c)) for c in cols})


def cast_int(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: fc.to_int(col(c)) for c in cols})


def columns_containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def drop_columns_containing(df: DataFrame, part: str) -> DataFrame:
    return project(df, [c for c in df.columns if part not in c])


def keep_existing(cols: list[str], df: DataFrame) -> list[str]:
    return [c for c in cols if c in df.columns]


def rename_by_lookup(df: DataFrame, names: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Rename columns through a lookup table; the new names are trimmed.

    Only entries for columns of ``df`` reach the driver, so the read is bounded
    by the width of the table.
    """
    entries = names.filter(col(old).isin(df.columns)).select(old, F.trim(col(new)).alias(new)).collect()
    return df.withColumnsRenamed({r[old]: r[new] for r in entries})


def add_intercept(df: DataFrame, value: float = 1, name: str = "Intercept") -> DataFrame:
    return df.withColumn(name, F.lit(value))


def add_conditions(df: DataFrame, money: str = "moneylevel", pain: str = "painlevel") -> DataFrame:
    """Add the five condition codes of an offer."""
    return df.withColumns({name: build(col(money), col(pain)) for name, build in CONDITIONS.items()})


def reverse_scores(df: DataFrame, cols: list[str], lo: int = 1, hi: int = 4) -> DataFrame:
    return df.withColumns({c: fc.reverse_score(col(c), lo, hi) for c in cols})


def row_sum(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """Sum across columns; nulls count as zero."""
    return df.withColumn(out, reduce(Column.__add__, [F.coalesce(col(c), F.lit(0)) for c in cols]))


def interaction_terms(df: DataFrame, base: str, others: dict[str, str]) -> DataFrame:
    """Add products with ``base``: ``{new: other}``."""
    return df.withColumns({new: col(other) * col(base) for new, other in others.items()})


def drop_incomplete(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows with a value in every column of ``subset`` (NaN counts as missing)."""
    return df.filter(reduce(Column.__and__, [_present(df, c) for c in subset]))


def _present(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return col(name).isNotNull() & ~F.isnan(col(name)) if kind in ("double", "float") else col(name).isNotNull()


def regressor_present(df: DataFrame, regressor: str) -> DataFrame:
    return drop_incomplete(df, [regressor])


def filter_in(df: DataFrame, name: str, values: list) -> DataFrame:
    return df.filter(col(name).isin(values))


def filter_eq(df: DataFrame, name: str, value) -> DataFrame:
    return df.filter(col(name) == F.lit(value))


def filter_notnull(df: DataFrame, name: str) -> DataFrame:
    return df.filter(col(name).isNotNull())


def drop_event_codes(df: DataFrame, codes: list[int], labels: list[str],
                     code: str = "code", label: str = "label") -> DataFrame:
    """Remove technical events by number or by name."""
    unwanted = F.coalesce(col(code).isin(codes), F.lit(False)) | F.coalesce(col(label).isin(labels), F.lit(False))
    return df.filter(~unwanted)


def drop_bad_trials(df: DataFrame, flag: str = "badtrial") -> DataFrame:
    return df.filter(col(flag) == 0)


def drop_channels(df: DataFrame, names: list, channel: str = "channel") -> DataFrame:
    return df.filter(~col(channel).isin(names))


def pick_channels(df: DataFrame, names: list, channel: str = "channel") -> DataFrame:
    return df.filter(col(channel).isin(names))


def rows_named(df: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Rows of a result table by name; absent names are simply not returned."""
    return df.filter(col(name).isin(wanted))


def distinct_sorted_ids(df: DataFrame, name: str) -> DataFrame:
    return df.select(col(name)).distinct().orderBy(col(name))


def order_by_index(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*map(col, keys))


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*map(col, order)).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows in ascending order of ``order``."""
    last = df.orderBy(*[col(c).desc() for c in order]).limit(n)
    return last.orderBy(*map(col, order))


def union_rows(*tables: DataFrame) -> DataFrame:
    """Append by column name; columns absent from one table become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
