"""Grouped statistics. Every aggregate combines map-side; joins back go through
``attach`` so that a hot key never gathers in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicelab.operators.joins import attach
from choicelab.operators.ranking import col, exact_quantiles, present, row_index


def mean_by(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*map(col, keys)).agg(F.avg(col(value)).alias(out or value))


def heatmap(df: DataFrame, row: str, column: str, value: str, levels: list, prefix: str = "") -> DataFrame:
    """Mean of ``value`` as a matrix with one column per level."""
    cells = [F.avg(F.when(col(column) == level, col(value))).alias(f"{prefix}{level}") for level in levels]
    return df.groupBy(col(row)).agg(*cells).orderBy(col(row))


def accept_sum(df: DataFrame, key: str, accepted: str = "accepted") -> DataFrame:
    return df.groupBy(col(key)).agg(F.coalesce(F.sum(col(accepted)), F.lit(0)).alias("accept_sum"))


def accept_rate(df: DataFrame, key: str, accepted: str = "accepted") -> DataFrame:
    return df.groupBy(col(key)).agg(F.avg(col(accepted)).alias("perc_accept"))


def exclude_subjects(df: DataFrame, n_trials: float | None = 125, share: float = 0.99, key: str = "participant",
                     accepted: str = "accepted", among: list | None = None) -> DataFrame:
    """Keep subjects whose number of accepted offers is below ``share * n_trials``.

    With ``n_trials=None`` the subject's own number of trials is used. A subject
    without answers counts as zero accepted. ``among`` limits the candidates.
    """
    sums = df.groupBy(col(key)).agg(F.coalesce(F.sum(col(accepted)), F.lit(0)).alias("_sum"),
                                    F.count(F.lit(1)).alias("_n"))
    bound = F.col("_n") * share if n_trials is None else F.lit(n_trials * share)
    kept = sums.filter(F.col("_sum") < bound).select(col(key))
    if among is not None:
        kept = kept.filter(col(key).isin(among))
    return attach(df, kept, [key], "left_semi")


def keep_subjects(df: DataFrame, max_rate: float = 0.95, key: str = "participant",
                  accepted: str = "accepted") -> DataFrame:
    """Keep subjects who accept at most ``max_rate`` of their offers."""
    kept = accept_rate(df, key, accepted).filter(F.col("perc_accept") <= max_rate).select(col(key))
    return attach(df, kept, [key], "left_semi")


def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("n"))


def count_distinct(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct non-null values per column as (column, n_unique)."""
    entries = [F.struct(F.lit(n).alias("column"), F.count_distinct(col(n)).alias("n_unique")) for n in names]
    return df.agg(F.array(*entries).alias("_e")).select(F.inline("_e"))


def describe(df: DataFrame, value: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """count, mean, std (ddof 1), min, exact quartiles, max of ``value`` per group; NaN is missing, a null group a group."""
    by = by or []
    df = df.select(*map(col, by), present(col(value)).alias(value))
    moments = df.groupBy(*map(col, by)).agg(
        F.count(col(value)).alias("count"), F.avg(col(value)).alias("mean"), F.stddev_samp(col(value)).alias("std"),
        F.min(col(value)).alias("min"), F.max(col(value)).alias("max"))
    quart = exact_quantiles(df, by, value, [0.25, 0.5, 0.75], "_q", ranges)
    if by:
        joined = attach(moments, quart, by)
    else:
        row = quart.first()
        literal = F.array(*[F.lit(q) for q in row["_q"]]) if row and row["_q"] else F.lit(None).cast("array<double>")
        joined = moments.withColumn("_q", literal)
    return joined.select(*map(col, by), "count", "mean", "std", "min",
                         F.try_element_at("_q", F.lit(1)).alias("q25"), F.try_element_at("_q", F.lit(2)).alias("q50"),
                         F.try_element_at("_q", F.lit(3)).alias("q75"), "max")


def histogram_by(df: DataFrame, key: str, value: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins between each group's own minimum and maximum.

    The last bin is closed. A group with a single value uses a width of one
    around it. Only non-empty bins are returned.
    """
    rows = df.select(col(key), col(value).alias("_x")).filter(F.col("_x").isNotNull())
    ends = rows.groupBy(col(key)).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    ends = ends.withColumns({"_lo": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
                             "_hi": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    binned = attach(rows, ends, [key]).select(
        col(key), F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    return value_counts(binned, [key, "bin"])


def rating_accuracy(df: DataFrame, rating: str, level: str, step: float = 20, by: list[str] | None = None) -> DataFrame:
    """Share of given ratings whose whole part times ``step`` equals the level."""
    given = df.filter(col(rating).isNotNull())
    hit = F.coalesce((col(rating).cast("int") * step == col(level)).cast("int"), F.lit(0))
    return given.groupBy(*map(col, by or [])).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Correlation per group; null where it is undefined (one pair or no variance)."""
    both = df.filter(col(x).isNotNull() & col(y).isNotNull())
    stats = both.groupBy(*map(col, by or [])).agg(F.count(F.lit(1)).alias("n"), _corr(col(x), col(y)).alias("r"))
    return stats


def _corr(x: Column, y: Column) -> Column:
    """Correlation over complete pairs. ``F.corr`` itself fails without variance under ANSI."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete correlations of all column pairs as (a, b, r).

    Each task reduces its rows to one line of sums per pair with matrix products
    over Arrow batches; the lines are then added up. Columns are centred on their
    mean first (one number per column), which keeps the sums accurate. Null where
    a pair has no variance.
    """
    first, second = np.triu_indices(len(cols))
    means = df.agg(*[F.avg(F.nanvl(col(c).cast("double"), F.lit(None))) for c in cols]).first()

    def sums(batches):
        total = np.zeros((6, len(first)))
        for frame in batches:
            x = frame.to_numpy(dtype=float)
            given = ~np.isnan(x)
            x, given = np.where(given, x, 0.0), given.astype(float)
            product, square = x.T @ given, (x * x).T @ given
            for line, m in enumerate((given.T @ given, product, product.T, square, square.T, x.T @ x)):
                total[line] += m[first, second]
        yield pd.DataFrame({"i": first, "j": second, **dict(zip(("n", "sx", "sy", "sxx", "syy", "sxy"), total))})

    centred = df.select(*[(col(c).cast("double") - F.lit(m)).alias(f"_c{i}") for i, (c, m) in enumerate(zip(cols, means))])
    lines = centred.mapInPandas(sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = lines.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    total = total.withColumn("n", F.nullif("n", F.lit(0.0)))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    varies = (vx > F.col("sxx") * 1e-12) & (vy > F.col("syy") * 1e-12)     # beyond rounding
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
                        F.when(varies, cov / F.sqrt(vx * vy)).alias("r"))


def label_encode(df: DataFrame, names: list[str], ranges: int | None = None) -> DataFrame:
    """Replace each column's values by 0..n-1 in sorted order; null stays null."""
    out = df
    for name in names:
        values = df.select(col(name)).filter(col(name).isNotNull()).distinct()
        codes = row_index(values, [], [name], "_code", ranges)
        codes = codes.withColumn("_code", (F.col("_code") - 1).cast("int"))
        out = attach(out, codes, [name]).drop(name).withColumnRenamed("_code", name)
    return out.select(*map(col, df.columns))


def rejection_stats(df: DataFrame, key: str = "participant", bad: str = "badtrial",
                    n_trials: float | None = 125) -> DataFrame:
    """Kept trials and percentage removed per subject."""
    kept = df.groupBy(col(key)).agg(F.sum((col(bad) == 0).cast("long")).alias("kept"),
                                    F.count(F.lit(1)).alias("_n"))
    planned = F.col("_n") if n_trials is None else F.lit(n_trials)
    removed = (planned - F.col("kept")) / planned * 100
    return kept.withColumn("perc_removed", removed).drop("_n")


def first_value_by(df: DataFrame, key: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The columns of each group's first row in ascending ``order``."""
    picked = F.min_by(F.struct(*map(col, cols)), F.struct(*map(col, order))).alias("_first")
    return df.groupBy(*map(col, key)).agg(picked).select(*map(col, key), "_first.*")


def sem_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard error (ddof 1) and count per group."""
    return df.groupBy(*map(col, keys)).agg(
        F.avg(col(value)).alias("mean"), (F.stddev_samp(col(value)) / F.sqrt(F.count(col(value)))).alias("sem"),
        F.count(col(value)).alias("n"))


def grand_average(df: DataFrame, subject: str, keys: list[str], value: str) -> DataFrame:
    """Unweighted mean of subject means; subjects without the cell are skipped."""
    per_subject = mean_by(df, [subject, *keys], value, "_mean")
    return per_subject.groupBy(*map(col, keys)).agg(F.avg("_mean").alias(value), F.count("_mean").alias("n_subjects"))


def qc_summary(subjects: DataFrame, parts: list[DataFrame], key: str = "participant") -> DataFrame:
    """One row per subject with the columns of every per-subject table."""
    out = subjects.select(col(key)).distinct()
    for part in parts:
        out = out.join(part, [key], "left")
    return out


def rank_models(df: DataFrame, metric: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """0-based rank by ascending metric. The table has one row per model."""
    window = Window.partitionBy(*map(col, by or [])).orderBy(col(metric).asc_nulls_last())
    return df.withColumn(out, F.row_number().over(window) - 1)
