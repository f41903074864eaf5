"""Operators that relate a row to its group or to its neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.operators.aggregates import describe
from choicelab.operators.joins import attach
from choicelab.operators.ranking import col, exact_quantiles, previous_value, row_index


def zscore(df: DataFrame, cols: list[str], by: list[str], suffix: str = "_z") -> DataFrame:
    """Add (x - mean) / std with ddof 0 within groups; null where the group does not vary."""
    moments = []
    for i, c in enumerate(cols):
        moments += [F.avg(col(c)).alias(f"_m{i}"), F.stddev_pop(col(c)).alias(f"_s{i}")]
    stats = df.groupBy(*map(col, by)).agg(*moments)
    if by:
        joined = attach(df, stats, by)
        mean = lambda i: F.col(f"_m{i}")
        spread = lambda i: F.col(f"_s{i}")
    else:
        row = stats.first()
        joined = df
        mean = lambda i: F.lit(row[f"_m{i}"]).cast("double")
        spread = lambda i: F.lit(row[f"_s{i}"]).cast("double")
    out = {f"{c}{suffix}": F.when(spread(i) > 0, (col(c) - mean(i)) / spread(i)) for i, c in enumerate(cols)}
    return joined.withColumns(out).drop(*[f"_{k}{i}" for i in range(len(cols)) for k in "ms"])


def standardize_within(df: DataFrame, cols: list[str], subject: str) -> DataFrame:
    """Replace columns by their z-score within each subject."""
    scaled = zscore(df, cols, [subject], "_scaled").drop(*cols)
    return scaled.withColumnsRenamed({f"{c}_scaled": c for c in cols}).select(*map(col, df.columns))


def event_gaps(df: DataFrame, recording: list[str], time: str, order: list[str] | None = None,
               out: str = "diff", ranges: int | None = None) -> DataFrame:
    """Time since the previous event of the recording; 0 for the first."""
    earlier = previous_value(df, recording, order or [time], time, "_before", ranges)
    return earlier.withColumn(out, F.coalesce(col(time) - F.col("_before"), F.lit(0))).drop("_before")


def cooldown_gap(df: DataFrame, by: list[str], order: list[str], onset: str, before: str,
                 out: str = "cooldown", ranges: int | None = None) -> DataFrame:
    """Onset minus the previous row's ``before``; the first row subtracts 0.

    One closing row per group holds 0 minus the group's last ``before``.
    """
    packed = df.withColumn("_packed", F.struct(col(before).alias("before")))
    opened = previous_value(packed, by, order, "_packed", "_prior", ranges)
    earlier = F.when(F.col("_prior").isNull(), F.lit(0.0)).otherwise(F.col("_prior.before"))
    opened = opened.select(*map(col, by), *map(col, order), (col(onset) - earlier).alias(out))
    last = df.groupBy(*map(col, by)).agg(F.max_by(col(before), F.struct(*map(col, order))).alias("_last"))
    kinds = dict(df.dtypes)
    closing = last.select(*map(col, by), *[F.lit(None).cast(kinds[o]).alias(o) for o in order],
                          (F.lit(0.0) - F.col("_last")).alias(out))
    return opened.unionByName(closing)


def trial_number(df: DataFrame, by: list[str], order: list[str], out: str = "trialsnum",
                 ranges: int | None = None) -> DataFrame:
    """1..n per subject in an explicit order."""
    return row_index(df, by, order, out, ranges)


def block_trial_index(df: DataFrame, by: list[str], order: list[str], n_per_block: int = 25,
                      ranges: int | None = None) -> DataFrame:
    """Position in the session as (block, trial within block), both from 0."""
    placed = row_index(df, by, order, "_place", ranges)
    place = F.col("_place") - 1
    return placed.withColumns({"blocks_idx": F.floor(place / n_per_block).cast("int"),
                               "trialblocks": (place % n_per_block).cast("int")}).drop("_place")


def _bin_of(value: Column, edges: list[Column]) -> Column:
    """0-based right-closed bin: the number of inner edges strictly below the value."""
    below = sum(((value > edge).cast("int") for edge in edges), F.lit(0))
    return F.when(value.isNotNull(), below)


def quantile_bins(df: DataFrame, value: str, n: int, by: list[str] | None = None, out: str = "bin",
                  ranges: int | None = None) -> DataFrame:
    """Bins between interpolated quantiles; edges are right-closed, the lowest is included.

    Where ties make neighbouring edges equal, the bins between them stay empty.
    """
    by = by or []
    inner = [i / n for i in range(1, n)]
    edges = exact_quantiles(df, by, value, inner, "_edges", ranges)
    if by:
        joined = attach(df, edges, by)
        places = [F.try_element_at("_edges", F.lit(i + 1)) for i in range(len(inner))]
        return joined.withColumn(out, _bin_of(col(value), places)).drop("_edges")
    row = edges.first()
    return df.withColumn(out, _bin_of(col(value), [F.lit(e) for e in (row["_edges"] or [])]))


def bin_table(df: DataFrame, value: str, n: int, ranges: int | None = None) -> DataFrame:
    """Edges and row count of every quantile bin."""
    all_edges = exact_quantiles(df, [], value, [i / n for i in range(n + 1)], "_edges", ranges).first()["_edges"]
    binned = df.withColumn("bin", _bin_of(col(value), [F.lit(e) for e in all_edges[1:-1]]))
    counts = binned.filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edge = F.array(*[F.lit(e) for e in all_edges])
    return counts.withColumns({"lower": F.element_at(edge, F.col("bin") + 1),
                               "upper": F.element_at(edge, F.col("bin") + 2)})


def timing_error(gaps: DataFrame, durations: DataFrame, by: list[str], gap: str, gap_order: list[str],
                 duration: str, duration_order: list[str], ranges: int | None = None) -> DataFrame:
    """Event gap minus logged duration, matched by rank within ``by``.

    Both sides carry an explicit order. Rows without a partner give a null error.
    """
    def ranked(side: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
        narrow = side.select(*map(col, by), *[col(o).alias(f"_o{i}") for i, o in enumerate(order)], col(value).alias(name))
        return row_index(narrow, by, [f"_o{i}" for i in range(len(order))], "n", ranges).select(*map(col, by), "n", name)

    left, right = ranked(gaps, gap_order, gap, "_gap"), ranked(durations, duration_order, duration, "_duration")
    both = left.join(right, [*by, "n"], "full_outer")
    return both.select(*map(col, by), "n", (F.col("_gap") - F.col("_duration")).alias("error"))


def timing_summary(errors: DataFrame, by: list[str]) -> DataFrame:
    return describe(errors, "error", by)
