"""Joins by key, by position, by interval and by nearest time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicelab.operators.ranking import col, row_index

def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join an aggregate back to the rows it describes, a null key being a key like any other.

    Nothing runs here: adaptive execution knows the aggregate's size by the time it
    joins, and then broadcasts it below the threshold or splits skewed partitions. For
    the latter the aggregate is dealt out anew, else the rows would have to follow its
    partitions.
    A semi or anti join keeps the usual meaning of null: no match.
    """
    table = table.hint("rebalance")
    if how in ("left_semi", "left_anti"):
        return df.join(table, on, how)
    renamed = table.withColumnsRenamed({k: f"_on_{k}" for k in on})
    same = [col(k).eqNullSafe(col(f"_on_{k}")) for k in on]
    return df.join(renamed, reduce(Column.__and__, same), how).drop(*[f"_on_{k}" for k in on])


def left_join(df: DataFrame, scores: DataFrame, on: list[str]) -> DataFrame:
    """Many-to-one join of a subject table, broadcast only where Spark finds it below its threshold."""
    return df.join(scores, on, "left")


def attach_subject_params(trials: DataFrame, params: DataFrame, key: str = "participant") -> DataFrame:
    """Write per-subject parameters to all of the subject's trials."""
    return left_join(trials, params, [key])


def match_trials(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of ``left`` whose keys occur in ``right``: ``{left column: right column}``."""
    wanted = right.select(*[col(r).alias(l) for l, r in keys.items()])
    return left.join(wanted, list(keys), "left_semi")


def zip_columns(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str],
                by: list[str] | None = None, suffix: str = "_2", ranges: int | None = None) -> DataFrame:
    """Put two tables side by side by rank in an explicit order.

    Shorter sides are padded with nulls. Columns of ``b`` whose name also occurs
    in ``a`` get ``suffix``. ``by`` restarts the ranks in every group.
    """
    by = by or []
    left = row_index(a, by, order_a, "_row", ranges)
    right = row_index(b, by, order_b, "_row", ranges)
    taken = set(a.columns) - set(by)
    right = right.withColumnsRenamed({c: c + suffix for c in b.columns if c in taken})
    return left.join(right, [*by, "_row"], "full_outer").drop("_row")


def compare_draws(draws: DataFrame, pairs: list[tuple[str, str]], param: str = "param",
                  on: tuple[str, ...] = ("chain", "draw"), value: str = "value") -> DataFrame:
    """Share of aligned draws in which the first parameter exceeds the second.

    One pass over the named parameters: the values of a draw are gathered by
    (chain, draw), so no parameter pair is joined separately.
    """
    names = sorted({n for pair in pairs for n in pair}, key=str)
    rows = draws.filter(col(param).isin(names))
    aligned = rows.groupBy(*map(col, on)).agg(
        *[F.max(F.when(col(param) == n, col(value))).alias(f"_p{i}") for i, n in enumerate(names)])
    place = {n: F.col(f"_p{i}") for i, n in enumerate(names)}
    wins = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"),
                     F.avg((place[a] > place[b]).cast("int")).alias("p_greater"),
                     F.count(place[a] + place[b]).alias("n_draws")) for a, b in pairs]
    return aligned.agg(F.array(*wins).alias("_w")).select(F.inline("_w"))


def epoch_join(samples: DataFrame, events: DataFrame, by: list[str], sample_time: str, event_time: str,
               lo: float, hi: float, bucket: float | None = None) -> DataFrame:
    """Samples within [event + lo, event + hi] of each event of the same recording.

    Events are copied to the time buckets their window touches (two or three at
    the default bucket width), so the join is an equality on (recording, bucket)
    and a long recording is spread over its buckets. Adds ``offset``.
    """
    width = float(bucket or max(hi - lo, 1e-9))
    start, end = col(event_time) + F.lit(lo), col(event_time) + F.lit(hi)
    placed = events.withColumn("_bucket", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))
    timed = samples.withColumn("_bucket", F.floor(col(sample_time) / width))
    joined = timed.join(placed, [*by, "_bucket"])
    inside = col(sample_time).between(start, end)
    return joined.filter(inside).withColumn("offset", col(sample_time) - col(event_time)).drop("_bucket")


def epoch_regular(signal: DataFrame, events: DataFrame, by: list[str], sample: str, event_sample: str,
                  first: int, last: int) -> DataFrame:
    """Epochs of a regularly sampled signal: equality join on the sample number."""
    offsets = F.sequence(F.lit(first), F.lit(last))
    placed = (events.withColumn("t_idx", F.explode(offsets))
              .withColumn(sample, col(event_sample) + F.col("t_idx")))
    return signal.join(placed, [*by, sample])


def nearest_time(times: DataFrame, targets: list[float], time: str) -> DataFrame:
    """For every target the closest time; the earlier one on a tie."""
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets]))
    near = times.select(col(time).cast("double").alias("_t"), wanted.alias("target"))
    return near.groupBy("target").agg(
        F.min_by("_t", F.struct(F.abs(F.col("_t") - F.col("target")), F.col("_t"))).alias("nearest"))


def contribution(trials: DataFrame, draws: DataFrame, terms: dict[str, tuple[str, str]], subject: str,
                 param: str = "param", value: str = "value", mask: dict[str, Column] | None = None) -> DataFrame:
    """Mean over draws of coefficient * x for every trial.

    ``terms`` maps an output column to (parameter, trial column). The mean of
    c*x is mean(c)*x, so draws are averaged per subject before they meet the
    trials. ``mask`` limits an output to the trials where its condition holds.
    """
    names = sorted({p for p, _ in terms.values()}, key=str)
    means = (draws.filter(col(param).isin(names)).groupBy(col(subject))
             .agg(*[F.avg(F.when(col(param) == n, col(value))).alias(f"_m{i}") for i, n in enumerate(names)]))
    place = {n: F.col(f"_m{i}") for i, n in enumerate(names)}
    out = {}
    for name, (parameter, x) in terms.items():
        product = place[parameter] * col(x)
        out[name] = F.when(mask[name], product) if mask and name in mask else product
    joined = attach(trials, means, [subject]).withColumns(out)
    return joined.drop(*[f"_m{i}" for i in range(len(names))])


def significance_mask(df: DataFrame, pvals: DataFrame, on: list[str], alpha: float = 0.05) -> DataFrame:
    """Add ``significant``: p below alpha at the same point."""
    flagged = pvals.select(*map(col, on), (F.col("p") < alpha).alias("significant"))
    return df.join(flagged, on, "left")
