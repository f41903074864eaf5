"""Continuous signals and epochs.

Two layouts: ``arrays`` has one row per (participant, epoch, channel) with the
samples in an array ``x``; ``long`` has one row per sample with ``t_idx`` and
``value``. Work inside one epoch and channel stays in the row of the array
layout and needs no shuffle. Work across trials or channels explodes first and
aggregates with map-side combine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicelab.operators.aggregates import grand_average
from choicelab.operators.joins import attach, significance_mask
from choicelab.operators.ranking import col
from choicelab.operators.windows import quantile_bins, zscore


def to_long(arrays: DataFrame, x: str = "x") -> DataFrame:
    keep = [col(c) for c in arrays.columns if c != x]
    return arrays.select(*keep, F.posexplode(col(x)).alias("t_idx", "value"))


def to_arrays(long: DataFrame, keys: list[str], time: str = "t_idx", value: str = "value") -> DataFrame:
    """Gather the samples of an epoch; a group holds one epoch of one channel."""
    pairs = F.array_sort(F.collect_list(F.struct(col(time), col(value))))
    return long.groupBy(*map(col, keys)).agg(pairs[value].alias("x"))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def _between(x: Column, first: int, last: int) -> Column:
    return F.slice(x, first + 1, last - first + 1)


def baseline_correct(arrays: DataFrame, first: int, last: int, x: str = "x") -> DataFrame:
    """Subtract the mean of samples ``first..last`` from every sample of the row."""
    base = arrays.withColumn("_base", _mean(_between(col(x), first, last)))
    return base.withColumn(x, F.transform(col(x), lambda v: v - F.col("_base"))).drop("_base")


def average_reference(long: DataFrame, at: list[str], value: str = "value") -> DataFrame:
    """Subtract the mean over channels at each sample; ``at`` identifies a sample of a
    recording, so a window holds one value per channel."""
    everywhere = Window.partitionBy(*map(col, at))
    return long.withColumn(value, col(value) - F.avg(col(value)).over(everywhere))


def apply_channel_matrix(long: DataFrame, matrix: DataFrame, at: list[str], channel: str = "channel",
                         value: str = "value") -> DataFrame:
    """Linear map of channels: ``matrix`` is (in_ch, out_ch, w)."""
    weights = matrix.withColumnRenamed("in_ch", channel)
    return long.join(weights, channel).groupBy(*map(col, at), F.col("out_ch").alias(channel)).agg(
        F.sum(col(value) * F.col("w")).alias(value))


def reject_peak_to_peak(arrays: DataFrame, threshold: float, epoch: list[str], channel: str = "channel",
                        x: str = "x") -> DataFrame:
    """Per epoch the channels whose range exceeds the threshold and the ``badtrial`` flag."""
    swing = F.array_max(col(x)) - F.array_min(col(x))
    reason = F.when(swing > threshold, col(channel))
    logged = arrays.groupBy(*map(col, epoch)).agg(F.array_sort(F.collect_list(reason)).alias("reasons"))
    return logged.withColumn("badtrial", (F.size("reasons") > 0).cast("int"))


def decimate(long: DataFrame, q: int, time: str = "t_idx") -> DataFrame:
    """Every q-th sample, renumbered."""
    return long.filter(col(time) % q == 0).withColumn(time, F.floor(col(time) / q))


def bucket_mean(long: DataFrame, keys: list[str], q: int, time: str = "t_idx", value: str = "value") -> DataFrame:
    """Mean of q consecutive samples."""
    return long.groupBy(*map(col, keys), F.floor(col(time) / q).alias(time)).agg(F.avg(col(value)).alias(value))


def fir_kernel(sfreq: float, low: float | None = None, high: float | None = None, taps: int = 101) -> list[float]:
    """Hamming-windowed sinc: low-pass, high-pass or band-pass with unit pass-band gain."""
    n = np.arange(taps) - (taps - 1) / 2
    window = np.hamming(taps)

    def lowpass(cut: float) -> np.ndarray:
        h = np.sinc(2 * cut / sfreq * n) * window
        return h / h.sum()

    kernel = lowpass(high) if high else (n == 0).astype(float)
    if low:
        kernel = kernel - lowpass(low)
    return [float(w) for w in kernel]


def fir_filter(long: DataFrame, kernel: list[float], keys: list[str], time: str = "t_idx", value: str = "value",
               chunk: int = 16_384) -> DataFrame:
    """Zero-phase FIR filter; samples beyond the ends of a recording count as zero.

    The recording is cut into chunks that carry half a kernel of their
    neighbours' samples, so a group holds at most ``chunk`` + kernel samples
    however long the recording is.
    """
    weights = np.asarray(kernel, dtype=float)
    half = len(weights) // 2
    if len(weights) % 2 == 0:
        raise ValueError("the kernel needs an odd number of taps")
    width = max(chunk, len(weights))
    home = F.floor(col(time) / width)
    place = col(time) - home * width
    homes = F.array_compact(F.array(home, F.when(place < half, home - 1), F.when(place >= width - half, home + 1)))
    spread = long.select(*map(col, keys), col(time).cast("long").alias(time), col(value).cast("double").alias(value),
                         F.explode(homes).alias("_chunk"))

    def convolve(frame: pd.DataFrame) -> pd.DataFrame:
        start = int(frame["_chunk"].iloc[0]) * width
        dense = np.zeros(width + 2 * half)
        at = frame[time].to_numpy() - start + half
        dense[at] = frame[value].to_numpy()
        inside = frame[(at >= half) & (at < half + width)]
        smooth = np.convolve(dense, weights, mode="valid")
        return inside.assign(**{value: smooth[inside[time].to_numpy() - start]}).drop(columns="_chunk")

    fields = dict(long.dtypes)
    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in keys], f"`{time}` bigint", f"`{value}` double"])
    return spread.groupBy(*map(col, keys), "_chunk").applyInPandas(convolve, schema)


def power_spectrum(long: DataFrame, keys: list[str], segment: int, sfreq: float, fmax: float | None = None,
                   last: int | None = None, time: str = "t_idx", value: str = "value") -> DataFrame:
    """Mean periodogram over consecutive full segments of ``segment`` samples.

    One-sided density without taper; ``last`` limits the signal to its first
    samples. A group holds one segment.
    """
    rows = long if last is None else long.filter(col(time) < last)
    pieces = (rows.groupBy(*map(col, keys), F.floor(col(time) / segment).alias("_segment"))
              .agg(F.array_sort(F.collect_list(F.struct(col(time), col(value).cast("double")))).alias("_s"))
              .filter(F.size("_s") == segment))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def periodogram(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        power = np.abs(np.fft.rfft(np.stack(x.to_numpy()), axis=1)) ** 2 / (sfreq * segment)
        power[:, 1:(segment + 1) // 2] *= 2
        return pd.Series(list(power))

    spectra = pieces.select(*map(col, keys), F.posexplode(periodogram(F.col("_s.col2"))).alias("_f", "power"))
    out = spectra.groupBy(*map(col, keys), (F.col("_f") * (sfreq / segment)).alias("freq")).agg(
        F.avg("power").alias("power"))
    return out if fmax is None else out.filter(F.col("freq") <= fmax)


def window_amplitude(arrays: DataFrame, channels: list, first: int, last: int, subject: str = "participant",
                     epoch: str = "epoch", channel: str = "channel", out: str = "amp") -> DataFrame:
    """Mean over channels and samples ``first..last`` per trial, z-scored over the subject's trials."""
    part = _between(col("x"), first, last)
    rows = arrays.filter(col(channel).isin(channels)).select(
        col(subject), col(epoch), F.aggregate(part, F.lit(0.0), lambda a, v: a + v).alias("_sum"), F.size(part).alias("_n"))
    amps = rows.groupBy(col(subject), col(epoch)).agg((F.sum("_sum") / F.sum("_n")).alias(out))
    return zscore(amps, [out], [subject])


def evoked(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over trials per key and sample."""
    return to_long(arrays.select(*map(col, keys), "x")).groupBy(*map(col, keys), "t_idx").agg(
        F.avg("value").alias("value"))


def scale_channels(long: DataFrame, by: tuple[str, ...] = ("participant", "channel"), value: str = "value") -> DataFrame:
    """z-score of every channel over the subject's trials and samples."""
    scaled = zscore(long, [value], list(by), "_scaled")
    return scaled.drop(value).withColumnRenamed(f"{value}_scaled", value)


def massunivariate_ols(arrays: DataFrame, trials: DataFrame, regressors: list[str], subject: str = "participant",
                       epoch: str = "epoch", channel: str = "channel") -> DataFrame:
    """Slope of the scaled signal on each z-scored regressor per subject, channel and sample.

    Signal and regressor are standardised after the fact: the raw slope and the
    moments come out of one pass over the exploded signal, and the spread of a
    channel is pooled from the moments of its samples. Trials without a value of
    a regressor are left out of that regressor only.
    """
    count = range(len(regressors))
    sizes = trials.groupBy(col(subject)).agg(*[F.stddev_pop(col(r)).alias(f"_sd{i}") for i, r in enumerate(regressors)])
    wanted = attach(trials.select(col(subject), col(epoch), *map(col, regressors)), sizes, [subject])
    joined = arrays.select(col(subject), col(epoch), col(channel), "x").join(wanted, [subject, epoch])
    samples = joined.select(col(subject), col(channel), *[f"_sd{i}" for i in count],
                            *[col(r).cast("double").alias(f"_r{i}") for i, r in enumerate(regressors)],
                            F.posexplode("x").alias("t_idx", "_y"))

    def slope(i: int) -> Column:
        r = F.when(F.col("_y").isNotNull(), F.col(f"_r{i}"))
        return F.when(F.var_pop(r) > 0, F.covar_pop(F.col("_y"), r) / F.var_pop(r))

    slopes = [c for i in count for c in (slope(i).alias(f"_b{i}"), F.max(f"_sd{i}").alias(f"_sd{i}"))]
    points = samples.groupBy(col(subject), col(channel), "t_idx").agg(
        F.count("_y").alias("_n"), F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_var"), *slopes)
    # one subject and channel: as many rows as an epoch has samples
    whole = Window.partitionBy(col(subject), col(channel))
    centre = F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.sum("_n").over(whole)
    points = points.withColumn("_centre", centre)
    gap = F.col("_mean") - F.col("_centre")
    pooled = F.sqrt(F.sum(F.col("_n") * (F.col("_var") + gap * gap)).over(whole) / F.sum("_n").over(whole))
    points = points.withColumn("_sd", pooled)
    betas = F.array(*[F.struct(F.lit(r).alias("regressor"),
                               F.when(F.col("_sd") > 0, F.col(f"_b{i}") * F.col(f"_sd{i}") / F.col("_sd")).alias("beta"))
                      for i, r in enumerate(regressors)])
    return points.select(col(subject), col(channel), "t_idx", F.inline(betas)).filter(F.col("beta").isNotNull())


def t_critical(alpha: float, df: int) -> float:
    """Two-sided critical value of Student's t, by bisection on the integrated density."""
    def upper_tail(t: float) -> float:
        # x = sqrt(df) * tan(u) turns the tail into a bounded integral of cos(u)^(df-1)
        start = np.arctan(t / np.sqrt(df))
        nodes, weights = np.polynomial.legendre.leggauss(200)

        def area(a: float, b: float) -> float:
            u = (b - a) / 2 * nodes + (a + b) / 2
            return (b - a) / 2 * float(np.sum(weights * np.cos(u) ** (df - 1)))

        return area(start, np.pi / 2) / area(-np.pi / 2, np.pi / 2)

    lo, hi = 0.0, 1.0
    while upper_tail(hi) > alpha / 2:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper_tail(mid) > alpha / 2 else (lo, mid)
    return (lo + hi) / 2


def onesample_t(betas: DataFrame, keys: list[str], value: str = "beta") -> DataFrame:
    """t over subjects per point; null where subjects do not differ."""
    stats = betas.groupBy(*map(col, keys)).agg(
        F.avg(col(value)).alias("mean"), F.stddev_samp(col(value)).alias("_sd"), F.count(col(value)).alias("n"))
    t = F.when(F.col("_sd") > 0, F.col("mean") / (F.col("_sd") / F.sqrt("n")))
    return stats.withColumn("t", t).drop("_sd")


def binned_evoked(arrays: DataFrame, trials: DataFrame, regressor: str, n: int, subject: str = "participant",
                  epoch: str = "epoch", channel: str = "channel") -> DataFrame:
    """Grand average per quantile bin of the regressor, channel and sample."""
    binned = quantile_bins(trials, regressor, n).filter(F.col("bin").isNotNull()).select(col(subject), col(epoch), "bin")
    joined = to_long(arrays.join(binned, [subject, epoch]))
    return grand_average(joined, subject, ["bin", channel, "t_idx"], "value")


def beta_timecourse(betas: DataFrame, keys: list[str], pvals: DataFrame | None = None, alpha: float = 0.05,
                    value: str = "beta") -> DataFrame:
    """Mean and SEM over subjects per point, with the significance mask when p-values are given."""
    stats = betas.groupBy(*map(col, keys)).agg(
        F.avg(col(value)).alias("mean"), (F.stddev_samp(col(value)) / F.sqrt(F.count(col(value)))).alias("sem"))
    return stats if pvals is None else significance_mask(stats, pvals, keys, alpha)
