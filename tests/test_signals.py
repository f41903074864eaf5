import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicelab.operators import clusters, joins, signals, windows


@pytest.fixture(scope="module")
def data():
    """participants x epochs x channels x samples"""
    return np.random.default_rng(6).normal(size=(4, 30, 3, 12))


@pytest.fixture(scope="module")
def arrays(spark, data):
    rows = [(p, p * 100 + e, c, [float(v) for v in data[p, e, c]]) for p in range(4) for e in range(30) for c in range(3)]
    return spark.createDataFrame(rows, "participant int, epoch int, channel int, x array<double>").repartition(6)


@pytest.fixture(scope="module")
def long(arrays):
    return signals.to_long(arrays)


def dense(df, shape, keys=("participant", "epoch", "channel", "t_idx")):
    out = np.full(shape, np.nan)
    for r in df.collect():
        place = [r[k] % 100 if k == "epoch" else r[k] for k in keys]
        out[tuple(place)] = r["value"]
    return out


def test_layouts(arrays, long, data):
    assert np.allclose(dense(long, data.shape), data)
    back = signals.to_arrays(long, ["participant", "epoch", "channel"])
    assert np.allclose(dense(signals.to_long(back), data.shape), data)


def test_reference_and_baseline(arrays, long, data):
    ref = dense(signals.average_reference(long, ["participant", "epoch", "t_idx"]), data.shape)
    assert np.allclose(ref, data - data.mean(axis=2, keepdims=True)) and np.allclose(ref.sum(axis=2), 0)
    base = dense(signals.to_long(signals.baseline_correct(arrays, 1, 3)), data.shape)
    assert np.allclose(base, data - data[..., 1:4].mean(axis=-1, keepdims=True))


def test_scale_channels(long, data):
    got = dense(signals.scale_channels(long), data.shape)
    mean, sd = data.mean(axis=(1, 3), keepdims=True), data.std(axis=(1, 3), keepdims=True)
    assert np.allclose(got, (data - mean) / sd)


def test_channel_matrix(spark, long, data):
    m = np.random.default_rng(1).normal(size=(2, 3))
    matrix = spark.createDataFrame([(i, o, float(m[o, i])) for i in range(3) for o in range(2)], "in_ch int, out_ch int, w double")
    got = dense(signals.apply_channel_matrix(long, matrix, ["participant", "epoch", "t_idx"]), (4, 30, 2, 12))
    assert np.allclose(got, np.einsum("oc,pect->peot", m, data))


def test_peak_to_peak(arrays, data):
    got = {(r["participant"], r["epoch"] % 100): (list(r["reasons"]), r["badtrial"])
           for r in signals.reject_peak_to_peak(arrays, 3.5, ["participant", "epoch"]).collect()}
    swing = np.ptp(data, axis=-1) > 3.5
    for (p, e), (reasons, bad) in got.items():
        assert reasons == list(np.flatnonzero(swing[p, e])) and bad == int(swing[p, e].any())
    assert len(got) == 120


def test_decimate_and_buckets(long, data):
    assert np.allclose(dense(signals.decimate(long, 3), (4, 30, 3, 4)), data[..., ::3])
    got = dense(signals.bucket_mean(long, ["participant", "epoch", "channel"], 4), (4, 30, 3, 3))
    assert np.allclose(got, data.reshape(4, 30, 3, 3, 4).mean(axis=-1))


@pytest.mark.parametrize("chunk", [16, 50, 10_000])
def test_fir_filter_is_independent_of_chunks(spark, chunk):
    x = np.random.default_rng(2).normal(size=333)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "rec string, t int, value double").repartition(4)
    kernel = signals.fir_kernel(100, low=5, high=20, taps=15)
    got = signals.fir_filter(df, kernel, ["rec"], "t", chunk=chunk).toPandas().sort_values("t")
    assert got["t"].tolist() == list(range(333))
    np.testing.assert_allclose(got["value"], np.convolve(x, kernel, mode="same"))


def test_fir_kernel_gain():
    gain = lambda k, f: abs(np.sum(np.array(k) * np.exp(-2j * np.pi * f / 1000 * np.arange(len(k)))))
    low = signals.fir_kernel(1000, high=30, taps=301)
    assert gain(low, 0) == pytest.approx(1) and gain(low, 10) == pytest.approx(1, abs=0.02) and gain(low, 60) < 0.01
    band = signals.fir_kernel(1000, low=20, high=100, taps=301)
    assert gain(band, 0) < 1e-9 and gain(band, 60) == pytest.approx(1, abs=0.02) and gain(band, 200) < 0.01


def test_power_spectrum(spark):
    t = np.arange(1000)
    x = np.sin(2 * np.pi * 8 * t / 128) + 0.1 * np.random.default_rng(0).normal(size=1000)
    df = spark.createDataFrame([("r", int(i), float(v)) for i, v in zip(t, x)], "rec string, t int, value double").repartition(3)
    got = signals.power_spectrum(df, ["rec"], 128, 128.0, time="t").toPandas().sort_values("freq")
    seg = x[: 7 * 128].reshape(7, 128)
    power = np.abs(np.fft.rfft(seg, axis=1)) ** 2 / (128 * 128)
    power[:, 1:-1] *= 2
    np.testing.assert_allclose(got["power"], power.mean(axis=0))
    assert got.loc[got["power"].idxmax(), "freq"] == 8
    assert power.mean(axis=0).sum() == pytest.approx((seg**2).mean(), rel=1e-6)


def test_window_amplitude(arrays, data):
    got = signals.window_amplitude(arrays, [0, 2], 4, 7).toPandas()
    amp = data[:, :, [0, 2], 4:8].mean(axis=(2, 3))
    z = (amp - amp.mean(axis=1, keepdims=True)) / amp.std(axis=1, keepdims=True)
    for r in got.itertuples():
        assert r.amp == pytest.approx(amp[r.participant, r.epoch % 100]) and r.amp_z == pytest.approx(z[r.participant, r.epoch % 100])


def test_epoch_regular(spark):
    sig = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "rec string, t int, value double")
    ev = spark.createDataFrame([("a", 5), ("a", 18), ("b", 3)], "rec string, cue int")
    got = sorted((r["cue"], r["t_idx"], r["value"]) for r in joins.epoch_regular(sig, ev, ["rec"], "t", "cue", -1, 2).collect())
    assert got == [(5, -1, 4.0), (5, 0, 5.0), (5, 1, 6.0), (5, 2, 7.0), (18, -1, 17.0), (18, 0, 18.0), (18, 1, 19.0)]


@pytest.fixture(scope="module")
def trials():
    rng = np.random.default_rng(9)
    t = pd.DataFrame([(p, p * 100 + e) for p in range(4) for e in range(30)], columns=["participant", "epoch"])
    t["money"] = rng.normal(size=len(t))
    t["gaps"] = np.where(rng.random(len(t)) < 0.3, np.nan, rng.normal(size=len(t)))
    return t


def test_massunivariate_and_group_t(spark, arrays, data, trials):
    df = spark.createDataFrame(trials).withColumn("gaps", F.when(~F.isnan("gaps"), F.col("gaps")))
    betas = signals.massunivariate_ols(arrays, df, ["money", "gaps"]).toPandas()
    scaled = (data - data.mean(axis=(1, 3), keepdims=True)) / data.std(axis=(1, 3), keepdims=True)
    assert len(betas) == 2 * 4 * 3 * 12
    maps = {}
    for (reg, p), rows in betas.groupby(["regressor", "participant"]):
        x = trials[trials.participant == p][reg].to_numpy()
        keep = ~np.isnan(x)
        z = (x[keep] - x[keep].mean()) / x[keep].std()
        design = np.column_stack([np.ones(len(z)), z])
        want = np.linalg.lstsq(design, scaled[p][keep].reshape(len(z), -1), rcond=None)[0][1].reshape(3, 12)
        got = rows.pivot(index="channel", columns="t_idx", values="beta").to_numpy()
        np.testing.assert_allclose(got, want)
        maps.setdefault(reg, []).append(want)
    t = signals.onesample_t(spark.createDataFrame(betas), ["regressor", "channel", "t_idx"]).toPandas()
    for reg, rows in t.groupby("regressor"):
        m = np.stack(maps[reg])
        want = m.mean(axis=0) / (m.std(axis=0, ddof=1) / 2)
        np.testing.assert_allclose(rows.pivot(index="channel", columns="t_idx", values="t").to_numpy(), want)


def test_binned_evoked(spark, arrays, data, trials):
    got = signals.binned_evoked(arrays, spark.createDataFrame(trials), "money", 3).toPandas()
    bins = pd.qcut(trials["money"], 3, labels=False).to_numpy().reshape(4, 30)
    for b in range(3):
        want = np.mean([data[p][bins[p] == b].mean(axis=0) for p in range(4)], axis=0)
        rows = got[got.bin == b].pivot(index="channel", columns="t_idx", values="value").to_numpy()
        np.testing.assert_allclose(rows, want)


def test_beta_timecourse_mask(spark):
    betas = spark.createDataFrame([(s, 0, t, float(s + t)) for s in range(4) for t in range(2)],
                                  "participant int, channel int, t_idx int, beta double")
    pvals = spark.createDataFrame([(0, 0, 0.01), (0, 1, 0.2)], "channel int, t_idx int, p double")
    got = {r["t_idx"]: r for r in signals.beta_timecourse(betas, ["channel", "t_idx"], pvals).collect()}
    assert got[0]["significant"] and not got[1]["significant"]
    assert got[0]["sem"] == pytest.approx(np.std([0, 1, 2, 3], ddof=1) / 2)


def test_t_critical():
    # table values of Student's t
    for alpha, df, want in ((0.05, 10, 2.228139), (0.01, 48, 2.682204), (0.05, 1, 12.706205), (0.2, 9, 1.383029), (0.01, 500, 2.585698)):
        assert signals.t_critical(alpha, df) == pytest.approx(want, abs=2e-6)


# --- cluster test -----------------------------------------------------------

def brute_clusters(t, edges, thr):
    """Label grid of clusters by flood fill; signs apart."""
    n_ch, n_t = t.shape
    near = {c: {b for a, b in edges if a == c} | {a for a, b in edges if b == c} for c in range(n_ch)}
    label = -np.ones(t.shape, int)
    found = 0
    for c in range(n_ch):
        for k in range(n_t):
            if abs(t[c, k]) <= thr or label[c, k] >= 0:
                continue
            todo, sign = [(c, k)], np.sign(t[c, k])
            label[c, k] = found
            while todo:
                a, i = todo.pop()
                for b, j in [(a, i - 1), (a, i + 1), *[(x, i) for x in near[a]]]:
                    if 0 <= j < n_t and label[b, j] < 0 and abs(t[b, j]) > thr and np.sign(t[b, j]) == sign:
                        label[b, j] = found
                        todo.append((b, j))
            found += 1
    return label, [t[label == i].sum() for i in range(found)]


def test_cluster_permutation_matches_brute_force(spark):
    rng = np.random.default_rng(12)
    n_sub, n_ch, n_t, n_perm, seed, thr = 8, 5, 14, 25, 3, 1.2
    x = rng.normal(size=(n_sub, n_ch, n_t))
    x[:, 1:4, 4:9] += 0.9
    edges = [(0, 1), (1, 2), (2, 3), (3, 4)]
    rows = [(s, c, k, float(x[s, c, k])) for s in range(n_sub) for c in range(n_ch) for k in range(n_t)]
    betas = spark.createDataFrame(rows, "participant int, channel int, t_idx int, beta double").repartition(5)
    edge_df = spark.createDataFrame(edges, "channel_a int, channel_b int")
    got = clusters.cluster_permutation(betas, edge_df, n_perm, seed, thr).toPandas()
    assert len(got) == n_ch * n_t

    signs = spark.range(n_perm).selectExpr("cast(id as int) perm", "explode(sequence(0, 7)) s").select(
        "perm", "s", clusters.sign_of(seed, F.col("perm"), F.col("s")).alias("sign")).toPandas()
    signs = signs.pivot(index="perm", columns="s", values="sign").to_numpy()
    assert (signs[0] == 1).all() and set(np.unique(signs)) == {-1.0, 1.0} and len(np.unique(signs, axis=0)) > 10
    t_of = lambda y: y.mean(axis=0) / (y.std(axis=0, ddof=1) / np.sqrt(n_sub))
    largest = []
    for s in signs:
        masses = brute_clusters(t_of(x * s[:, None, None]), edges, thr)[1]
        largest.append(max(map(abs, masses), default=0.0))
    t = t_of(x)
    label, masses = brute_clusters(t, edges, thr)
    want = np.ones(t.shape)
    for i, m in enumerate(masses):
        want[label == i] = np.mean(np.array(largest) >= abs(m) - 1e-9)
    grid = got.pivot(index="channel", columns="t_idx", values="p").to_numpy()
    np.testing.assert_allclose(got.pivot(index="channel", columns="t_idx", values="t").to_numpy(), t)
    np.testing.assert_allclose(grid, want)
    assert grid.min() <= 2 / n_perm                        # the planted effect is found


def test_long_snake_is_one_cluster():
    """A cluster whose runs hang together only through many hops; a point of the other sign stays apart."""
    n = 24
    points = [(c, t, 2.0) for c in range(n) for t in ([2 * c, 2 * c + 1, 2 * c + 2])] + [(0, 3, -2.0), (n + 1, 0, 2.0)]
    near = {c: [c - 1, c + 1] for c in range(n)}
    labels = clusters.lattice_clusters(points, near)
    assert len(set(labels[:3 * n])) == 1 and len(set(labels)) == 3


def test_cluster_test_of_groups_and_gaps(spark):
    """Groups are tested apart; blocks of permutations, missing points and points without variance change nothing else."""
    rng = np.random.default_rng(2)
    n_sub, n_ch, n_t, n_perm = 9, 3, 10, 40
    x = rng.normal(size=(2, n_sub, n_ch, n_t)) + 0.5
    x[1, :, 2, 4] = 0.25                      # no variance
    rows = [(g, f"s{s}", f"c{c}", k, float(x[i, s, c, k])) for i, g in enumerate("ab") for s in range(n_sub) for c in range(n_ch) for k in range(n_t)
            if (g, s, c, k) != ("a", 0, 1, 3)]  # a missing point
    betas = spark.createDataFrame(rows, "g string, participant string, channel string, t_idx int, beta double").repartition(6)
    edges = spark.createDataFrame([("c0", "c1"), ("c1", "c2")], "channel_a string, channel_b string")
    whole = clusters.cluster_permutation(betas, edges, n_perm, 5, 1.1, by=("g",), block=7).toPandas()
    assert len(whole) == 2 * n_ch * n_t - 1
    assert not ((whole.g == "b") & (whole.channel == "c2") & (whole.t_idx == 4)).any()
    for g in "ab":
        alone = clusters.cluster_permutation(betas.filter(F.col("g") == g).drop("g"), edges, n_perm, 5, 1.1).toPandas()
        one = whole[whole.g == g].set_index(["channel", "t_idx"]).sort_index()
        two = alone.set_index(["channel", "t_idx"]).sort_index()
        np.testing.assert_allclose(one.t, two.t)
        np.testing.assert_allclose(one.p, two.p)
    t = whole[(whole.g == "a") & (whole.channel == "c1") & (whole.t_idx == 3)].t.item()
    y = x[0, 1:, 1, 3]
    assert t == pytest.approx(y.mean() / (y.std(ddof=1) / np.sqrt(8)))
    assert clusters.cluster_permutation(betas.limit(0), edges, n_perm, 5, 1.1, by=("g",)).count() == 0

