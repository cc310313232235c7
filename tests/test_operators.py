"""Golden and brute-force cases of the interval, depth, smoothing, panel, track and upscaling operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, flag, is_autosome, track_sample_name
from tidemark.operators import coverage, intervals, matrix, panel, scaling, smooth, upscale

IV = "chrom string, start long, end long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_tile_widen_and_length(spark):
    a = spark.createDataFrame([("c", 10, 25), ("c", 30, 30)], IV)
    assert rows(intervals.tile(a, 10)) == [("c", 10, 20), ("c", 20, 25)]
    sizes = spark.createDataFrame([("c", 26)], "chrom string, size long")
    assert rows(intervals.widen(spark.createDataFrame([("c", 1, 25)], IV), sizes, 2)) == [("c", 0, 26)]
    with pytest.raises(Exception, match="no size"):
        intervals.widen(spark.createDataFrame([("d", 1, 2)], IV), sizes).collect()
    w = spark.createDataFrame([("c", 0, 2500), ("c", 0, 2499)], IV)
    assert rows(intervals.long_enough(w, 5001, 0.5)) == [("c", 0, 2500)]


def test_merge_and_subtract_against_bases(spark):
    r = random.Random(1)
    for _ in range(2):
        mask = [("ab"[r.randrange(2)], s := r.randrange(200), s + r.randrange(1, 15)) for _ in range(20)] + [("a", 50, 60), ("a", 60, 70), ("a", 50, 60)]
        windows = [(c, k, k + 20) for c in "ab" for k in range(0, 220, 20)] + [("a", 0, 20)]
        covered = {(c, p) for c, s, e in mask for p in range(s, e)}
        merged = intervals.merge(spark.createDataFrame(mask, IV))
        got = rows(merged)
        assert {(c, p) for c, s, e in got for p in range(s, e)} == covered
        assert all((c, e) not in covered for c, s, e in got)
        want = []
        for c, s, e in windows:
            run = None
            for p in range(s, e + 1):
                if p < e and (c, p) not in covered:
                    run = p if run is None else run
                elif run is not None:
                    want.append((c, run, p))
                    run = None
        assert rows(intervals.subtract(spark.createDataFrame(windows, IV), merged, 16)) == sorted(want)


def test_point_lookup(spark):
    w = spark.createDataFrame([("c", 0, 10, 2.0), ("c", 5, 15, 3.0)], IV + ", v double")
    p = spark.createDataFrame([(1, "c", 0), (2, "c", 9), (3, "c", 10), (4, "c", 15), (5, "d", 1), (6, None, 1)], "row long, chrom string, pos long")
    assert rows(intervals.point_lookup(p, w, "v", 1.0, 4), "row", "v") == [(1, 2.0), (2, 2.0), (3, 3.0), (4, 1.0), (5, 1.0), (6, 1.0)]


def test_depth_and_gc(spark):
    reads = [("s", "q1", 0, "c", 0, 60, "5M2D5M"), ("s", "q1", 0, "c", 8, 60, "6M"), ("s", "q2", 1024, "c", 0, 60, "9M"), ("s", "q3", 0, "c", 0, 19, "9M"), ("s", "q4", 0, "c", 18, 20, "3S4M1I2M")]
    df = spark.createDataFrame(reads, "sample string, qname string, flag int, chrom string, pos long, mapq int, cigar string")
    w = spark.createDataFrame([("w1", "c", 0, 10), ("w2", "c", 10, 20), ("w3", "d", 0, 10)], "window_id string, " + IV)
    # q1 covers 0-5 and 7-14 (mates overlap once), q4 18-24.
    assert rows(coverage.window_depth(df, w), "window_id", "depth") == [("w1", 0.8), ("w2", 0.6), ("w3", 0.0)]
    seq = spark.createDataFrame([("c", 0, "GCATN"), ("c", 5, "gcAAA"), ("c", 10, "G")], "chrom string, start long, seq string")
    assert rows(coverage.gc_fraction(w.where("chrom = 'c'"), seq, 5)) == [("w1", 0.4), ("w2", 0.1)]


def pointwise(x, y, frac, passes):
    k = smooth.neighbours(len(x), frac)
    delta, fit = np.ones(len(x)), np.zeros(len(x))
    for step in range(passes + 1):
        for i in range(len(x)):
            d = np.abs(x - x[i])
            h = np.sort(d)[k - 1]
            u = d / h if h else d
            t = (np.where(u <= 0.001, 1, np.where(u > 0.999, 0, (1 - np.minimum(u, 1) ** 3) ** 3)) if h else (d == 0).astype(float)) * delta
            m = (t * x).sum() / t.sum()
            s = (t * (x - m) ** 2).sum() / t.sum()
            fit[i] = (t * y).sum() / t.sum() + ((x[i] - m) * (t * (x - m) * y).sum() / t.sum() / s if s > 1e-12 else 0)
        r = np.abs(y - fit)
        u = r / (6 * np.median(r))
        delta = np.where(u >= 0.999, 0, np.where(u <= 0.001, 1, (1 - u**2) ** 2))
    return fit


def test_lowess_equals_pointwise_form():
    r = np.random.default_rng(3)
    x = r.integers(300, 600, 400) / 1000
    y = np.sin(x * 9) + r.normal(0, 0.1, 400)
    y[::37] += 4
    xs, fit = smooth.lowess(x, y)
    assert np.allclose(fit[np.searchsorted(xs, x)], pointwise(x, y, 0.1, 3), atol=1e-9)


def test_lowess_of_uneven_points():
    """Distinct fractions, a dense cluster among few points, and ties as many as neighbours."""
    r = np.random.default_rng(4)
    for x in (r.normal(0.45, 0.06, 400), np.append(r.normal(0.4, 0.001, 200), r.uniform(0, 1, 30)), np.repeat([0.1, 0.2, 0.3], [50, 2, 100])):
        y = np.sin(x * 9) + r.normal(0, 0.1, len(x))
        xs, fit = smooth.lowess(x, y)
        assert np.allclose(fit[np.searchsorted(xs, x)], pointwise(x, y, 0.1, 3), atol=1e-9)


def test_lowess_of_a_genome():
    """As many windows as a genome has, nearly all with a fraction of their own: the curve follows what made the points."""
    r = np.random.default_rng(6)
    length = r.integers(2500, 5001, 200_000)
    x = r.binomial(length, r.normal(0.42, 0.06, len(length)).clip(0.1, 0.9)) / length
    y = 1 + np.sin(x * 9) + r.normal(0, 0.2, len(x))
    xs, fit = smooth.lowess(x, y)
    inner = (xs > 0.3) & (xs < 0.55)
    assert len(xs) > 100_000 and np.abs(fit - 1 - np.sin(xs * 9))[inner].max() < 0.05


def test_interpolation_is_clamped(spark):
    curve = spark.createDataFrame([("s", 0.2, 1.0), ("s", 0.4, 3.0)], "sample string, gc double, fit double")
    q = spark.createDataFrame([("s", g, k) for k, g in enumerate((0.1, 0.2, 0.25, 0.4, 0.9, None))] + [("t", 0.3, 6)], "sample string, gc double, k int")
    for knots in (0, 10):  # by order, and by a broadcast curve
        assert [round(r["fit"], 9) if r["fit"] is not None else None for r in smooth.interpolated(q, curve, knots).orderBy("k").collect()] == [1.0, 1.0, 1.5, 3.0, 3.0, None, None]
    assert smooth.interpolated(q, curve.limit(0)).where("fit is not null").count() == 0


def matrix_rows(spark, values):
    data = [(s, f"{c}:{k}", c, k, k + 1, g, d) for s, per in values.items() for k, (c, g, d) in enumerate(per)]
    return spark.createDataFrame(data, "sample string, window_id string, chrom string, start long, end long, gc_pct double, depth double")


def test_normalisation_and_bypass(spark):
    few = [("chr1", 0.3, float(k)) for k in (1, 2, 3)] + [("chrX", 0.3, 100.0)]
    zero = [("chr1", 0.3, 0.0)] * 3 + [("chrX", 0.3, 7.0)]
    df = matrix.with_autosomes(matrix_rows(spark, {"a": few, "z": zero}))
    norm = matrix.normalized(df)
    assert rows(norm.where("sample = 'a'"), "norm") == [(0.5,), (1.0,), (1.5,), (50.0,)]
    assert rows(norm.where("sample = 'z'"), "norm", "status") == [(0.0, "skipped")] * 3 + [(7.0, "skipped")]
    fixed = matrix.gc_corrected(norm.where("status = 'ok'"), matrix.normal_training())
    assert rows(fixed, "corrected", "corrected_by") == [(v, "too few points") for v in (0.5, 1.0, 1.5, 50.0)]
    sexes = matrix.with_autosomes(matrix_rows(spark, {"a": [("chrX", 0.3, 1.0), ("chrY", 0.3, 2.0)]}))
    assert rows(sexes, "is_auto") == [(True,), (True,)]
    wide = matrix.pivoted(df, ["a", "z"])
    assert rows(matrix.unpivoted(wide), "sample", "window_id", "depth") == rows(df, "sample", "window_id", "depth")
    with pytest.raises(Exception, match="twice"):
        matrix.pivoted(df.unionByName(df), ["a", "z"]).collect()


def test_panel_equals_svd(spark):
    r = np.random.default_rng(5)
    w = 1 + r.normal(0, 0.1, (40, 5))
    df = spark.createDataFrame([(f"s{j}", f"w{i:02d}", float(w[i, j])) for i in range(40) for j in range(5)], "sample string, window_id string, depth double")
    c = w - w.mean(axis=1, keepdims=True)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    want = w - (u[:, :2] * s[:2]) @ v[:2]
    den = panel.denoised(df, 2)
    got = np.array([r["denoised"] for r in den.orderBy("window_id", "sample").collect()]).reshape(40, 5)
    assert np.allclose(got, want, atol=1e-12)
    stats = {r["window_id"]: r for r in panel.with_high_variance(panel.panel_stats(den)).collect()}
    limit = np.percentile(want.var(axis=1), 99)
    assert all(stats[f"w{i:02d}"]["is_high_variance"] == int(want[i].var() > limit) and abs(stats[f"w{i:02d}"]["pon_median"] - np.median(want[i])) < 1e-12 for i in range(40))
    assert panel.components_to_remove(3, 5) == 2
    with pytest.raises(ValueError):
        panel.components_to_remove(1, 5)


def test_flags_at_their_limits(spark):
    cases = [(1.0, 1.0, 0.09, 1.0, 0), (1.0, 1.0, 0.0901, 1.0, 0), (0.0, 1.0, 0.0, 0.0, 0), (1.0, 1.0, 0.0, 20.0, 1), (1.0, 1.0, 0.0, 20.1, 0), (1.0, 1.0, 0.0, 0.05, 0), (1.0, 0.01, 0.0, 1000.0, 0), (1.0, 0.0, 1.0, None, 0)]
    df = spark.createDataFrame([("s", f"w{k}", "c", k, k + 1, 0.4, raw, m, v, ratio, high) for k, (raw, m, v, ratio, high) in enumerate(cases)], "sample string, window_id string, chrom string, start long, end long, gc_pct double, raw_wes_depth double, pon_median double, pon_variance double, depth_scaled_ratio double, is_high_variance int")
    a = scaling.flagged(df, scaling.extreme_by_target(), scaling.COLUMNS_A).orderBy("window_id").collect()
    b = scaling.flagged(df, scaling.extreme_by_panel(), scaling.COLUMNS_B).orderBy("window_id").collect()
    assert [r["flag_high_cv"] for r in a] == [0, 1, 0, 0, 0, 0, 0, 0]
    assert [r["flag_extreme_scaling"] for r in a] == [0, 0, 1, 0, 1, 0, 1, 0]
    assert [r["flag_extreme_scaling"] for r in b] == [0, 0, 0, 0, 0, 0, 0, 1]
    assert [r["mask_rejected"] for r in b] == [0, 1, 1, 1, 0, 0, 0, 1] and b[0]["log2_ratio"] == 0.0 and b[1]["log2_ratio"] is None


def test_upscaling_invariants(spark):
    scales = spark.createDataFrame([("c", 0, 100, 1.0), ("c", 100, 200, 2.5)], IV + ", own_scale double")
    r = random.Random(2)
    reads = [(f"q{k // 2}", (1024 if k % 3 else 0) | (64 if k % 2 else 128), "c", r.randrange(200), k) for k in range(400)] + [("lone", 0, "c", 5, 400), ("x", 4, None, None, 401), ("y", 256, "c", 1, 402)] + [("t", 0, "c", 150, k) for k in (403, 404, 405)]
    df = spark.createDataFrame(reads, "qname string, flag int, chrom string, pos long, ord long")
    out = upscale.upscaled(df, scales).persist()
    s = upscale.upscale_stats(out).first()
    assert s["processed"] == s["kept_reads"] == len(reads)
    assert {(r["kind"], r["n"]) for r in out.where("copy = 0").groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("passthrough", 2), ("orphan", 2), ("pair", 402)}
    assert out.where("kind = 'pair' and flag & 1024 <> 0").count() == 0
    assert 220 < s["duplicated_reads"] < 380 and s["duplicated_reads"] % 2 == 0
    assert out.where("copy > 0 and qname not like '%:upscale_%'").count() == 0
    t = spark.createDataFrame([(1.0, 0), (1.5, 0), (80.0, 0), (9.0, 1), (None, 0), (0.2, 0)], "depth_scaled_ratio double, mask_rejected int")
    assert [r[0] for r in t.select(upscale.conditioned_scale()).collect()] == [1.0, 1.5, 50.0, 1.0, 1.0, 1.0]


def test_column_rules(spark):
    df = spark.createDataFrame([(None, "M"), (0.0, "chrMT"), (3.0, "22")], "x double, c string")
    assert [r[0] for r in df.select(clip("x", 1.0, 2.0)).collect()] == [None, 1.0, 2.0]
    assert [r[0] for r in df.select(flag(F.col("x") > 1)).collect()] == [0, 0, 1]
    assert [r[0] for r in df.select(is_autosome("c")).collect()] == [True, False, True]
    one = spark.createDataFrame([("/a/b/S1.x_off_target_copy_ratios.tsv",)], "p string")
    assert one.select(track_sample_name("p")).first()[0] == "S1.x"
