"""Distributed forms of merge, subtract, depth and interpolation: against plain loops, with one hot bin, and the plans they must have."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, intervals, smooth

IV = "chrom string, start long, end long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_merge(rows):
    out = []
    for c, a, b in sorted(rows):
        if out and out[-1][0] == c and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([c, a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_merge_over_bins(spark, seed):
    r = random.Random(seed)
    rows = [("c", a, a + r.choice((0, 1, 5, 16, 40, 200))) for a in (r.randrange(900) for _ in range(r.choice((5, 60, 150))))]
    rows += [("d", 16 * k, 16 * k + 16) for k in range(8)]  # bins that touch one another, each full
    rows += [("d", 160, 170), ("d", 170, 180), ("d", 192, 192), ("d", 176, 192), ("e", 0, 1000), ("e", 3, 4), ("e", 1000, 1001), ("f", 32, 32)]
    df = spark.createDataFrame(rows, IV)
    for size in (16, 64, 1 << 20):
        assert sorted(map(tuple, intervals.merge(df, bin_size=size).select("chrom", "start", "end").collect())) == plain_merge(rows)
    keyed = df.withColumn("k", F.col("start") % 3)
    got = sorted(map(tuple, intervals.merge(keyed, ["k", "chrom"], 16).select("k", "chrom", "start", "end").collect()))
    assert got == sorted((k, *x) for k in range(3) for x in plain_merge([y for y in rows if y[1] % 3 == k]))


def test_merge_adds_up_before_the_exchange(spark):
    hot = spark.range(200_000).selectExpr("'c' AS chrom", "id % 50 AS start", "id % 50 + id % 7 AS end")
    merged = intervals.merge(hot)
    assert [tuple(x) for x in merged.select("chrom", "start", "end").collect()] == [("c", 0, 55)]
    lines = [x.strip() for x in plan(merged).split("\n")]
    first = max(k for k, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    assert "HashAggregate" in lines[first + 1] and "partial_max" in lines[first + 1]


def plain_subtract(windows, mask):
    out = []
    for c, a, b in windows:
        for m in sorted(x for x in mask if x[0] == c):
            if m[2] > a and m[1] < b and m[2] > m[1]:
                if m[1] > a:
                    out.append((c, a, m[1]))
                a = max(a, m[2])
        if a < b:
            out.append((c, a, b))
    return sorted(out)


def test_subtract_over_bins(spark):
    r = random.Random(3)
    mask = plain_merge([("c", a, a + r.choice((0, 1, 9, 50))) for a in (r.randrange(600) for _ in range(40))] + [("d", 16, 32), ("d", 48, 64)])
    windows = [("c", a, a + r.choice((1, 10, 33, 300, 700))) for a in (r.randrange(600) for _ in range(60))] + [("d", 0, 80), ("d", 0, 80), ("d", 16, 32), ("e", 5, 90), ("e", 7, 7)]
    w, m = spark.createDataFrame(windows, IV), spark.createDataFrame(mask, IV)
    want = plain_subtract([x for x in windows if x[1] < x[2]], mask)
    for size in (16, 100, 5000):
        assert sorted(map(tuple, intervals.subtract(w, m, size).collect())) == want
    assert sorted(map(tuple, intervals.subtract(w, m.where("false"), 16).collect())) == sorted(x for x in windows if x[1] < x[2])


def test_depth_of_a_pile_up(spark):
    """100,000 reads on one bin, mates that overlap, reads over bins, and windows that overlap one another."""
    r = random.Random(5)
    some = [(f"s{k % 2}", f"q{k // 2}", 0, "c", r.randrange(900), 60, r.choice(("10M", "5M3D4M", "3S20M", "8M100N8M", "50M"))) for k in range(600)]
    hot = spark.range(100_000).selectExpr("'s0' AS sample", "concat('h', id) AS qname", "0 AS flag", "'c' AS chrom", "300 + id % 3 AS pos", "60 AS mapq", "'10M' AS cigar")
    reads = spark.createDataFrame(some, "sample string, qname string, flag int, chrom string, pos long, mapq int, cigar string").unionByName(hot)
    places = [("w0", "c", 0, 100), ("w1", "c", 100, 305), ("w2", "c", 302, 303), ("w3", "c", 250, 1100), ("w4", "c", 0, 5), ("w5", "d", 0, 10)]
    windows = spark.createDataFrame(places, "window_id string, chrom string, start long, end long")
    sum_ = {s: np.zeros(1200, np.int64) for s in ("s0", "s1")}
    covered = {}
    for s, q, _, _, pos, _, cigar in some:
        own = covered.setdefault((s, q), np.zeros(1200, bool))
        for n, op in {"10M": [(10, "M")], "5M3D4M": [(5, "M"), (3, "D"), (4, "M")], "3S20M": [(20, "M")], "8M100N8M": [(8, "M"), (100, "N"), (8, "M")], "50M": [(50, "M")]}[cigar]:
            if op == "M":
                own[pos : pos + n] = True
            pos += n
    for (s, _), own in covered.items():
        sum_[s] += own
    for k in range(3):
        sum_["s0"][300 + k : 310 + k] += 100_000 // 3 + (k < 100_000 % 3)
    for size in (64, 5000):
        depth = coverage.window_depth(reads, windows, ["s0", "s1"], bin_size=size)
        got = {(x["sample"], x.window_id): x.depth for x in depth.collect()}
        want = {(s, w): sum_[s][a:b].mean() if c == "c" else 0.0 for s in sum_ for w, c, a, b in places}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    rounded = coverage.window_depth(reads, windows, ["s0", "s1"], decimals=2).collect()
    assert all(x.depth == round(x.depth, 2) and abs(x.depth - want[x["sample"], x.window_id]) <= 0.005 + 1e-9 for x in rounded)
    lines = [x.strip() for x in plan(depth).split("\n")]
    at = next(k for k, x in enumerate(lines) if "partial_sum" in x and "step" in x and "bases" not in x and "end" not in x.split("functions=")[1])
    assert "Exchange hashpartitioning(sample" in "".join(lines[at - 2 : at])


def test_interpolation_by_ranges(spark):
    r = random.Random(7)
    curves = {s: sorted({round(r.uniform(lo, hi), 4) for _ in range(n)}) for s, lo, hi, n in (("a", 0.3, 0.6, 300), ("b", -0.5, 1.5, 7), ("c", 0.41, 0.42, 1), ("e", 0.1, 0.11, 40))}
    fits = {s: [r.uniform(0, 3) for _ in xs] for s, xs in curves.items()}
    curve = spark.createDataFrame([(s, x, y) for s in curves for x, y in zip(curves[s], fits[s], strict=True)], "sample string, gc double, fit double").repartition(3)
    gcs = [r.uniform(-1, 2) for _ in range(200)] + [x for xs in curves.values() for x in xs] + [0.0, 1.0, 0.5, None, float("nan")]
    queries = [(s, g, k, None if k % 2 else 1 << 60, [k]) for s in (*curves, "d") for k, g in enumerate(gcs)]
    df = spark.createDataFrame(queries, "sample string, gc double, k int, big long, extra array<int>")
    for ranges in (1, 16, 256):
        got = {(x["sample"], x.k): x for x in smooth.interpolated(df, curve, ranges).collect()}
        assert len(got) == len(queries)
        for s, g, k, big, extra in queries:
            want = None if g is None or g != g or s == "d" else float(np.interp(g, curves[s], fits[s]))
            x = got[s, k]
            assert (x.fit is None) == (want is None) and (want is None or abs(x.fit - want) < 1e-12) and x.big == big and x.extra == extra


def test_region_files(spark, tmp_path):
    """Depth regions of many files, with and without names, and blank depths."""
    import gzip

    from tidemark.sources import tables

    for name, text in (("s1_mosdepth.regions.bed.gz", "c\t0\t100\tw\t1.25\nc\t100\t200\tv\tnan\n"), ("s2.x_mosdepth.regions.bed.gz", "c\t0\t100\t3.5\n\nd\t5\t9\t0\n")):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    got = sorted(map(tuple, tables.read_regions(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("c", 0, 100, "w", 1.25, "s1"), ("c", 100, 200, "v", None, "s1"), ("c", 0, 100, "c:0-100", 3.5, "s2"), ("d", 5, 9, "d:5-9", 0.0, "s2")], key=str)


def test_range_finder_equals_svd(spark, monkeypatch):
    """Many samples, few components: several passes give the singular vectors; cells that are missing count as 0."""
    from tidemark.operators import panel

    r = np.random.default_rng(2)
    m, n, k = 60, 200, 3
    w = 1 + r.normal(0, 0.02, (n, m)) + sum(2.0**-j * np.outer(r.normal(0, 1, n), r.normal(0, 1, m)) for j in range(k))
    df = spark.createDataFrame([(f"s{j:02d}", f"w{i:03d}", float(w[i, j])) for i in range(n) for j in range(m)], "sample string, window_id string, depth double").repartition(5)
    monkeypatch.setattr(panel, "CELLS", 1000)
    c = w - w.mean(axis=1, keepdims=True)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    want = w - (u[:, :k] * s[:k]) @ v[:k]
    got = np.array([x["denoised"] for x in panel.denoised(df, k).orderBy("window_id", "sample").collect()]).reshape(n, m)
    assert np.allclose(got, want, atol=1e-8, rtol=0)
    scores, cov = c @ v[:k].T, np.cov(c.T, bias=True)
    assert abs(panel.explained_variance(df, k) - 100 * scores.var(axis=0).sum() / np.trace(cov)) < 1e-6
    nulls = df.withColumn("depth", F.expr("if(hash(sample, window_id) % 9 <> 0, depth, null)"))
    assert panel.denoised(nulls, k).where("(denoised is null) <> (depth is null)").count() == 0
    holes = df.where("hash(sample, window_id) % 9 <> 0")
    cells = {(x.window_id, x["sample"]): x.depth for x in holes.collect()}
    own = np.array([[cells.get((f"w{i:03d}", f"s{j:02d}"), np.nan) for j in range(m)] for i in range(n)])
    mean = np.nanmean(own, axis=1, keepdims=True)
    x = np.nan_to_num(own - mean)
    v = np.linalg.svd(x, full_matrices=False)[2][:k]
    rest = x - x @ v.T @ v + mean
    full = {(y.window_id, y["sample"]): y.denoised for y in panel.denoised(nulls, k).collect() if y.denoised is not None}
    got = panel.denoised(holes, k).collect()
    assert len(full) == len(got) and max(abs(full[y.window_id, y["sample"]] - y.denoised) for y in got) < 1e-8
    assert len(got) == len(cells) and max(abs(y.denoised - rest[int(y.window_id[1:]), int(y["sample"][1:])]) for y in got) < 1e-8


@pytest.mark.parametrize(("enough", "buckets"), [(1 << 16, 4096), (3, 4), (1, 2)])
def test_exact_quantiles(spark, enough, buckets):
    """Ties, one value, outliers, negative numbers, nulls and NaN, null keys; refined down to single buckets, or put in order at once."""
    from tidemark.functions.quantiles import exact_quantiles

    r = np.random.default_rng(4)
    groups = {"a": r.normal(0, 1, 301), "b": np.repeat(5.0, 50), "c": np.r_[r.integers(0, 4, 200), 1e300, -1e300], "d": np.array([2.5]), "e": np.array([1.0, 2.0]), None: r.exponential(1, 77), "f": np.zeros(0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("f", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3).persist()
    for q in (0.5, 0.99, 0.0):
        got = {x.k: x.out for x in exact_quantiles(df, ["k"], "v", q, "out", enough, buckets).collect()}
        assert got.keys() == groups.keys() - {"f"}
        for k, x in got.items():
            want = float(np.percentile(groups[k], 100 * q))
            assert abs(x - want) <= 1e-12 * max(1, abs(want)), (k, q)
    every = np.concatenate(list(groups.values()))
    assert abs(exact_quantiles(df, [], "v", 0.25, "out", enough, buckets).first()[0] - np.percentile(every, 25)) < 1e-12
    assert exact_quantiles(df.where("false"), ["k"], "v", 0.5, "out").count() == 0
    with pytest.raises(ValueError, match="infinite"):
        exact_quantiles(spark.createDataFrame([("a", float("inf"))], "k string, v double"), ["k"], "v", 0.5, "out")


@pytest.mark.parametrize("seed", range(3))
def test_pieces_apart_cover_the_same(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(("c", "d", None)), a, a + r.choice((0, 1, 5, 30))) for a in (r.randrange(200) for _ in range(80))] + [("c", None, 5), ("c", 5, None)]
    pieces = [tuple(x) for x in intervals.apart(spark.createDataFrame(rows, IV).repartition(3), ["chrom"]).collect()]
    covered = [(c, p) for c, a, b in pieces for p in range(a, b)]
    assert len(covered) == len(set(covered)) and set(covered) == {(c, p) for c, a, b in rows if a is not None and b is not None for p in range(a, b)}


def test_depth_adds_nothing_up_by_name(spark):
    """The task that has the reads by name sorts them, and sums only what it sends on."""
    reads = spark.createDataFrame([("s0", "q", 0, "c", 5, 60, "10M")], "sample string, qname string, flag int, chrom string, pos long, mapq int, cigar string")
    windows = spark.createDataFrame([("w", "c", 0, 100)], "window_id string, chrom string, start long, end long")
    depth = coverage.window_depth(reads, windows, ["s0"])
    assert not any("Aggregate" in x and "qname" in x for x in plan(depth).split("\n")) and depth.first().depth == 0.1


def test_blocks_of_single_operations(spark):
    cigars = ["10M", "7=", "0M", "3M\n", "5X", "5I", "2M2M", "", None, "4S6M", "012M"]
    reads = spark.createDataFrame([(k, 100, c) for k, c in enumerate(cigars)], "k int, pos long, cigar string")
    got = sorted(map(tuple, coverage.aligned_blocks(reads).select("k", "start", "end").collect()))
    assert got == [(0, 100, 110), (1, 100, 107), (2, 100, 100), (3, 100, 103), (4, 100, 105), (6, 100, 102), (6, 102, 104), (9, 100, 106), (10, 100, 112)]


def test_partitions_grow_with_the_reads(spark, monkeypatch):
    from tidemark.functions import reuse
    from tidemark.plans import queries

    key, seen, before = "spark.sql.shuffle.partitions", [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(queries, "reused", lambda df: seen.append(int(spark.conf.get(key))) or reuse.reused(df))
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for rows in (n, n // 50):
        monkeypatch.setattr(reuse, "TASK_ROWS", rows)
        seen.clear()
        queries.QUERIES["matching_samples"](spark, "/root/testdata/sf0.001")
        assert seen and set(seen) == {int(before) if rows == n else -(-n // rows)} and spark.conf.get(key) == before
    with pytest.raises(KeyError), reuse.partitions_for(spark, 10**9):
        raise KeyError
    assert spark.conf.get(key) == before


def test_tasks_are_put_together_to_one_size_however_few_the_rows(spark):
    """With many shuffle partitions a task would grow with the input up to the session's size."""
    from tidemark.functions import reuse

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    for own, want in (("64m", reuse.TASK_BYTES), ("1m", "1m")):
        spark.conf.set(key, own)
        with reuse.partitions_for(spark, 1):
            assert spark.conf.get(key) == want
        assert spark.conf.get(key) == own
    spark.conf.set(key, before)


def test_a_task_of_a_stored_table_has_few_rows(spark):
    """So few that no sort or hash table of a task outgrows its first page; 500,000 rows did."""
    from tidemark.functions import reuse

    n = 2_000_000
    with reuse.partitions_for(spark, n):
        made = reuse.reused(spark.range(n, numPartitions=2).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).groupBy("k").agg(F.count("*").alias("c")))
    assert made.count() == n
    assert made.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 300_000


def test_stored_tables_that_grow_with_the_input_are_not_broadcast(spark, monkeypatch):
    """A small file of windows is many times as large in the memory of each task."""
    from tidemark.plans import queries

    key, seen, reused = "spark.sql.autoBroadcastJoinThreshold", [], queries.reused
    before = spark.conf.get(key)

    def noted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((spark.conf.get(key), "BroadcastHashJoin" in plan))
        return reused(df)

    monkeypatch.setattr(queries, "reused", noted)
    right = spark.range(100_000).select("id", F.lit("w").alias("window_id"))
    wide = queries._once(lambda spark, d: spark.range(1_000_000).join(right, "id"))
    monkeypatch.setattr(queries, "_MADE", {})
    monkeypatch.setattr(queries, "_N_READS", {})
    assert wide(spark, "/root/testdata/sf0.001").count() == 100_000
    assert seen == [("256k", False)] and spark.conf.get(key) == before
    spark.conf.set(key, "-1")
    try:
        with queries.partitions_for(spark, 1):
            assert spark.conf.get(key) == "-1"
    finally:
        spark.conf.set(key, before)
