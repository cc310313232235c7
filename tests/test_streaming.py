"""The streaming upscaler: against the batch, against a plain cache, across restarts; eviction by count and by time, late mates, the end."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import upscale
from tidemark.streaming.upscaling import remaining, upscaled_stream

READS = "qname string, flag int, chrom string, pos long, ord long, tags string, big long"


@pytest.fixture
def track(spark):
    return spark.createDataFrame([("c", 0, 100, 2.5), ("c", 50, 200, 3.0), ("c", 300, 400, 1.25), ("d", 0, 1000, 1.0)], "chrom string, start long, end long, own_scale double")


def some_reads(seed, n, names):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        aside = r.choice((0, 0, 0, 0, 4, 256, 2048))
        chrom = r.choice(("c", "c", "d", "e", None))
        rows.append((r.choice(names), aside | r.choice((64, 128)) | r.choice((0, 1024)), chrom, r.randrange(500) if chrom else None, k, r.choice((None, "", 'a "quoted"\ttext é')), r.choice((None, (1 << 62) + k))))
    return rows


class Stream:
    def __init__(self, spark, folder, track, **options):
        self.spark, self.folder, self.n = spark, folder, 0
        spark.createDataFrame([], READS).write.parquet(f"{folder}/in")
        self.out = upscaled_stream(spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), track, buckets=options.pop("buckets", 1), **options)

    def write(self, rows):
        self.spark.createDataFrame(rows, READS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def start(self, **trigger):
        return self.out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(**trigger).start()

    def deliver(self, rows):
        self.write(rows)
        self.start(availableNow=True).awaitTermination()

    def given(self):
        return self.spark.read.schema(self.out.schema).parquet(f"{self.folder}/out")

    def left(self):
        return remaining(self.spark, f"{self.folder}/state", self.spark.createDataFrame([], READS).schema)


def sorted_rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_equals_the_batch_over_deliveries(spark, tmp_path, track):
    rows = some_reads(1, 400, [f"q{k}" for k in range(90)] + ["hot"] * 40 + [None])
    s = Stream(spark, str(tmp_path), track, limit=1 << 40, buckets=3)
    for part in (rows[:150], rows[150:151], rows[151:]):
        s.deliver(part)
    both = s.given().unionByName(s.left())
    want = upscale.upscaled(spark.createDataFrame(rows, READS), track, draw="ord")
    assert sorted_rows(both) == sorted_rows(want.select(both.columns))
    assert both.where("copy = 0").count() == len(rows)
    assert s.left().where("kind <> 'orphan'").count() == 0 and s.left().count() > 0


def plain_cache(rows, limit, evict):
    """{ord: (kind, ord of the mate)} by one cache, oldest out first; what waits at the end apart."""
    cache, out = {}, {}
    for q, flag, chrom, _, order, *_ in rows:
        if flag & (4 | 256 | 2048) or chrom is None:
            out[order] = ("passthrough", None)
        elif q in cache:
            mate = cache.pop(q)
            out[order], out[mate] = ("pair", mate), ("pair", order)
        else:
            cache[q] = order
        if len(cache) > limit:
            for old in list(cache)[:evict]:
                out[cache.pop(old)] = ("orphan", None)
    return out, sorted(cache.values())


def test_count_eviction_and_late_mates(spark, tmp_path, track):
    rows = some_reads(2, 300, [f"q{k}" for k in range(60)])
    want, waiting = plain_cache(rows, 12, 5)
    s = Stream(spark, str(tmp_path), track, limit=12, evict=5)
    for k in range(0, 300, 100):
        s.deliver(rows[k : k + 100])
    given = s.given().where("copy = 0").collect()
    assert {r.ord: r.kind for r in given} == {o: kind for o, (kind, _) in want.items()} and len(given) == len(want)
    assert sum(kind == "orphan" for kind, _ in want.values()) > 10
    assert sorted(r.ord for r in s.left().collect()) == waiting and len(waiting) <= 12
    assert len(given) + len(waiting) == 300
    # Evicted records keep their duplicate bit, pairs lose it; copies have names of their own.
    flags = {r[4]: r[1] for r in rows}
    assert all(r.flag == (flags[r.ord] & ~1024 if r.kind == "pair" else flags[r.ord]) for r in given)
    copies = s.given().where("copy > 0").collect()
    assert copies and all(r.kind == "pair" and r.qname.endswith(f":upscale_{r.copy}") for r in copies)
    # Both records of a pair have the same copies, the one that is read 1 of the later record first.
    by_pair = {}
    for r in given:
        if r.kind == "pair":
            by_pair.setdefault(min(r.ord, want[r.ord][1]), {})[r.ord] = r.mate
    assert all(m == ({min(m): 2, max(m): 1} if flags[max(m)] & 64 else {min(m): 1, max(m): 2}) for m in by_pair.values())


def test_timer_and_mate_behind_it(spark, tmp_path, track):
    s = Stream(spark, str(tmp_path), track, timeout_ms=1500)
    s.write([("a", 64, "c", 5, 0, None, None), ("b", 64, "c", 5, 1, None, None), ("b", 128, "c", 5, 2, None, None)])
    q = s.start(processingTime="300 milliseconds")

    def wait(n):
        end = time.time() + 90
        while time.time() < end and s.given().where("copy = 0").count() < n:
            assert q.exception() is None
            time.sleep(0.5)
        return {r.ord: r.kind for r in s.given().where("copy = 0").collect()}

    assert wait(3) == {0: "orphan", 1: "pair", 2: "pair"}
    s.write([("a", 128, "c", 5, 3, None, None)])
    assert wait(4) == {0: "orphan", 1: "pair", 2: "pair", 3: "orphan"}
    q.stop()
    assert s.left().count() == 0


def test_nothing_and_no_windows(spark, tmp_path, track):
    s = Stream(spark, str(tmp_path), track.where("false"), limit=10)
    s.deliver([])
    s.deliver([("a", 64, "c", 5, 0, None, None), ("a", 128, "c", 5, 1, None, None)])
    assert [(r.qname, r.copy) for r in s.given().orderBy("ord").collect()] == [("a", 0), ("a", 0)] and s.left().count() == 0


def test_lookup_of_piled_windows(spark):
    """Many windows over one place: the first by start and end counts, and a bin's array stays short."""
    from tidemark.operators import intervals

    r = random.Random(4)
    windows = [("c", a, a + r.randrange(0, 400), float(k)) for k, a in enumerate(r.randrange(0, 60) for _ in range(3000))] + [("c", 0, 5, None)]
    w = spark.createDataFrame(windows, "chrom string, start long, end long, v double")
    points = spark.createDataFrame([("c", p) for p in range(0, 500, 3)] + [(None, 1), ("c", None), ("x", 1)], "chrom string, pos long")
    bins = intervals.packed_bins(w, "v", 20)
    assert bins.agg(F.max(F.size("windows"))).first()[0] <= 20

    def plain(chrom, p):
        found = [x for x in windows if chrom == x[0] and p is not None and x[1] <= p < x[2]]
        best = min(found, key=lambda x: (x[1], x[2], x[3] is not None, x[3] or 0), default=None)
        return 1.5 if best is None or best[3] is None else best[3]

    got = intervals.point_lookup(points, w, "v", 1.5, 20).collect()
    assert all(x.v == plain(x.chrom, x.pos) for x in got) and len(got) == 170


def test_pairs_need_one_sort(spark, track):
    """Scales, order and draws of pairs come from neighbours, so that a name's records are sorted once."""
    reads = spark.createDataFrame(some_reads(5, 30, ["a", "b"]), READS)
    lines = upscale.upscaled(reads, track, draw="ord")._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Sort [qname" in x for x in lines) == 1


def test_buckets_grow_with_the_reads(spark, monkeypatch):
    from tidemark.plans import queries

    seen, d = [], "/root/testdata/sf0.001"

    def noted(*args, **options):
        seen.append(options["buckets"])
        raise InterruptedError

    monkeypatch.setattr(queries, "upscaled_stream", noted)
    n = spark.read.parquet(f"{d}/lineitem.parquet").count()
    for rows, want in ((n, 32), (50, -(-n // 50))):
        monkeypatch.setattr(queries, "BUCKET_READS", rows)
        with pytest.raises(InterruptedError):
            queries.QUERIES["stream_upscale"](spark, d)
        assert seen.pop() == want
