"""Near-duplicate detection by SuperMinHash, banding, verification on full sets, and union-find grouping.

A document's set holds the hashes (64 bits) of its distinct word shingles. SuperMinHash gives each element a random order of the
signature's slots and puts, at its j-th slot, j plus a uniform number; a slot keeps the least. As values at step j are
at least j, a document is finished once all its slots hold less than j: most need two or three steps. All elements of many
documents take a step at once.

Documents with equal sets are one class, which its smallest id stands for. Signatures are cut into bands; classes that share
a band meet in a bucket. Enough bands are used that a pair at the threshold is missed with a probability of MISS at most.

In a bucket nobody is compared with everybody at first: each class is compared with one bucket's smallest one (its hub),
that which it meets most often. Then classes that are not yet in one component with a bucket's hub are compared with it. Pairs that the sizes
or sketches of the signatures rule out are left out there. What then still shares a bucket without sharing a component is
compared in blocks, on full sets: groups that buckets join are split by their rarest elements if they are large, and out of a block come only as many
links as join what its links join (fewer than its sets), so that a large group of like but unlinked texts makes no table of pairs. The
links that are left out join what is joined anyway. Every link is confirmed on the full sets; components come from those links.

Null and empty texts have no shingles and are linked with nothing. Rows that repeat an id count as one document with several
texts. Null ids are one id, below all others. Very long texts are hashed in blocks. An empty table gives no rows. Extra columns, whatever their
names, are ignored; kept_documents() carries them along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_groups, small_batches, stored, table, text_of
from .components import components
from .idfilter import bloom, maybe, maybe_in, without
from .words import Words, blocks, mix, trim

NULL_ID = -(1 << 63)
MISS = 1e-6
#: An estimate from sketches counts as hopeless when it is this many standard errors below the threshold.
ERRORS = 5.0
#: Sets, and elements in all of them, that a block has at most on average; columns of a slice of its incidence matrix.
BLOCK_ROWS, BLOCK_ELEMENTS, SLICE = 128, 1 << 21, 1 << 12
#: Cells of the table that orders elements of large groups, and elements that a task counts at once.
CELLS, COUNTED = 1 << 21, 1 << 21
STEP_ELEMENTS = 1 << 15


@dataclass(frozen=True)
class Rule:
    """Shingles of words words; linked with 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    rows: int = 0

    @property
    def band_rows(self) -> int:
        return self.rows or (6 if self.percent >= 83 else 5)

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** self.band_rows)))

    @property
    def slots(self) -> int:
        return self.bands * self.band_rows

    @property
    def hopeless(self) -> float:
        p = self.percent / 100
        p = p + (1 - p) / 256
        return p - ERRORS * math.sqrt(p * (1 - p) / self.slots)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for at, some in blocks(texts):
        words = Words(some)
        for k, a, b in zip(at, words.first[:-1], words.first[1:], strict=True):
            out[k].append(words.hashes[a:b])
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; a text with fewer words has its whole sequence as one."""
    out = []
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(words)]
    for h in word_hashes(texts):
        if len(h) >= words:
            total = h[: len(h) - words + 1] * factors[0]
            for k in range(1, words):
                total = total + h[k : len(h) - words + 1 + k] * factors[k]
            out.append(np.unique(mix(total)))
        elif len(h):
            out.append(mix((h * np.array(factors[: len(h)])).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))))
        else:
            out.append(h)
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """A signature (slots numbers: step in the high, uniform part in the low 24 bits) for each set that isn't empty."""
    out = np.full((len(sets), slots), 0xFFFFFFFF, np.uint32)
    start = 0
    while start < len(sets):
        end, n = start + 1, len(sets[start])
        while end < len(sets) and n + len(sets[end]) <= STEP_ELEMENTS:
            n += len(sets[end])
            end += 1
        _steps(sets[start:end], out[start:end])
        start = end
    return out


def _steps(sets: list[np.ndarray], out: np.ndarray) -> None:
    slots = out.shape[1]
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order, flat = None, out.reshape(-1)
    for step in range(slots):
        if step:
            going = (out >= np.uint32(step << 24)).any(axis=1)[owner]
            if not going.any():
                return
            if order is None:
                elements, owner, first = elements[going], owner[going], at[going]
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
                rows = np.arange(len(elements))
                order[rows, first] = 0
            elif not going.all():
                elements, owner, order = elements[going], owner[going], order[going]
                rows = np.arange(len(elements))
        random = mix(elements + np.uint64((step + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        value = (random >> np.uint64(40)).astype(np.uint32) | np.uint32(step << 24)
        at = step + ((random & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        if step:
            slot = order[rows, at].astype(np.int64)
            order[rows, at] = order[:, step]
        else:
            slot = at
        np.minimum.at(flat, owner * slots + slot, value)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature, with the band's number in it."""
    parts = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def sketches(signatures: np.ndarray) -> np.ndarray:
    """A byte for each slot."""
    return (mix(signatures.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def signed(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits), bands, sketch for each row. To be stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), rule.words)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            bands, sketch = list(keys), list(keys)
            if full:
                signatures = super_minhash([sets[k] for k in full], rule.slots)
                for k, b, s in zip(full, band_keys(signatures, rule.band_rows).view(np.int64), sketches(signatures), strict=True):
                    keys[k] = sets[k].sum(dtype=np.uint64).tobytes() + mix(sets[k] + np.uint64(1)).sum(dtype=np.uint64).tobytes()
                    bands[k], sketch[k] = b, s.tobytes()
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])
        trim()

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def _alike(rule: Rule):
    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        read = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
        return pd.Series((read(a) == read(b)).mean(axis=1))

    return estimate


def _sizes_fit(a: str, b: str, rule: Rule) -> str:
    return f"100 * least({a}, {b}) >= {rule.percent} * greatest({a}, {b})"


def _sets(ids: DataFrame, docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """doc_id, elements: the full sets of the documents in ids (doc_id, distinct, stored). Stored. Texts of others are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(maybe(batch.column(0).to_numpy(), bitmap)))
            sets = shingle_sets(batch.column(1).to_pylist(), rule.words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "elements"])
        trim()

    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(ids))
    out = stored(own.mapInArrow(run, "doc_id long, elements binary").where("length(elements) > 0").join(ids, "doc_id", "left_semi"), "sets")
    shared.destroy()
    return out


def _links(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that the full sets confirm, stored: u, v."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= rule.percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    found = pairs.select("a", "b").join(right, "b").join(left, "a").where(linked("set_a", "set_b"))
    return stored(found.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "links")


def _labels(rows: DataFrame, parts: DataFrame, name: str = "comp") -> DataFrame:
    """rows with the smallest class of the component so far, under that name."""
    return rows.join(parts.toDF("doc_id", name), "doc_id", "left").withColumn(name, F.coalesce(name, "doc_id"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of every two sets: a product of their incidence matrix, in slices, over elements that two have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    column = (np.cumsum(several) - 1)[place]
    keep = several[place]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(several.sum()), SLICE):
        a, b = np.searchsorted(column, [start, start + SLICE])
        matrix = np.zeros((len(sets), SLICE), np.float32)
        matrix[owner[a:b], column[a:b] - start] = 1
        out += matrix @ matrix.T  # counts below 2 ** 24: exact
    return out.astype(np.int64)


def forest(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components in a block, as few as join all that its links join."""
    both, n = common_counts(sets), np.array([len(s) for s in sets])
    hit = np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1) & (comp[:, None] != comp[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _block_links(dealt: DataFrame, rule: Rule) -> DataFrame:
    """u, v: a forest of links of each block. dealt: group, i, j, doc_id, comp, elements; a block is one of (group, i, j)."""
    names = ["group", "i", "j", "doc_id", "comp", "elements"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            found = []
            if len(rows) > 1 and len({c for _, c, _ in rows}) > 1:
                ids, comp = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:2])
                found = forest(ids, comp, [np.frombuffer(x, np.uint64) for *_, x in rows], rule.percent)
            return pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], pa.int64()), pa.array([min(x) for x in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for *block, doc, comp, elements in zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True):
                if block != now:
                    yield done()
                    now, rows = block, []
                rows.append((doc, comp, elements))
        yield done()
        trim()

    return dealt.select(names).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "u long, v long")


def _levels(rows: DataFrame) -> np.ndarray:
    """For each cell (the low bits of an element's hash) how often its most frequent element stands in rows, as a logarithm: 0 for once.

    At most CELLS cells: where more elements share one, sets share more of their rarest elements, and groups are split less.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting += [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
            n += sum(map(len, waiting[-batch.num_rows :]))
            if n > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(waiting), return_counts=True)], names=["e", "times"])
                waiting, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(waiting), return_counts=True)], names=["e", "times"])

    often = stored(rows.select("elements").mapInArrow(count, "e long, times long").groupBy("e").agg(F.sum("times").alias("times")).where("times > 1"), "often")
    cells = min(CELLS, 1 << max(10, (16 * often.count()).bit_length()))
    found = often.groupBy(F.col("e").bitwiseAND(F.lit(cells - 1)).alias("cell")).agg(F.max(F.floor(F.log2("times"))).cast("int").alias("level")).toPandas()
    drop(often)
    out = np.zeros(cells, np.uint8)
    out[found["cell"].to_numpy(np.int64)] = found["level"].to_numpy(np.int64)
    return out


def first_elements(elements: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Of a set the first n - ceil(p * n) + 1 elements by level and hash, less those that no other set has."""
    own = levels[(elements & np.uint64(len(levels) - 1)).astype(np.int64)]
    order = np.lexsort((elements, own))[: len(elements) - -(-percent * len(elements) // 100) + 1]
    return elements[order[own[order] > 0]]


def _split(rows: DataFrame, rule: Rule) -> DataFrame:
    """rows (doc_id, group, elements) of groups that are too large, with smaller groups: linked sets stay together.

    Elements are in one order for all sets, by how many sets have them (roughly), rarest first. Two linked sets share one of either's first
    n - ceil(p * n) + 1 elements, as what follows is too little to share. Sets that share such an element, or share it with the same third one, stay in one group.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_levels(rows))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            found = [first_elements(np.frombuffer(x, np.uint64), levels, rule.percent) for x in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["doc_id", "group", "e"])

    first = stored(rows.select("doc_id", "group", "elements").mapInArrow(heads, "doc_id long, group long, e long"), "prefixes")
    hubs = first.groupBy("group", "e").agg(F.min("doc_id").alias("v"), F.count("*").alias("times")).where("times > 1").select("group", "e", "v")
    parts = components(first.join(hubs, ["group", "e"]).select(F.col("doc_id").alias("u"), "v").where("u > v").distinct())
    drop(first)
    return _labels(rows.drop("group"), parts, "group")


def _rest_links(rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links among classes that still share a bucket without sharing a component. rows: doc_id, comp, hub, n_shingles for each of their buckets.

    Classes that buckets join, directly or through others, are a group. Large groups are split by their rarest elements. A group is then one block,
    or, if it is large still, several, of which every two meet. Of a block, as few links come out as join what its links join.
    """
    groups = components(rows.select(F.col("doc_id").alias("u"), F.col("hub").alias("v")).where("u <> v").distinct())
    classes = stored(_labels(rows.select("doc_id", "comp", "n_shingles").distinct(), groups, "group"), "grouped")

    def sized(x: DataFrame) -> DataFrame:
        per = x.groupBy("group").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        return per.select("group", F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_ELEMENTS)).cast("int").alias("g"))

    sizes = stored(sized(classes), "sizes")
    mine = classes.join(sizes, "group").join(sets, "doc_id")
    small, large = mine.where("g = 1"), mine.where("g > 1")
    if sizes.where("g > 1").head(1):
        again = stored(_split(large.select("doc_id", "group", "elements"), rule).select("doc_id", "group"), "split")
        named = stored(classes.drop("group").join(again, "doc_id"), "regrouped")
        small = small.unionByName(named.join(sized(named), "group").join(sets, "doc_id"))
    own = small.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = own.withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")})
    return stored(_block_links(dealt, rule), "links")


def grouped(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    all_rows = stored(signed(docs, rule, id_col, text_col), "signed")
    full = all_rows.where("n_shingles > 0")
    classes = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "classes")
    # One row for each class. Its key holds the id, so that no class, however large, meets in one task.
    heads = full.join(classes.select("set_key", F.col("first").alias("doc_id")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
    heads = stored(heads.select("doc_id", "n_shingles", "bands", "sketch"), "heads")
    seen = heads.select("doc_id", "n_shingles", "sketch")
    # Buckets of several classes, and their members, once for all that follows.
    each = heads.select("doc_id", F.explode("bands").alias("key"))
    buckets = stored(each.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"), "buckets")
    members = stored(each.where(maybe_in(buckets.select("key"))("key")).join(buckets, "key").select("doc_id", "hub"), "members")
    sets = _sets(stored(members.select("doc_id").distinct(), "ids"), docs, rule, id_col, text_col)

    def plausible(pairs: DataFrame) -> DataFrame:
        """a, b, less those that sizes or sketches rule out."""
        left, right = seen.toDF("a", "n_a", "sketch_a"), seen.toDF("b", "n_b", "sketch_b")
        near = pairs.join(right, "b").join(left, "a").where(_sizes_fit("n_a", "n_b", rule))
        return near.where(_alike(rule)("sketch_a", "sketch_b") >= rule.hopeless).select("a", "b")

    # First each class with the hub that it meets most often.
    met = stored(members.where("doc_id <> hub").groupBy(F.col("doc_id").alias("b"), F.col("hub").alias("a")).agg(F.count("*").alias("times")), "met")
    first = met.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a"))
    links = _links(plausible(first), sets, rule)
    parts = components(links)
    # Then with each hub of another component.
    comp = stored(_labels(seen.select("doc_id", "n_shingles").join(sets.select("doc_id"), "doc_id", "left_semi"), parts), "labels")
    apart = met.join(comp.select(F.col("doc_id").alias("b"), F.col("comp").alias("x")), "b").join(comp.select(F.col("doc_id").alias("a"), F.col("comp").alias("y")), "a").where("x <> y")
    second = stored(plausible(apart.join(first, ["a", "b"], "left_anti").select("a", "b")), "second")
    if second.head(1):
        links = links.unionByName(_links(second, sets, rule))
        parts = components(links)
        comp = stored(_labels(comp.drop("comp"), parts), "labels")
    # Last, classes that still share a bucket without sharing a component.
    own = members.join(comp, "doc_id")
    split = own.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count_distinct("doc_id").alias("n")).where("low <> high and n > 2")
    split = stored(split.select("hub"), "open")
    if split.head(1):
        rest = _rest_links(stored(own.join(split, "hub").select("doc_id", "comp", "hub", "n_shingles").distinct(), "rest"), sets, rule)
        if rest.head(1):
            links = links.unionByName(rest)
            parts = components(links)
    named = stored(_labels(classes.withColumnRenamed("first", "doc_id"), parts).select("set_key", "rows", F.col("comp").alias("component_id")), "named")
    out = join_groups(full.select("set_key", "doc_id", "n_shingles"), named, ["set_key"], "rows", full.count()).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(all_rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    drop(heads, buckets, members, sets, met)
    null = lambda c: F.nullif(F.col(c), F.lit(NULL_ID)).alias(c)
    return out.select(null("doc_id"), "n_shingles", null("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group. Only rows whose id may be dropped are shuffled."""
    rows = grouped(docs, rule or Rule(), id_col, text_col)
    dropped = stored(rows.where("not kept and doc_id is not null").select("doc_id"), "dropped")
    return without(docs, dropped.distinct(), id_col)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents").select("doc_id", "text"), Rule(words=3, percent=85))
