"""Panel of normals: low-rank bias removed from the normals' matrix, and a median and variance for each window.

With rows centred, only the top right singular vectors matter. A randomised range finder finds them by passes over the windows, each linear in the
samples; no matrix of samples by samples is made. The driver sees samples x (components + EXTRA) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.reuse import reused
from ..params import DEFAULT

#: Variances below this are rounding noise.
NOISE = 1e-18
#: Random vectors beside the components sought, passes at most, and the relative residual at which the components hold still.
EXTRA, PASSES, STILL = 10, 40, 1e-11
#: Numbers of a block's matrix.
CELLS = 1 << 21


def components_to_remove(samples: int, k: int) -> int:
    """k, or all but one if there are no more samples than that; fewer than two samples are an error."""
    if samples < 2:
        raise ValueError("a panel needs at least two samples")
    return k if k < samples else max(1, samples - 1)


def row_centred(rows: DataFrame, value: str = "depth") -> DataFrame:
    """rows with row_mean (over the window's samples) and off, the distance to it."""
    mean = F.avg(value).over(Window.partitionBy("window_id"))
    return rows.withColumn("row_mean", mean).withColumn("off", F.col(value) - F.col("row_mean"))


def _by_window(centred: DataFrame) -> DataFrame:
    """window_id, samples (in order), offs (their distances), row_mean."""
    cells = F.sort_array(F.collect_list(F.struct("sample", "off", "row_mean")))
    return centred.groupBy("window_id").agg(cells.alias("cells")).select("window_id", F.col("cells.sample").alias("samples"), F.col("cells.off").alias("offs"), F.col("cells.row_mean")[0].alias("row_mean"))


def _sample_names(windows: DataFrame) -> list[str]:
    return sorted(r[0] for r in windows.select(F.explode("samples")).distinct().collect())


def _blocks(batch: pa.RecordBatch, names: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch as matrices of at most CELLS numbers, missing and null cells 0: first and last row, matrix; row, column and whether it is null, of each cell."""
    samples, offs = batch.column("samples"), batch.column("offs")
    bounds = offs.offsets.to_numpy().astype(np.int64)
    column = pc.index_in(samples.flatten(), value_set=names).to_numpy(zero_copy_only=False)
    value = offs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    null = np.isnan(value)
    value = np.where(null, 0.0, value)
    bounds = bounds - bounds[0]
    step = max(1, CELLS // len(names))
    for a in range(0, len(batch), step):
        b = min(a + step, len(batch))
        own = slice(bounds[a], bounds[b])
        row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        matrix = np.zeros((b - a, len(names)))
        matrix[row, column[own]] = value[own]
        yield a, b, matrix, row, column[own], null[own]


def products(windows: DataFrame, names: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """With X the matrix of windows by samples: X' X vectors, the columns' sums and sums of squares, and the number of windows.

    Each partition adds up products of its blocks, in time linear in the samples, and gives a row for each sample.
    """
    values, n = pa.array(names, pa.string()), vectors.shape[1]
    schema = ", ".join(["place int", *(f"v{j} double" for j in range(n + 2))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names) + 1, n + 2))
        for batch in batches:
            for a, b, x, *_ in _blocks(batch, values):
                total[:-1, :n] += x.T @ (x @ vectors)
                total[:-1, n] += x.sum(axis=0)
                total[:-1, n + 1] += (x * x).sum(axis=0)
                total[-1, 0] += b - a
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(names) + 1, dtype=np.int32)} | {f"v{j}": total[:, j] for j in range(n + 2)})

    found = windows.select("samples", "offs").mapInArrow(run, schema).groupBy("place").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(n + 2)])
    out = np.zeros((len(names) + 1, n + 2))
    for row in found.collect():  # a row for each sample
        out[row[0]] = row[1:]
    return out[:-1, :n], out[:-1, n], out[:-1, n + 1], float(out[-1, 0])


def top_components(windows: DataFrame, names: list[str], k: int, seed: int = DEFAULT.seed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """The top k right singular vectors, as columns, X' X times them, and the rest of products().

    A randomised range finder: a random subspace of k + EXTRA vectors is multiplied by X' X and made orthonormal again, a pass over the stored windows
    each time, until its best k vectors hold still; with no more samples than that it is the whole space, and one pass is exact.
    """
    m = len(names)
    k = components_to_remove(m, k)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, min(m, k + EXTRA))))[0]
    for _ in range(PASSES):
        moved, sums, squares, n = products(windows, names, basis)
        inner = basis.T @ moved
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn, values = turn[:, ::-1][:, :k], values[::-1][:k]
        best, image = basis @ turn, moved @ turn
        if np.linalg.norm(image - best * values) <= STILL * max(values[0], 1e-300) or basis.shape[1] == m:
            break
        basis = np.linalg.qr(moved)[0]
    return best, image, sums, squares, n


def explained_variance(rows: DataFrame, k: int = DEFAULT.components, value: str = "depth") -> float:
    """Per cent of the columns' variance that the scores on the removed components have."""
    windows = reused(_by_window(row_centred(rows, value)))
    best, image, sums, squares, n = top_components(windows, _sample_names(windows), k)
    total = float((squares / n - (sums / n) ** 2).sum())
    own = float(np.trace(best.T @ image) / n - ((best.T @ sums / n) ** 2).sum())
    return 100.0 * own / total if total > 0 else 0.0


def denoised(rows: DataFrame, k: int = DEFAULT.components, value: str = "depth") -> DataFrame:
    """sample, window_id, row_mean, value's column and denoised, the depth without its share in the top k components.

    The vectors (samples x k numbers) go to the tasks, which take each block of windows by two matrix products. A null depth stays null and counts as
    the row's mean elsewhere; a window without any depth has a null mean.
    """
    windows = reused(_by_window(row_centred(rows, value)))
    names = _sample_names(windows)
    best = top_components(windows, names, k)[0]
    kinds, values = dict(windows.dtypes), pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, row, column, null in _blocks(batch, values):
                rest = (x - (x @ best) @ best.T)[row, column]
                mean = batch.column("row_mean").slice(a, b - a).to_numpy(zero_copy_only=False)[row]
                ids = batch.column("window_id").slice(a, b - a).take(pa.array(row))
                arrays = [values.take(pa.array(column)), ids, pa.array(x[row, column] + mean, mask=null), pa.array(mean, mask=np.isnan(mean)), pa.array(rest + mean, mask=null)]
                yield pa.RecordBatch.from_arrays(arrays, names=["sample", "window_id", value, "row_mean", "denoised"])

    return windows.mapInArrow(run, f"sample string, window_id {kinds['window_id']}, `{value}` double, row_mean double, denoised double")


def panel_stats(rows: DataFrame, value: str = "denoised") -> DataFrame:
    """window_id, pon_median, pon_variance (of the population)."""
    variance = F.var_pop(value)
    return rows.groupBy("window_id").agg(F.median(value).alias("pon_median"), F.when(variance >= NOISE, variance).otherwise(F.lit(0.0)).alias("pon_variance"))


def with_high_variance(panel: DataFrame, percentile: float = DEFAULT.variance_percentile) -> DataFrame:
    """panel with is_high_variance: 1 where the variance is above (not at) the exact percentile over all windows."""
    panel = reused(panel)
    found = exact_quantiles(panel, [], "pon_variance", percentile, "limit").first()
    limit = F.lit(found[0] if found else None).cast("double")
    return panel.withColumn("is_high_variance", F.coalesce(F.col("pon_variance") > limit, F.lit(False)).cast("int"))


def panel(matrix: DataFrame, windows: DataFrame, k: int = DEFAULT.components, value: str = "depth") -> DataFrame:
    """The panel's track: windows' columns with their statistics and flag."""
    stats = with_high_variance(panel_stats(denoised(matrix, k, value)))
    return windows.join(stats, "window_id").select("window_id", "chrom", "start", "end", "gc_pct", "pon_median", "pon_variance", "is_high_variance")
