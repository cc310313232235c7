"""Parameters of the pipelines."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values: results depend on them."""

    window_size: int = 5000
    flank: int = 200
    min_fraction: float = 0.50
    min_mapq: int = 20
    flag_mask: int = 3844  # unmapped 4, secondary 256, failed checks 512, duplicate 1024, supplementary 2048
    lowess_frac: float = 0.1
    lowess_passes: int = 3
    min_points_normal: int = 10
    min_points_track: int = 50
    fit_floor: float = 1e-4
    safe_median: float = 1e-4
    log_floor: float = 1e-3
    components: int = 5
    variance_percentile: float = 0.99
    max_cv: float = 0.30
    extreme_high: float = 20.0
    extreme_low: float = 0.05
    unstable_median: float = 0.01
    unstable_ratio: float = 1000.0
    min_scale: float = 1.0
    max_scale: float = 50.0
    seed: int = 42
    cache_limit: int = 200_000
    evict: int = 50_000


DEFAULT = Params()
