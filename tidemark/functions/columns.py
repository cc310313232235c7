"""Column functions with the null rules that the pipelines need: missing stays missing, and a comparison with it is false."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEX_PREFIXES = "^(chrX|chrY|chrM|X|Y|MT)"


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    c = as_column(c)
    return F.when(F.isnan(c), None).otherwise(c)


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null (greatest and least would skip it)."""
    c = as_column(c)
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def flag(condition: Column) -> Column:
    """1 or 0; unknown is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_autosome(c: str | Column) -> Column:
    """Not by name a sex or mitochondrial chromosome. c: a chromosome or a window id."""
    return ~as_column(c).rlike(SEX_PREFIXES)


def hash_uniform(c: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on nothing but the value and the seed."""
    return F.conv(F.substring(F.md5(F.concat(as_column(c).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def has_bits(c: str | Column, mask: int) -> Column:
    return as_column(c).bitwiseAND(F.lit(mask)) != 0


def sample_name(path: str | Column) -> Column:
    """The file's name up to its first full stop."""
    return F.split_part(F.element_at(F.split(as_column(path), "/"), -1), F.lit("."), F.lit(1))


def track_sample_name(path: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(as_column(path), "/"), -1), "_off_target_copy_ratios\\.tsv$", "")
