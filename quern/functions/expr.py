"""Column expressions: clipping, deterministic hash draws, interpolation, strata, flags and text rewriting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """``x`` held in [lo, hi]; null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def no_nan(x: Column | str) -> Column:
    x = col(x).cast("double")
    return F.when(~F.isnan(x), x)


def order_hash(key: Column | str, *salt) -> Column:
    """md5 of the key and the seeds: a reproducible random order, the same in any engine."""
    return F.md5(F.concat_ws(":", col(key).cast("string"), *(s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salt)))


def uniform(key: Column | str, *salt) -> Column:
    """Reproducible draw in [0, 1) from the first 8 hex digits of ``order_hash``."""
    return F.conv(F.substring(order_hash(key, *salt), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def fair_weight(label: Column | str) -> Column:
    """Weight of a squared error: 1/30 plus the label."""
    return F.lit(1 / 30) + col(label)


def group_flag(value: Column | str, threshold: float = 0.5) -> Column:
    """1 where the value reaches the threshold, else 0; missing (null, NaN) stays null."""
    return (no_nan(value) >= F.lit(threshold)).cast("int")


def strata(label: Column | str = "label", grp: Column | str = "grp") -> Column:
    """Group times label bin: fifty bins to the unit below 0.4, one bin above; 42 strata."""
    label = col(label)
    bin_ = F.when(label < 0.4, F.floor(label * 50)).otherwise(F.lit(20)).cast("int")
    return col(grp).cast("int") * 21 + bin_


def fn_interp(x: Column | str, xs: Column, ys: Column) -> Column:
    """Linear interpolation of the points (xs ascending, ys), held at the ends; two array columns of equal size."""
    x, n = col(x), F.size(xs)
    i = F.least(F.greatest(F.size(F.filter(xs, lambda v: v <= x)), F.lit(1)), n - 1)
    x0, x1, y0, y1 = F.element_at(xs, i), F.element_at(xs, i + 1), F.element_at(ys, i), F.element_at(ys, i + 1)
    inside = y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0.0))
    return F.when(n == 1, F.element_at(ys, 1)).when(x <= F.element_at(xs, 1), F.element_at(ys, 1)).when(x >= F.element_at(xs, n), F.element_at(ys, n)).otherwise(inside)


def floor_double(x: Column | str) -> Column:
    """The largest whole number up to a double, as a double: negative zero, NaN, infinities and what no long holds stay as they are."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).when(F.floor(x) == x, x).otherwise(F.floor(x).cast("double"))


def grid_lookup(x: Column | str, ys: Column, lo: float, step: float) -> Column:
    """Linear interpolation on an even grid in constant time per row: no search in the array."""
    n = F.size(ys)
    t = F.least(F.greatest((col(x) - F.lit(lo)) / F.lit(step), F.lit(0.0)), (n - 1).cast("double"))
    i = F.least(F.floor(t).cast("int"), n - 2)
    y0, y1 = F.element_at(ys, i + 1), F.element_at(ys, i + 2)
    return y0 + (y1 - y0) * (t - i)


def fn_uri_rewrite(uri: Column | str, marker: str, new_root: str) -> Column:
    """Replace what stands before the last ``/marker`` by ``new_root`` and keep a ``file://`` scheme; other URIs stay."""
    uri = col(uri)
    scheme = F.regexp_extract(uri, r"^(file://)?", 1)
    tail = F.regexp_extract(uri, rf"^(?:file://)?.*(/{marker}(?:/.*)?)$", 1)
    return F.when(tail != "", F.concat(scheme, F.lit(new_root.rstrip("/")), tail)).otherwise(uri)


def fn_short(text: Column | str, most: int = 60) -> Column:
    """The text, or its beginning with three dots where it has more than ``most`` characters."""
    text = col(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def fn_range_label(low: Column | str, high: Column | str) -> Column:
    """A range of numbers as text, with three places."""
    return F.when(col(low).isNotNull() & col(high).isNotNull(), F.format_string("[%.3f, %.3f]", col(low), col(high)))


def fn_param_lines(name: Column | str, params: Column | str, keys: Sequence[str], most: int = 60, between: str = "\n") -> Column:
    """A run's name and those of its parameters that are there, as lines key=value with short values."""
    params = col(params)
    return F.concat_ws(between, col(name), *(F.when(params[k].isNotNull(), F.concat(F.lit(f"{k}="), fn_short(params[k], most))) for k in keys))


def first_of(values: Column, names: Sequence[str]) -> Column:
    """First non-null of a map's entries under several (legacy) names."""
    return F.coalesce(*(values[n] for n in names))


def defect_reason(blur: float, tint: float, clip_: float, saturation: float = 12.0, blur_col="blur", tint_col="tint", clip_col="clip", saturation_col="saturation") -> Column:
    """First rule that fits: blur below, tint above, clip above (saturation below where clip is missing); else empty."""
    third = F.when(col(clip_col).isNotNull(), col(clip_col) > clip_).otherwise(col(saturation_col) < saturation)
    return F.when(col(blur_col) < blur, "A").when(col(tint_col) > tint, "B").when(third, "C").otherwise("")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vec_template(v: Column | str, eps: float = 1e-6) -> Column:
    """Mean-subtracted vector of unit length; null where its length is at most ``eps``."""
    v = col(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    centred = bound(F.try_divide(total, F.size(v)), lambda mean: F.transform(v, lambda x: x.cast("double") - mean))
    return bound(centred, lambda c: bound(F.sqrt(dot(c, c)), lambda norm: F.when(norm > eps, F.transform(c, lambda x: x / norm))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row; inside a lambda it would be computed again for every element."""
    return F.transform(F.array(value), use)[0]


vec_cosine = dot
