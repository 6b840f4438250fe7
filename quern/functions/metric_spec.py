"""User-defined metrics as column expressions, several in one pass, and the registry of validation samplers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class MetricSpec:
    """A metric: columns made per row, aggregates over them, and the result from the aggregates.

    ``per_row`` and ``aggs`` name their expressions; ``finalize`` is an expression over the aggregates' names, which are
    prefixed with the metric's name and two underscores.
    """

    name: str
    aggs: dict[str, Callable[[], Column]]
    finalize: Callable[[Callable[[str], Column]], Column]
    per_row: dict[str, Callable[[], Column]] = field(default_factory=dict)


def evaluate(df: DataFrame, specs: Sequence[MetricSpec], by: Sequence[str] = ()) -> DataFrame:
    """All metrics in one aggregation (one scan, one shuffle): the grouping columns and a column per metric."""
    from pyspark.sql import functions as F

    rows = df.withColumns({f"{s.name}__{n}": make() for s in specs for n, make in s.per_row.items()})
    sums = rows.groupBy(*by).agg(*(make().alias(f"{s.name}__{n}") for s in specs for n, make in s.aggs.items()))
    return sums.select(*by, *(s.finalize(lambda n, s=s: F.col(f"{s.name}__{n}")).alias(s.name) for s in specs))


#: Validation samplers by name: (df, size or ratio, seed) -> rows.
SAMPLERS: dict[str, Callable[..., DataFrame]] = {}


def sampler(name: str) -> Callable:
    """Register a validation sampler under a name."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SAMPLERS[name] = f
        return f

    return put
