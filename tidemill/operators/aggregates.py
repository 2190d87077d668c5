"""Aggregates in three parts, so that they can be stored and merged: registered by name, built in or your own.

``partial`` makes a state of a column's values, ``merge`` one of several states, ``final`` the
result of a state.  All three are columns: Spark aggregates states before it shuffles them and
:class:`tidemill.plans.rollup.Rollup` keeps them from run to run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import as_text, number
from tidemill.registry import Registry

AGGREGATES = Registry("aggregate")


@dataclass(frozen=True)
class Aggregate:
    """The three parts; ``partial`` takes the column and its type, the others the state."""

    partial: Callable[[Column, T.DataType], Column]
    merge: Callable[[Column], Column]
    final: Callable[[Column], Column]


def register(*names: str) -> Callable[[Callable[[], Aggregate]], Aggregate]:
    """A decorator for a function that gives the aggregate."""

    def add(build: Callable[[], Aggregate]) -> Aggregate:
        made = build()
        AGGREGATES.register(*names)(made)
        return made

    return add


@register("sum")
def _sum() -> Aggregate:
    """Of what reads as a number; 0.0 for none."""
    return Aggregate(lambda c, kind: F.sum(number(c, kind)), F.sum, lambda s: F.round(F.coalesce(s, F.lit(0.0)), 10))


@register("count")
def _count() -> Aggregate:
    return Aggregate(lambda c, kind: F.count(c), F.sum, lambda s: F.coalesce(s, F.lit(0)).cast("long"))


@register("min")
def _min() -> Aggregate:
    return Aggregate(lambda c, kind: F.min(c), F.min, lambda s: s)


@register("max")
def _max() -> Aggregate:
    return Aggregate(lambda c, kind: F.max(c), F.max, lambda s: s)


def _summed(sum_: Column, count: Column, square: Column) -> Column:
    return F.struct(sum_.alias("sum"), count.alias("count"), square.alias("square"))


def _moments() -> tuple[Callable, Callable]:
    def partial(c: Column, kind: T.DataType) -> Column:
        x = number(c, kind)
        return _summed(F.sum(x), F.count(x), F.sum(x * x))

    return partial, lambda s: _summed(F.sum(s["sum"]), F.sum(s["count"]), F.sum(s["square"]))


@register("avg", "mean")
def _avg() -> Aggregate:
    partial, merge = _moments()
    return Aggregate(partial, merge, lambda s: F.when(s["count"] > 0, F.round(s["sum"] / s["count"], 10)))


@register("stddev")
def _stddev() -> Aggregate:
    """Of a population."""
    partial, merge = _moments()
    spread = lambda s: s["square"] / s["count"] - (s["sum"] / s["count"]) * (s["sum"] / s["count"])
    return Aggregate(partial, merge, lambda s: F.when(s["count"] > 0, F.sqrt(F.greatest(spread(s), F.lit(0.0)))))


#: log2 of a distinct count's slots; its standard error is 1.04 / sqrt(2 ** DISTINCT_BITS), 1.6 %.
DISTINCT_BITS = 12


@register("approx_count_distinct")
def _distinct() -> Aggregate:
    """Different values but null, with a standard error of 1.6 %; the state has 4 KB at most."""
    return Aggregate(
        lambda c, kind: F.hll_sketch_agg(as_text(c, kind), DISTINCT_BITS),
        F.hll_union_agg,
        lambda s: F.coalesce(F.hll_sketch_estimate(s), F.lit(0)),
    )


def quantile(share: float) -> Aggregate:
    """A quantile of what reads as a number, to about 1.65 % of the ranks; the state is a few KB."""
    return Aggregate(
        lambda c, kind: F.kll_sketch_agg_double(number(c, kind)),
        F.kll_merge_agg_double,
        lambda s: F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(share))),
    )


for _name, _share in (("approx_median", 0.5), ("approx_p90", 0.9), ("approx_p95", 0.95), ("approx_p99", 0.99)):
    AGGREGATES.register(_name)(quantile(_share))
