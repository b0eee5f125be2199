"""Row-local draw arithmetic: 99 fixed percentiles per leaf, no random numbers, no shuffle.

A draw is an array position 0..98. Ranks stay integers until the very end, so that thresholds never
compare rounded doubles.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS = 99
#: Prefix of the hashed label; it decides the order of draws and can be given by the caller.
PATH_PREFIX = "draw-order-1|"


def _normal_grid() -> Column:
    return F.array(*[F.lit(NormalDist().inv_cdf(k / (DRAWS + 1))) for k in range(1, DRAWS + 1)])


def _ranks(sortable: Column) -> Column:
    """Rank 1..n of every position of an array of ``(sort key, position)`` structs."""
    placed = F.transform(F.sort_array(sortable), lambda x, r: F.struct(x["i"].alias("i"), (r + 1).alias("rank")))
    return F.transform(F.sort_array(placed), lambda x: x["rank"])


def hash_ranks(label: Column, prefix: str = PATH_PREFIX) -> Column:
    """Rank of each draw by the SHA-256 of its label text."""
    positions = F.sequence(F.lit(0), F.lit(DRAWS - 1))
    return _ranks(
        F.transform(
            positions,
            lambda i: F.struct(
                F.sha2(F.concat(F.lit(prefix), label, F.lit("|"), i.cast("string")), 256).alias("key"), i.alias("i")
            ),
        )
    )


def factor_path(label: Column, prefix: str = PATH_PREFIX) -> Column:
    """Standard-normal strata in hash order."""
    grid = _normal_grid()
    return F.transform(hash_ranks(label, prefix), lambda r: F.element_at(grid, r))


def value_ranks(values: Column) -> Column:
    """Rank of each draw by value, ties by position."""
    return _ranks(F.transform(values, lambda v, i: F.struct(v.alias("key"), i.alias("i"))))


def weighted_latent(parts: list[tuple[Column, Column]]) -> Column:
    """Sum of ``sqrt(weight) * path``, added in the given order."""

    def scaled(weight: Column, path: Column) -> Column:
        return F.transform(path, lambda x: F.sqrt(weight) * x)

    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [scaled(*part) for part in parts])


def interpolated(ranks: Column, p10: Column, p50: Column, p90: Column) -> Column:
    """Values at the given ranks 1..99: log-linear between the three knots, flat outside them.

    The knots are plain columns, because whatever a lambda refers to is evaluated once per element.
    """
    eps = 1e-9
    low = F.greatest(p10, F.lit(0.0))
    mid = F.greatest(p50, F.lit(0.0), low)
    high = F.greatest(p90, mid)

    def between(a: Column, b: Column, t: Column) -> Column:
        return F.exp((1.0 - t) * F.log(a + eps) + t * F.log(b + eps)) - eps

    def at(rank: Column) -> Column:
        p = rank / 100.0
        return (
            F.when((low <= eps) & (mid <= eps) & (high <= eps), 0.0)
            .when(rank <= 10, low)
            .when(rank == 50, mid)
            .when(rank >= 90, high)
            .when((rank < 50) & (mid <= low + eps), mid)
            .when(rank < 50, between(low, mid, (p - 0.10) / 0.40))
            .when(high <= mid + eps, high)
            .otherwise(between(mid, high, (p - 0.50) / 0.40))
        )

    return F.transform(ranks, at)


def grid_quantile(draws: Column, percent: int) -> Column:
    """Order statistic of the 99 draws."""
    return F.element_at(F.sort_array(draws), percent)


def share_at_least(draws: Column, threshold: Column) -> Column:
    return F.size(F.filter(draws, lambda x: x >= threshold)) / F.lit(float(DRAWS))


def centred_residual(rank: Column, p10: Column, p50: Column, p90: Column) -> Column:
    """Linear interpolation of three residual quantiles at a rank, minus the middle one."""
    p = rank / 100.0
    lower, upper = (p - 0.10) / 0.40, (p - 0.50) / 0.40
    return (
        F.when(rank <= 10, p10)
        .when(rank < 50, (1.0 - lower) * p10 + lower * p50)
        .when(rank == 50, p50)
        .when(rank < 90, (1.0 - upper) * p50 + upper * p90)
        .otherwise(p90)
    ) - p50
