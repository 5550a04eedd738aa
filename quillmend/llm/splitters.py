"""Sampled splitters: size-weighted key samples, quantile boundaries, range ids, overfull ranges cut again.

Keys are a pair of bigint expressions, so a hot first key is divided by the second one. Everything is
Catalyst expressions; the driver holds the sample (at most about ``SAMPLES_PER_RANGE`` keys a range)
and one count a range, neither of which grows with the rows.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES_PER_RANGE = 16
OVERFULL = 2.0
#: Ranges hold about so many bytes, but there are no more than so many of them.
RANGE_BYTES, MOST_RANGES = 8 << 20, 20_000


@dataclass(frozen=True)
class Ranges:
    """Ascending splitters, and for each of the ``len(splitters) + 1`` ranges its bytes and rows."""

    splitters: list[tuple[int, int]]
    sizes: list[int]
    rows: list[int]

    @property
    def total_size(self) -> int:
        return sum(self.sizes)

    @property
    def total_rows(self) -> int:
        return sum(self.rows)


def long_array(values: list[int]) -> Column:
    """A constant array of bigints; a short expression however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def range_id(splitters: list[tuple[int, int]], key1: str, key2: str) -> Column:
    """How many splitters are at or below the key, by binary search.

    ``key1`` and ``key2`` are SQL texts of non-null bigint expressions.
    """
    if not splitters:
        return F.lit(0)
    a, b = long_array([x for x, _ in splitters]), long_array([y for _, y in splitters])
    x, y = F.expr(key1), F.expr(key2)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(splitters).bit_length()))])

    def further(found: Column, step: Column) -> Column:
        at = found + step - 1  # null beyond the end
        return F.when((F.get(a, at) < x) | ((F.get(a, at) == x) & (F.get(b, at) <= y)), found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), further).cast("int")


def _sampled(df: DataFrame, key1: str, key2: str, size: str, total: int, samples: int, seed: int) -> list[tuple[int, int, float]]:
    """Rows drawn with probability min(1, samples * size / total), each with the size that it stands for, by key.

    The draw hashes the key, so a task that runs again draws the same rows.
    """
    unit = F.expr(f"pmod(xxhash64({key1}, {key2}, {seed}), 1000003) / 1000003D")
    chosen = df.filter(unit < F.expr(f"({size}) * {samples / total!r}D"))
    found = chosen.select(F.expr(key1).alias("a"), F.expr(key2).alias("b"), F.expr(f"cast(greatest({size}, {total / samples!r}D) as double)").alias("w"))
    return sorted((r.a, r.b, r.w) for r in found.collect())


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """Keys before which about 1, 2, ... of ``parts`` shares of the weight lie."""
    before = list(accumulate((w for *_, w in sample), initial=0.0))
    at = {bisect_left(before, before[-1] * i / parts) for i in range(1, parts)}
    return sorted({sample[i][:2] for i in at if i < len(sample)})


def _counted(df: DataFrame, splitters: list[tuple[int, int]], key1: str, key2: str, size: str) -> Ranges:
    got = df.groupBy(range_id(splitters, key1, key2).alias("r")).agg(F.sum(F.expr(size)).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sizes, rows = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1)
    for r in got:
        sizes[r.r], rows[r.r] = int(r.s or 0), r.n
    return Ranges(splitters, sizes, rows)


def parts_for(total: int, least: int) -> int:
    """Ranges of about ``RANGE_BYTES``, but at least ``least`` and at most ``MOST_RANGES`` (or ``least``)."""
    return max(least, min(MOST_RANGES, total // RANGE_BYTES))


def split(df: DataFrame, key1: str, key2: str, size: str, least: int, seed: int = 17) -> Ranges:
    """Splitters for ranges of like total ``size``: :func:`parts_for` says how many.

    Ranges beyond ``OVERFULL`` times the mean are sampled again and cut, until none is left or the
    sample finds no further key inside them (all their rows share one key).
    """
    total = int(df.agg(F.sum(F.expr(size))).first()[0] or 0)
    parts = parts_for(total, least)
    if not total:
        return _counted(df, [], key1, key2, size)
    ranges = _counted(df, _quantiles(_sampled(df, key1, key2, size, total, SAMPLES_PER_RANGE * parts, seed), parts), key1, key2, size)
    while True:
        full = {i: s for i, (s, n) in enumerate(zip(ranges.sizes, ranges.rows, strict=True)) if n > 1 and s > OVERFULL * total / parts}
        if not full:
            return ranges
        inside = df.filter(range_id(ranges.splitters, key1, key2).isin(list(full)))
        found = _sampled(inside, key1, key2, size, sum(full.values()), SAMPLES_PER_RANGE * max(parts, 2 * len(full)), seed + len(ranges.splitters))
        bounds, more = [None, *ranges.splitters, None], set()
        for i, s in full.items():
            low, high = bounds[i], bounds[i + 1]
            own = found[0 if low is None else bisect_left(found, low) : len(found) if high is None else bisect_left(found, high)]  # a pair is before all triples that begin with it
            more |= set(_quantiles(own, max(2, round(s * parts / total))))
        more -= set(ranges.splitters)
        if not more:
            return ranges
        ranges = _counted(df, sorted({*ranges.splitters, *more}), key1, key2, size)
