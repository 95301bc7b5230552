"""Aggregation strategies. NaN counts as null. Weights multiply; a row counts where value and weight are there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import cut, dealt, is_few


def clean(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)


def sum_up(value: str, weight: Column | None = None) -> Column:
    v = clean(value)
    return F.sum(v if weight is None else v * weight)


def mean_up(value: str, weight: Column | None = None) -> Column:
    v, w = clean(value), F.lit(1.0) if weight is None else weight
    den = F.sum(F.when(v.isNotNull(), w))
    return F.when(den > 0, F.sum(v * w) / den)


def max_up(value: str) -> Column:
    return F.max(clean(value))


def min_up(value: str) -> Column:
    return F.min(clean(value))


def upscale(mapping: DataFrame, src: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Columns of the fine layer by dst_id; ``weight`` is the mapping's."""
    return mapping.join(src.withColumnRenamed("id", "src_id"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(*(c.alias(n) for n, c in aggs.items()))


def sum_down(mapping: DataFrame, coarse: DataFrame, value: str, by_weight: bool = False, preserve_total: bool = True) -> DataFrame:
    """Splits a coarse value over its fine rows (src_id fine, dst_id coarse): evenly or by weight; rescaled so that the
    total holds. Without any value a fine row gets 0."""
    values = cut(coarse.select("id", value))
    out = downscale(cut(mapping), dealt(values, is_few(values)), {value: Sum(geoweighted=by_weight)})
    return rescale(cut(out), values, [value]) if preserve_total else out


def spread_down(mapping: DataFrame, coarse: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """Hands a coarse value to each fine row: the smallest coarse id's value (mean), or the largest or smallest value."""
    joined = mapping.join(coarse.select(F.col("id").alias("dst_id"), clean(value).alias("v")), "dst_id")
    agg = {"mean": F.min_by("v", "dst_id"), "max": F.max("v"), "min": F.min("v")}[how]
    return joined.groupBy(F.col("src_id").alias("id")).agg(agg.alias(value))


def finite(value: str | Column, nodata: float | None = None) -> Column:
    """The value where it is finite and not ``nodata``; else null."""
    value = F.col(value) if isinstance(value, str) else value
    kept = F.when(F.abs(value) < float("inf"), value)
    return kept if nodata is None else F.when(kept != nodata, kept)


def weighted_mean(value: str, weight: str) -> Column:
    """Mean by weight over the rows that have a value, as an aggregate; null where these have no weight."""
    return mean_up(value, F.coalesce(F.col(weight), F.lit(0.0)))


@dataclass(frozen=True)
class Strategy:
    """How a column goes up (many fine rows to one coarse row) and down. Subclasses give ``up``, ``share`` and ``merge``.

    ``weight`` is a column of the source level, ``geoweighted`` multiplies the mapping's weight. ``mode`` picks the mapping
    (modes touches and exact imply geoweighted); ``nearest`` stands for a k-nearest mapping on the way down.
    """

    weight: str | None = None
    geoweighted: bool = False
    mode: str | None = None
    nearest: bool = False
    k: int = 6
    power: float = 2.0
    density: bool = False

    preserve_total = False

    def __post_init__(self) -> None:
        if self.mode in ("touches", "contains", "exact"):
            object.__setattr__(self, "geoweighted", True)

    def effective(self) -> Column | None:
        parts = ([F.col(self.weight)] if self.weight else []) + ([F.col("_geoweight")] if self.geoweighted else [])
        return None if not parts else parts[0] if len(parts) == 1 else parts[0] * parts[1]

    def up(self, value: str) -> Column:
        """Aggregate over the fine rows of a coarse row."""
        raise NotImplementedError

    def total(self, value: str) -> Column | None:
        """Aggregate over the pairs of a coarse row that ``share`` needs."""
        return None

    def share(self, value: str, total: Column | None) -> Column:
        """What each pair of a coarse row (src_id) and a fine row gets on the way down."""
        return clean(value)

    def merge(self, value: str) -> Column:
        """Aggregate over the pairs of one fine row: the one with the smallest coarse id."""
        return F.min_by(value, "src_id")


@dataclass(frozen=True)
class Sum(Strategy):
    preserve_total = True

    def up(self, value: str) -> Column:
        return sum_up(value, self.effective())

    def _valid(self, value: str) -> Column:
        w = self.effective()
        return F.when(clean(value).isNotNull(), F.lit(1.0) if w is None else w)

    def total(self, value: str) -> Column:
        return F.sum(self._valid(value))

    def share(self, value: str, total: Column | None) -> Column:
        return F.when(total > 0, clean(value) * self._valid(value) / total)

    def merge(self, value: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0.0))


@dataclass(frozen=True)
class Mean(Strategy):
    def up(self, value: str) -> Column:
        return mean_up(value, self.effective())

    def total(self, value: str) -> Column | None:
        w = self.effective()
        return None if w is None else F.sum(F.when(clean(value).isNotNull(), w))

    def share(self, value: str, total: Column | None) -> Column:
        return clean(value) if total is None else F.when(total > 0, clean(value))  # the same for all of a coarse row's pairs


@dataclass(frozen=True)
class Max(Strategy):
    def up(self, value: str) -> Column:
        return max_up(value)

    def merge(self, value: str) -> Column:
        return F.max(value)


@dataclass(frozen=True)
class Min(Strategy):
    def up(self, value: str) -> Column:
        return min_up(value)

    def merge(self, value: str) -> Column:
        return F.min(value)


@dataclass(frozen=True)
class SmoothMean(Strategy):
    """Plain mean up; down a blend of the k nearest coarse rows by inverse distance. With ``density`` the values are blended
    per area (the mapping has those of both sides) and the total is preserved."""

    nearest: bool = True
    geoweighted: bool = True

    @property
    def preserve_total(self) -> bool:
        return self.density

    def up(self, value: str) -> Column:
        return mean_up(value)

    def share(self, value: str, total: Column | None) -> Column:
        v = clean(value) / F.col("_coarse_area") if self.density else clean(value)
        return F.struct((v * F.col("_geoweight")).alias("part"), F.when(v.isNotNull(), F.col("_geoweight")).alias("w"))

    def merge(self, value: str) -> Column:
        part, w = F.sum(F.col(value)["part"]), F.sum(F.col(value)["w"])
        blend = F.when(w > 0, part / w)
        return blend * F.first("_fine_area") if self.density else blend


class Composite(Strategy):
    """One strategy's way up and another's way down (mapping, blending and totals included)."""

    def __init__(self, upward: Strategy, downward: Strategy | None = None) -> None:
        down = downward or upward
        for name, value in (("weight", upward.weight), ("geoweighted", upward.geoweighted), ("mode", upward.mode), ("nearest", down.nearest), ("k", down.k), ("power", down.power), ("density", down.density), ("preserve_total", down.preserve_total), ("upward", upward), ("downward", down)):
            object.__setattr__(self, name, value)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Composite) and (self.upward, self.downward) == (other.upward, other.downward)

    def __hash__(self) -> int:
        return hash((self.upward, self.downward))

    def up(self, value: str) -> Column:
        return self.upward.up(value)

    def total(self, value: str) -> Column | None:
        return self.downward.total(value)

    def share(self, value: str, total: Column | None) -> Column:
        return self.downward.share(value, total)

    def merge(self, value: str) -> Column:
        return self.downward.merge(value)


def upscale_by(mapping: DataFrame, fine: DataFrame, plans: dict[str, Strategy]) -> DataFrame:
    """Columns of the fine layer by coarse id, each by its strategy."""
    return upscale(mapping.withColumnRenamed("weight", "_geoweight"), fine, {c: s.up(c) for c, s in plans.items()})


def downscale(mapping: DataFrame, coarse: DataFrame, plans: dict[str, Strategy]) -> DataFrame:
    """Columns of the coarse layer by fine id. ``mapping`` leads from fine (src_id) to coarse rows (dst_id); strategies see
    the coarse row as src_id. Totals are not rescaled here. Sums over a coarse row are aggregated and joined back, so a
    coarse row with many fine rows is no single task's work."""
    names = {"src_id": "_fine", "dst_id": "src_id", "weight": "_geoweight", "src_area": "_fine_area", "dst_area": "_coarse_area"}
    joined = mapping.withColumnsRenamed(names).join(coarse.withColumnRenamed("id", "src_id"), "src_id")
    totals = {c: t for c, s in plans.items() if (t := s.total(c)) is not None}
    if totals:
        joined = joined.join(joined.groupBy("src_id").agg(*(t.alias(f"_total_{c}") for c, t in totals.items())), "src_id")
    shared = joined.withColumns({c: s.share(c, F.col(f"_total_{c}") if c in totals else None) for c, s in plans.items()})
    return shared.groupBy(F.col("_fine").alias("id")).agg(*(s.merge(c).alias(c) for c, s in plans.items()))


def rescale(down: DataFrame, coarse: DataFrame, columns: list[str]) -> DataFrame:
    """Scales columns so that their totals are those of the coarse layer, where both totals are there and not 0."""
    if not columns:
        return down
    goal = coarse.agg(*(F.sum(clean(c)).alias(f"_goal_{c}") for c in columns))  # one row each
    got = down.agg(*(F.sum(c).alias(f"_got_{c}") for c in columns))
    both = down.crossJoin(F.broadcast(goal)).crossJoin(F.broadcast(got))
    for c in columns:
        goal_c, got_c = F.col(f"_goal_{c}"), F.col(f"_got_{c}")
        both = both.withColumn(c, F.when((goal_c != 0) & (got_c != 0), F.col(c) * (goal_c / got_c)).otherwise(F.col(c)))
    return both.select(*down.columns)
