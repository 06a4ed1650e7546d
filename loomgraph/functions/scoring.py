"""Scoring parameters and the column expressions made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoringParams:
    """None for a cutoff, a hop limit or a cap means no limit."""

    bridge_cutoff: float | None = 0.6
    max_hops: int | None = None
    use_weights: bool = True
    enable_bridging: bool = True
    bridge_credit_scale: float = 1.0
    max_bridge_credit: float | None = None
    bridgeable_penalty: float = 0.0
    unreachable_penalty: float = 0.0
    proficiency_reference: float = 1.0
    min_proficiency_credit: float = 0.0
    search_cutoff: float | None = None


#: The locked serving configuration.
TUNED_PARAMS = ScoringParams(bridge_cutoff=0.30, bridge_credit_scale=2.0, max_bridge_credit=0.9, unreachable_penalty=0.0, max_hops=2)


def proficiency_credit(weight: Column, p: ScoringParams) -> Column:
    if not p.use_weights:
        return F.lit(1.0)
    return F.greatest(F.lit(float(p.min_proficiency_credit)), F.least(weight / p.proficiency_reference, F.lit(1.0)))


def bridge_credit(distance: Column, p: ScoringParams) -> Column:
    credit = F.greatest(F.lit(0.0), F.lit(1.0) - distance) * float(p.bridge_credit_scale)
    return credit if p.max_bridge_credit is None else F.least(credit, F.lit(float(p.max_bridge_credit)))


def within_distance(distance: Column, p: ScoringParams) -> Column:
    return F.lit(True) if p.bridge_cutoff is None else distance <= float(p.bridge_cutoff)


def within_hops(hops: Column, p: ScoringParams) -> Column:
    return F.lit(True) if p.max_hops is None else F.coalesce(hops <= p.max_hops, F.lit(False))


def bridgeable(distance: Column, hops: Column, p: ScoringParams) -> Column:
    """False where there is no distance."""
    if not p.enable_bridging:
        return F.lit(False)
    return F.coalesce(distance.isNotNull() & within_distance(distance, p) & within_hops(hops, p), F.lit(False))


def gap_reason(distance: Column, hops: Column, p: ScoringParams) -> Column:
    """The first condition that blocks a bridge; null distance: no path."""
    if not p.enable_bridging:
        return F.lit("bridging_disabled")
    return (
        F.when(distance.isNull(), "no_path")
        .when(~within_distance(distance, p), F.concat(F.lit("beyond_distance(d="), F.format_string("%.2f", distance), F.lit(f">{p.bridge_cutoff})")))
        .when(~within_hops(hops, p), F.concat(F.lit("beyond_hops("), F.coalesce(hops.cast("string"), F.lit("None")), F.lit(f">{p.max_hops})")))
        .otherwise("bridgeable")
    )


def typed_cost(edge_type: Column, confidence: Column) -> Column:
    """Base cost of a traversable type times (2 - confidence); null where the type isn't traversable."""
    base = F.when(edge_type == "substitute", 0.2).when(edge_type == "prerequisite", 0.6)
    return base * (F.lit(2.0) - confidence)


def is_traversable(edge_type: Column) -> Column:
    """Whether a typed edge may carry a bridge."""
    return F.coalesce(edge_type.isin("substitute", "prerequisite"), F.lit(False))


def is_directed(edge_type: Column, direction: Column) -> Column:
    """Whether a typed edge holds in one direction only: a prerequisite that isn't symmetric."""
    return F.coalesce((edge_type == "prerequisite") & (direction != "symmetric"), F.lit(False))


def similarity_of_cost(cost: Column) -> Column:
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - cost)), 3)


def rounded(x: Column, places: int) -> Column:
    """x to so many places, by way of 9 places, so that the order of a sum doesn't decide a tie."""
    return F.round(F.round(x, 9), places)


def wire_distance(distance: Column) -> Column:
    """Rounded to 4 places; -1 where there is none or it is infinite."""
    return F.when(distance.isNull() | (distance == float("inf")), F.lit(-1.0)).otherwise(F.round(distance, 4))
