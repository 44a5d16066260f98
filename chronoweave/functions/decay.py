"""Strength of memories: vitality, activation and effective confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The model's constants.
POINTS_PER_DAY, DECAY, RING, SILENCE, SCALE, FLOOR = 0.01, 0.5, 8, -3.5, 0.8, -10.0
RECALL_WEIGHT, REINFORCE_WEIGHT = 0.15, 1.0
#: Half lives in days by stability; null never decays.
HALF_LIFE = {"episodic": 30, "reinforced": 90, "persistent": 365, "consolidated": None}
#: Memory classes that do not decay.
PROTECTED = ("constraint", "style", "preference", "goal", "trait", "self_model", "consolidated", "archived_summary")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def protected(stability: Column, memory_class: Column | None = None) -> Column:
    by_class = F.lit(False) if memory_class is None else F.coalesce(F.lower(memory_class).isin(*PROTECTED), F.lit(False))
    return (stability == "consolidated") | by_class


def linear_vitality(score: Column, last: Column, now: Column, is_protected: Column) -> Column:
    """Score less a hundredth for each whole day since ``last``."""
    days = F.floor(F.greatest(hours(now, last) / 24, F.lit(0.0)))
    return F.when(is_protected | last.isNull(), clamp(score)).otherwise(clamp(score - days * POINTS_PER_DAY))


def _age(now: Column, at: Column) -> Column:
    return F.greatest(hours(now, at), F.lit(0.01))


def base_level(events: Column, total: Column, created: Column, now: Column) -> Column:
    """ln of the activation: each of the last eight events (``at``, ``weight``) by its age, older mass on average.

    ``events`` is an array of structs in order of ``at``; ``total`` is the weight of all events ever.
    """
    last = F.slice(events, F.greatest(F.size(events) - RING + 1, F.lit(1)), RING)
    exact = F.aggregate(last, F.lit(0.0), lambda a, e: a + F.greatest(e["weight"], F.lit(0.0)))
    recent = F.aggregate(last, F.lit(0.0), lambda a, e: a + F.greatest(e["weight"], F.lit(0.0)) * F.pow(_age(now, e["at"]), F.lit(-DECAY)))
    older = F.greatest(F.coalesce(total, exact) - exact, F.lit(0.0))
    life = _age(now, created)
    old = F.when(F.size(last) > 0, _age(now, F.get(last, F.lit(0))["at"])).otherwise(0.01)
    mean = F.when(life > old + 1e-9, (F.pow(life, F.lit(1 - DECAY)) - F.pow(old, F.lit(1 - DECAY))) / ((1 - DECAY) * (life - old))).otherwise(F.pow(life, F.lit(-DECAY)))
    mass = recent + F.when((older > 0) & created.isNotNull(), older * mean).otherwise(0.0)
    return F.when(mass > 0, F.ln(mass)).otherwise(FLOOR)


def vitality(level: Column, is_protected: Column) -> Column:
    x = (level - SILENCE) / SCALE
    return F.when(is_protected, 1.0).when(x <= -30, 0.0).when(x >= 30, 1.0).otherwise(1 / (1 + F.exp(-x)))


def effective_confidence(confidence: Column, alive: Column, is_protected: Column) -> Column:
    return F.when(is_protected, clamp(confidence)).otherwise(clamp(clamp(confidence) * alive))


def half_life(stability: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, days in HALF_LIFE.items():
        out = F.when(stability == name, F.lit(days).cast("int")).otherwise(out)
    return out


def fan_damping(fan: Column) -> Column:
    return F.greatest(F.lit(0.0), 2 - F.log1p(fan))
