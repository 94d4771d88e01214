"""Additive steps, potency, surcharges and the diminishing sum."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder.functions.numeric import clamp, half_up

# Points out of 100 for each step, ordered by precedence.
BANNED_POINTS = 60.0
LEVEL_ONE_POINTS = {"confirmed": 40.0, "probable": 30.0, "possible": 20.0}
LEVEL_ONE_DEFAULT = 20.0
LEVEL_POINTS = {2: 12.0, 3: 10.0, 4: 8.0, 5: 7.0, 6: 6.0, 7: 5.0, 8: 4.0}
NO_DATA_POINTS = 3.0
# Factor of the most and the least potent additive of a level.
POTENCY = (1.25, 0.75)
# Exposure surcharges.
OVEREXPOSURE_POINTS = {"high": 10.0, "moderate": 5.0}
WATCHED_POINTS = 4.0
VULNERABLE_GROUPS = ["en:infants", "en:toddlers", "en:children"]
VULNERABLE_POINTS = 5.0
NO_MARGIN_POINTS = 3.0
DIMINISHING = 0.72


def base_points(banned: Column, level: Column, certainty: Column) -> Column:
    first = F.when(certainty == "confirmed", LEVEL_ONE_POINTS["confirmed"])
    for name in ("probable", "possible"):
        first = first.when(certainty == name, LEVEL_ONE_POINTS[name])
    out = F.when(banned, BANNED_POINTS).when(level == 1, first.otherwise(LEVEL_ONE_DEFAULT))
    for n, points in LEVEL_POINTS.items():
        out = out.when(level == n, points)
    return out.otherwise(NO_DATA_POINTS)


def reason(banned: Column, level: Column) -> Column:
    return F.when(banned, "banned").when(level.between(1, 8), "hazard").otherwise("no-data")


def modulated(base: Column, why: Column, position: Column) -> Column:
    """Position 0 is the most potent of its level."""
    most, least = POTENCY
    return F.when((why == "hazard") & position.isNotNull(),
                  base * (F.lit(most) - F.lit(most - least) * position)).otherwise(base)


def surcharges(risk: Column, watched: Column, groups_over: Column, no_margin: Column) -> Column:
    over = F.when(risk == "high", OVEREXPOSURE_POINTS["high"]).when(
        risk == "moderate", OVEREXPOSURE_POINTS["moderate"]).otherwise(0.0)
    vulnerable = F.arrays_overlap(groups_over, F.array(*[F.lit(g) for g in VULNERABLE_GROUPS]))
    return (over + F.when(watched, WATCHED_POINTS).otherwise(0.0)
            + F.when(vulnerable, VULNERABLE_POINTS).otherwise(0.0)
            + F.when(no_margin, NO_MARGIN_POINTS).otherwise(0.0))


def diminishing_sum(points: Column, factor: float = DIMINISHING) -> Column:
    """Worst first, each next one weighs ``factor`` times less.

    Horner's form from the mildest up: total = p + factor * (total of the milder ones).
    """
    return F.aggregate(F.sort_array(points), F.lit(0.0), lambda acc, p: p + acc * factor)


def block_score(total: Column) -> Column:
    return clamp(F.lit(100.0) - total, 0, 100)


def rounded_points(v: Column) -> Column:
    return half_up(v, 1)


def hazard_chip(banned: Column, level: Column, certainty: Column) -> Column:
    return (F.when(banned, "banned")
            .when(level.isNotNull(), F.concat_ws(" ", F.concat(F.lit("level "), level.cast("string")), certainty))
            .otherwise("no data"))


def explain_points(why: Column, jurisdictions: Column, certainty: Column, hazard: Column, no_dose: Column) -> Column:
    listed = F.concat_ws(", ", jurisdictions)
    return (F.when(why == "banned", F.when(listed != "", F.concat(F.lit("banned in "), listed)).otherwise("banned"))
            .when(why == "hazard", F.concat_ws(" ", F.lit("hazard"), certainty, hazard))
            .otherwise(F.coalesce(F.concat(F.lit("no dose: "), no_dose), F.lit("no hazard data"))))
