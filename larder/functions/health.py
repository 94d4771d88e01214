"""Overall 0-100 score: block weights, seals, bands, confidence and bounds."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from larder.functions.numeric import clamp, half_up

# Weight of each block; they sum to 1.
WEIGHTS = {"nutrition": 0.55, "processing": 0.2, "additives": 0.2, "regulatory": 0.05}
SEAL_POINTS = 4.0
SEAL_CAP = 16.0
ABV_LIMIT = 1.2
# Lowest score of each band.
BANDS = [(75, "excellent"), (50, "good"), (25, "mediocre"), (10, "poor")]
# What confidence asks for and how much each weighs.
PRESENCE_WEIGHTS = {
    "energy": 3, "sugars": 2, "saturated_fat": 2, "salt": 2, "proteins": 1,
    "fiber": 1, "fat": 1, "ingredients": 2, "nova": 2,
}
CONFIDENCE_CUTS = [(0.85, "high"), (0.6, "medium"), (0.35, "low")]


def is_alcoholic(abv: Column) -> Column:
    return F.coalesce(abv > ABV_LIMIT, F.lit(False))


def seal_penalty(count: Column, alcoholic: Column) -> Column:
    return F.when(alcoholic, 0.0).otherwise(F.least(count * SEAL_POINTS, F.lit(SEAL_CAP)))


def regulatory_hundred(penalty: Column) -> Column:
    return F.lit(100.0) - penalty / SEAL_CAP * 100


def health_score(nutrition: Column, processing: Column, additive: Column, penalty: Column, alcoholic: Column) -> Column:
    w = WEIGHTS
    full = (nutrition * w["nutrition"] + processing * w["processing"] + additive * w["additives"]
            + regulatory_hundred(penalty) * w["regulatory"])
    partial = (processing * w["processing"] + additive * w["additives"]) / (w["processing"] + w["additives"])
    return clamp(half_up(F.when(alcoholic, partial).otherwise(full) - penalty * 0.5), 0, 100)


def band(score: Column) -> Column:
    out = None
    for low, name in BANDS:
        out = (F if out is None else out).when(score >= low, name)
    return out.otherwise("bad")


def presence_ratio(present: dict[str, Column]) -> Column:
    total = sum(PRESENCE_WEIGHTS.values())
    parts = [F.when(present[name], w).otherwise(0) for name, w in PRESENCE_WEIGHTS.items()]
    return reduce(add, parts) / float(total)


def missing_labels(present: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~present[n], F.lit(n)) for n in PRESENCE_WEIGHTS]))


def confidence_level(ratio: Column, notes: Column) -> Column:
    out = None
    for low, name in CONFIDENCE_CUTS:
        out = (F if out is None else out).when(ratio >= low, name)
    level = out.otherwise("insufficient")
    return F.when((level == "high") & (F.size(notes) > 0), "medium").otherwise(level)
