"""PAHO 2016 warning seals, front-of-pack "high in" test and free sugars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder.functions.numeric import KJ_PER_KCAL, clamp, count_true, half_up

# Seal, energy per gram, share of energy (%) that triggers it.
ENERGY_SEALS = [
    ("free-sugars", 4.0, 10.0), ("total-fat", 9.0, 30.0),
    ("saturated-fat", 9.0, 10.0), ("trans-fat", 9.0, 1.0),
]
SODIUM_MG_PER_KCAL = 1.0
# Per 100 g / 100 ml, food cut and drink cut.
HIGH_IN = [("fat", 17.5, 8.75), ("saturated_fat", 5.0, 2.5), ("sugars", 22.5, 11.25), ("salt", 1.5, 0.75)]
DAILY_FREE_SUGARS_G = 50.0


def free_sugars(sugars: Column, fvl: Column, declared: Column | None = None) -> Column:
    """Sugars less the share that belongs to fruit and vegetables, unless declared."""
    estimate = sugars * (F.lit(1.0) - clamp(F.coalesce(fvl, F.lit(0.0)), 0, 100) / 100)
    return estimate if declared is None else F.coalesce(declared, estimate)


def kcal_of(kj: Column, kcal: Column) -> Column:
    return F.coalesce(kcal, kj / KJ_PER_KCAL)


def seals(kcal: Column, sodium_mg: Column, sugars_free: Column, fat: Column, sat: Column,
          trans: Column, sweetened: Column, estimated: Column) -> Column:
    """All six seals with the measured share; ``exceeded`` is false where it cannot be measured."""
    usable = F.when(kcal > 0, kcal)
    ratio = sodium_mg / usable
    rows = [F.struct(
        F.lit("sodium").alias("id"),
        F.coalesce(ratio >= SODIUM_MG_PER_KCAL, F.lit(False)).alias("exceeded"),
        half_up(ratio, 2).alias("actual"),
        F.lit(SODIUM_MG_PER_KCAL).alias("threshold"),
        F.lit(False).alias("estimated"),
    )]
    grams = {"free-sugars": sugars_free, "total-fat": fat, "saturated-fat": sat, "trans-fat": trans}
    for name, per_gram, limit in ENERGY_SEALS:
        pct = grams[name] * per_gram / usable * 100
        rows.append(F.struct(
            F.lit(name).alias("id"),
            F.coalesce(pct >= limit, F.lit(False)).alias("exceeded"),
            half_up(pct, 1).alias("actual"),
            F.lit(limit).alias("threshold"),
            (estimated if name == "free-sugars" else F.lit(False)).alias("estimated"),
        ))
    rows.append(F.struct(
        F.lit("sweeteners").alias("id"), F.coalesce(sweetened, F.lit(False)).alias("exceeded"),
        F.lit(None).cast("double").alias("actual"), F.lit(0.0).alias("threshold"),
        F.lit(False).alias("estimated"),
    ))
    return F.array(*rows)


def energy_seal(name: str, grams: Column, kcal: Column) -> Column:
    per_gram, limit = next((g, t) for n, g, t in ENERGY_SEALS if n == name)
    return grams * per_gram / kcal * 100 >= limit


def other_seals(kcal: Column, sodium_mg: Column, fat: Column, sat: Column, trans: Column, sweetened: Column) -> Column:
    """Exceeded seals besides free sugars, without building rows: the form scoring uses."""
    return count_true([
        sodium_mg / kcal >= SODIUM_MG_PER_KCAL, energy_seal("total-fat", fat, kcal),
        energy_seal("saturated-fat", sat, kcal), energy_seal("trans-fat", trans, kcal), sweetened])


def applicable(nova: Column) -> Column:
    """The model covers processed and ultra-processed food; an unknown group counts as covered."""
    return nova.isNull() | (nova >= 3)


def high_in(values: dict[str, Column], drink: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(values[name] > F.when(drink, low).otherwise(high), F.lit(name)) for name, high, low in HIGH_IN
    ]))


def sugar_day_pct(sugars_free: Column) -> Column:
    return F.when(sugars_free > 0, half_up(sugars_free / DAILY_FREE_SUGARS_G * 100))
