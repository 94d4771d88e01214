"""Unit conversion, package volume and alcohol measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder.functions.numeric import KJ_PER_KCAL

# Grams per unit. Volumes count as 1 g/ml.
GRAMS = {
    "g": 1.0, "gr": 1.0, "gram": 1.0, "grams": 1.0,
    "mg": 1e-3, "мг": 1e-3, "毫克": 1e-3,
    "mcg": 1e-6, "µg": 1e-6, "μg": 1e-6, "ug": 1e-6,
    "kg": 1000.0, "кг": 1000.0, "公斤": 1000.0, "斤": 500.0,
    "oz": 28.349523125, "lb": 453.59237,
    "ml": 1.0, "мл": 1.0, "cl": 10.0, "кл": 10.0, "dl": 100.0, "дл": 100.0,
    "l": 1000.0, "л": 1000.0, "公升": 1000.0, "fl oz": 29.5735295625,
}
ETHANOL_G_PER_ML = 0.789
# Grams of ethanol in one standard drink.
STANDARD_DRINK_G = {"who": 10.0, "uk": 8.0, "us": 14.0, "canada": 13.6, "austria": 20.0}
# Sweetness of sparkling wine, upper cut in g/L (inclusive) and name.
SWEETNESS = [
    (3.0, "Brut Nature"), (6.0, "Extra Brut"), (12.0, "Brut"), (17.0, "Extra Seco"),
    (32.0, "Seco"), (50.0, "Semiseco"),
]
SWEETEST = "Dulce"


def unit_name(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def to_grams(v: Column, unit: Column) -> Column:
    """NULL for a unit that is not in the table."""
    table = F.expr("map(" + ", ".join(f"'{name}', {grams!r}D" for name, grams in GRAMS.items()) + ")")
    return v * F.try_element_at(table, unit_name(unit))


def convert_unit(v: Column, unit: Column, target: Column) -> Column:
    """To kJ, kcal, % or grams; an unknown unit gives NULL, no unit passes for grams and % only."""
    u = unit_name(unit)
    return (F.when(target == "kJ", F.when(u == "kj", v).when(u == "kcal", v * KJ_PER_KCAL))
            .when(target == "kcal", F.when(u == "kcal", v).when(u == "kj", v / KJ_PER_KCAL))
            .when(target == "%", F.when(u.isin("", "%", "% vol"), v))
            .otherwise(F.when(u == "", v).otherwise(to_grams(v, unit))))


def volume_ml(quantity: Column, unit: Column) -> Column:
    u = unit_name(unit)
    factor = F.when(u.isin("l", "kg"), 1000.0).when(u == "cl", 10.0).when(u == "dl", 100.0).otherwise(1.0)
    return F.when(quantity > 0, quantity * factor)


def ethanol_g(abv: Column, ml: Column) -> Column:
    return F.when((abv > 0) & (ml > 0), ml * abv / 100 * ETHANOL_G_PER_ML)


def standard_drinks(grams: Column, definition: str = "who") -> Column:
    return F.when(grams > 0, grams / STANDARD_DRINK_G[definition])


def sweetness_class(sugars_per_100ml: Column) -> Column:
    per_litre = sugars_per_100ml * 10
    out = F.when(sugars_per_100ml < 0, None)
    for cut, name in SWEETNESS:
        out = out.when(per_litre <= cut, name)
    return out.when(per_litre.isNotNull(), SWEETEST)
