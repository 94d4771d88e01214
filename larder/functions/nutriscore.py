"""Nutri-Score 2023.

The rules are tables of cuts, so they are written out as SQL text over two struct columns that
``with_inputs`` adds: ``ns`` (the component values) and ``is`` (the flags, unknown read as no).
One text per component keeps both the Python side and the generated code short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Published cut tables of Nutri-Score 2023.
CUTS = {
    "energy": [335, 670, 1005, 1340, 1675, 2010, 2345, 2680, 3015, 3350],
    "energy_beverages": [30, 90, 150, 210, 240, 270, 300, 330, 360, 390],
    "sugars": [3.4, 6.8, 10, 14, 17, 20, 24, 27, 31, 34, 37, 41, 44, 48, 51],
    "sugars_beverages": [0.5, 2, 3.5, 5, 6, 7, 8, 9, 10, 11],
    "saturated_fat": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
    "salt": [0.2, 0.4, 0.6, 0.8, 1, 1.2, 1.4, 1.6, 1.8, 2,
             2.2, 2.4, 2.6, 2.8, 3, 3.2, 3.4, 3.6, 3.8, 4],
    "energy_from_saturated_fat": [120, 240, 360, 480, 600, 720, 840, 960, 1080, 1200],
    "saturated_fat_ratio": [10, 16, 22, 28, 34, 40, 46, 52, 58, 64],
    "fvl": [40, 60, 80, 80, 80],
    "fvl_beverages": [40, 40, 60, 60, 80, 80],
    "fiber": [3.0, 4.1, 5.2, 6.3, 7.4],
    "proteins": [2.4, 4.8, 7.2, 9.6, 12, 14, 17],
    "proteins_beverages": [1.2, 1.5, 1.8, 2.1, 2.4, 2.7, 3.0],
}
# Upper score of grades a-d per category; e is the rest.
GRADE_CUTS = {"general": [0, 2, 10, 18], "fats": [-6, 2, 10, 18], "beverages": [None, 2, 6, 9]}
# Lowest and highest score per category.
SCORE_LIMITS = {"general": (-17, 40), "fats": (-17, 30), "beverages": (-15, 14)}
SWEETENER_POINTS = 4
SAT_FAT_KJ_PER_G = 37.0
# Sweeteners without energy, by tag.
NON_NUTRITIVE_SWEETENERS = [
    "en:e950", "en:e951", "en:e952", "en:e954", "en:e955", "en:e957",
    "en:e959", "en:e960", "en:e961", "en:e962", "en:e969",
]


# Nutrient columns read and the unit whose bound applies.
COMPUTED_FROM = {"sugars": "g", "fat": "g", "saturated_fat": "g", "fiber": "g", "proteins": "g", "fvl": "%"}


def threshold_points(v: str, cuts: list[float], inclusive: bool = False) -> str:
    """Number of cuts passed; cuts rise, so the highest one passed tells. NULL passes none."""
    op = ">=" if inclusive else ">"
    arms = " ".join(f"WHEN {v} {op} {float(cuts[n - 1])}D THEN {n}" for n in range(len(cuts), 0, -1))
    return f"CASE {arms} ELSE 0 END"


def points_of(value: float, name: str, drink: bool) -> int:
    """Points of a constant, for bounds that put an unknown at one end of its range."""
    cuts = CUTS.get(f"{name}_beverages" if drink else name, CUTS[name])
    return sum(value > c for c in cuts)


def by_drink(v: str, name: str) -> str:
    plain = threshold_points(v, CUTS[name])
    if f"{name}_beverages" not in CUTS:
        return plain
    return f"CASE WHEN is.beverage THEN {threshold_points(v, CUTS[name + '_beverages'])} ELSE {plain} END"


def with_flags(df: DataFrame) -> DataFrame:
    names = {"beverage": "is_beverage", "water": "is_water", "cheese": "is_cheese",
             "fats": "is_fat_oil_nuts_seeds", "red_meat": "is_red_meat"}
    return df.withColumn("is", F.struct(*[
        F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(n) for n, c in names.items()]))


def with_inputs(df: DataFrame, energy: Column, salt: Column, values: dict[str, Column], sweetened: Column) -> DataFrame:
    """Inputs from plain nutrients; two of them are derived for the fats category."""
    sat, fat = values["saturated_fat"], values["fat"]
    return with_flags(df).withColumn("ns", F.struct(
        energy.alias("energy"), (sat * SAT_FAT_KJ_PER_G).alias("energy_from_saturated_fat"),
        values["sugars"].alias("sugars"), sat.alias("saturated_fat"),
        F.when((fat > 0) & sat.isNotNull(), sat / fat * 100).alias("saturated_fat_ratio"),
        salt.alias("salt"), values["fvl"].alias("fvl"), values["fiber"].alias("fiber"),
        values["proteins"].alias("proteins"), F.coalesce(sweetened, F.lit(False)).alias("sweetened")))


def component_points() -> dict[str, Column]:
    proteins = by_drink("ns.proteins", "proteins")
    text = {
        "energy": "CASE WHEN is.fats THEN " + threshold_points("ns.energy_from_saturated_fat", CUTS["energy_from_saturated_fat"])
                  + " ELSE " + by_drink("ns.energy", "energy") + " END",
        "sugars": by_drink("ns.sugars", "sugars"),
        "saturated_fat": "CASE WHEN is.fats THEN " + threshold_points("ns.saturated_fat_ratio", CUTS["saturated_fat_ratio"], True)
                         + " ELSE " + threshold_points("ns.saturated_fat", CUTS["saturated_fat"]) + " END",
        "salt": threshold_points("ns.salt", CUTS["salt"]),
        "sweeteners": f"CASE WHEN is.beverage AND ns.sweetened THEN {SWEETENER_POINTS} ELSE 0 END",
        "fvl": by_drink("ns.fvl", "fvl"),
        "fiber": threshold_points("ns.fiber", CUTS["fiber"]),
        "proteins": f"CASE WHEN is.red_meat THEN least({proteins}, 2) ELSE {proteins} END",
    }
    return {name: F.expr(t) for name, t in text.items()}


NEGATIVE = ["energy", "sugars", "saturated_fat", "salt", "sweeteners"]
CATEGORY = "CASE WHEN is.beverage THEN 'beverages' WHEN is.fats THEN 'fats' ELSE 'general' END"


def category() -> Column:
    return F.expr(CATEGORY)


def proteins_count(negative: str) -> Column:
    return F.expr(f"is.beverage OR is.cheese OR {negative} < CASE WHEN is.fats THEN 7 ELSE 11 END")


def proteins_reason(negative: str) -> Column:
    side = lambda n: (f"CASE WHEN {negative} < {n} THEN 'negative_points_less_than_{n}' "
                      f"ELSE 'negative_points_greater_than_or_equal_to_{n}' END")
    return F.expr(f"CASE WHEN is.beverage THEN 'beverage' WHEN is.cheese THEN 'cheese' "
                  f"WHEN is.fats THEN {side(7)} ELSE {side(11)} END")


def nutri_grade(score: str) -> Column:
    def letters(name: str) -> str:
        arms = " ".join(f"WHEN {score} <= {cut} THEN '{letter}'"
                        for letter, cut in zip("abcd", GRADE_CUTS[name]) if cut is not None)
        return f"CASE {arms} ELSE 'e' END"

    return F.expr(f"CASE WHEN is.beverage THEN CASE WHEN is.water THEN 'a' ELSE {letters('beverages')} END "
                  f"WHEN is.fats THEN {letters('fats')} ELSE {letters('general')} END")


def nutri_hundred(score: str) -> Column:
    def scaled(name: str) -> str:
        low, high = SCORE_LIMITS[name]
        return f"({high}D - greatest({low}D, least({high}D, CAST({score} AS DOUBLE)))) / {high - low}D * 100D"

    return F.expr(f"CASE WHEN is.beverage THEN CASE WHEN is.water THEN 100D ELSE {scaled('beverages')} END "
                  f"WHEN is.fats THEN {scaled('fats')} ELSE {scaled('general')} END")


def missing_inputs() -> Column:
    """Names of the inputs the score had to do without."""
    named = lambda field, label=None: f"CASE WHEN ns.{field} IS NULL THEN '{label or field}' END"
    return F.expr(f"""array_compact(array(
        CASE WHEN is.fats THEN {named("energy_from_saturated_fat")} ELSE {named("energy")} END,
        {named("sugars")},
        CASE WHEN is.fats THEN {named("saturated_fat_ratio")} ELSE {named("saturated_fat")} END,
        {named("salt")}, {named("fvl", "fruits_vegetables_legumes")}, {named("fiber")}, {named("proteins")}))""")
