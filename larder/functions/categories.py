"""Category flags with source precedence, and the kind of alcoholic drink."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder.functions.numeric import truthy

FLAG_NAMES = ["is_beverage", "is_water", "is_cheese", "is_fat_oil_nuts_seeds", "is_red_meat"]
# Parts of a category tag that give a flag away.
CATEGORY_HINTS = {
    "is_beverage": ["beverages", "drinks", "bebidas", "boissons", "getranke"],
    "is_water": ["waters", "en:water", "aguas", "eaux"],
    "is_cheese": ["cheese", "quesos", "fromages", "kase"],
    "is_fat_oil_nuts_seeds": ["vegetable-oils", "olive-oils", "nuts", "seeds", "fats", "butters", "aceites"],
    "is_red_meat": ["beef", "pork", "lamb", "veal", "red-meat", "carnes-rojas"],
}
# Kinds of alcoholic drink in order of precedence.
DRINK_HINTS = [
    ("espumoso", ["sparkling-wines", "champagnes", "cava", "cremant", "prosecco", "espumosos"]),
    ("vino", ["wines", "vinos", "vins"]),
    ("cerveza", ["beers", "cervezas", "bieres", "biere"]),
    ("sidra", ["ciders", "sidras", "cidres"]),
    ("destilado", ["spirits", "whisky", "whiskies", "vodka", "rum", "gin", "tequila", "licores", "liqueurs"]),
]


def tags_contain(tags: Column, parts: list[str]) -> Column:
    """Any tag containing any part. Tags are joined once, so this is one regex, not a nested loop."""
    joined = F.array_join(tags, "\n")
    return F.coalesce(joined.rlike("|".join(parts)), F.lit(False))


def flags_from(data: Column, origin: str) -> Column:
    """Flags of one published block; NULL where the block does not state them."""
    red = F.coalesce(data["is_red_meat_product"], data["is_red_meat"])
    values = {name: data[name] for name in FLAG_NAMES[:-1]} | {"is_red_meat": red}
    return F.when(data["is_beverage"].isNotNull(), F.struct(
        *[truthy(values[n]).alias(n) for n in FLAG_NAMES], F.lit(origin).alias("origin")))




def category_flags(data_2023: Column, data_2021: Column, data_legacy: Column, tags: Column) -> Column:
    """Struct of five flags and where they came from; all NULL when nothing tells."""
    guessed = F.when(F.size(tags) > 0, F.struct(
        *[tags_contain(tags, CATEGORY_HINTS[n]).alias(n) for n in FLAG_NAMES],
        F.lit("categories_tags").alias("origin")))
    return F.coalesce(
        flags_from(data_2023, "nutriscore_2023"),
        flags_from(data_2021, "nutriscore_2021"),
        flags_from(data_legacy, "nutriscore_data"),
        guessed)


def drink_type(tags: Column) -> Column:
    out = None
    for name, parts in DRINK_HINTS:
        out = (F if out is None else out).when(tags_contain(tags, parts), name)
    return F.when(F.size(tags) > 0, out)
