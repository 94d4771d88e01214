"""The nutrient ladder: ordered sources per nutrient, physical bounds, derivations, provenance.

Three projections, so that each value is coerced once:

1. ``typed_sources``: text leaves to numbers, version-3 and score components to the target unit;
2. ``with_ladder``: per nutrient, the candidates present, what is kept and what is rejected;
3. ``with_nutrients``: cross derivations, implausible list and provenance marks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.numeric import BOUNDS, KJ_PER_KCAL, bounded, num_nonneg
from larder.functions.units import convert_unit


@dataclass(frozen=True)
class Nutrient:
    nid: str
    unit: str
    component: str | None = None
    fallbacks: list[str] = field(default_factory=list)

    @property
    def nids(self) -> list[str]:
        return [self.nid, *self.fallbacks]


# Field names of each nutrient in the source documents.
NUTRIENTS = {
    "energy_kj": Nutrient("energy-kj", "kJ", "energy", ["energy"]),
    "energy_kcal": Nutrient("energy-kcal", "kcal"),
    "fat": Nutrient("fat", "g"),
    "saturated_fat": Nutrient("saturated-fat", "g", "saturated_fat"),
    "trans_fat": Nutrient("trans-fat", "g"),
    "carbohydrates": Nutrient("carbohydrates", "g"),
    "sugars": Nutrient("sugars", "g", "sugars"),
    "fiber": Nutrient("fiber", "g", "fiber"),
    "proteins": Nutrient("proteins", "g", "proteins"),
    "salt": Nutrient("salt", "g", "salt"),
    "sodium": Nutrient("sodium", "g"),
    "alcohol": Nutrient("alcohol", "%"),
    "fvl": Nutrient(
        "fruits-vegetables-legumes-estimate-from-ingredients", "%", "fruits_vegetables_legumes",
        ["fruits-vegetables-legumes", "fruits-vegetables-nuts-estimate-from-ingredients", "fruits-vegetables-nuts"],
    ),
}
NIDS = [nid for n in NUTRIENTS.values() for nid in n.nids]
SUFFIXES = ["_100g", "", "_value", "_unit", "_serving"]
NUTRIMENT_FIELDS = [nid + suffix for nid in NIDS for suffix in SUFFIXES]
V3_SCHEMA = "map<string,struct<value:string,value_computed:string,unit:string,source:string,modifier:string>>"
COMPONENT_SCHEMA = "array<struct<id:string,value:string,unit:string,points:string>>"
UNIT_OF_NID = {nid: n.unit for n in NUTRIENTS.values() for nid in n.nids}
UNIT_OF_COMPONENT = {n.component: n.unit for n in NUTRIENTS.values() if n.component}
PLAIN = ["100g", "aggregated_set", "sin-sufijo", "value"]
SCALED = ["sin-sufijo-racion", "serving", "value-racion"]


def components_map(negative: Column, positive: Column) -> Column:
    """Score components by id; a later one replaces an earlier one."""
    empty = F.array().cast(COMPONENT_SCHEMA)
    both = F.filter(F.concat(F.coalesce(negative, empty), F.coalesce(positive, empty)), lambda c: c["id"].isNotNull())
    last = F.filter(both, lambda c, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda d: d["id"] == c["id"]))
    return F.map_from_entries(F.transform(last, lambda c: F.struct(c["id"].alias("key"), c.alias("value"))))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")")


def typed_sources(df: DataFrame) -> DataFrame:
    """Text leaves to numbers in the target unit. Needs ``nutriments`` (map of text), ``v3`` and
    ``components`` (maps of structs), ``per`` and ``serving``.

    Only fields that the document has are touched: the maps are small where it is sparse.
    """
    units, wanted = _literal_map(UNIT_OF_NID), F.col("nutriments")
    df = df.withColumn("nutriments", F.map_filter(wanted, lambda k, v: k.isin(NUTRIMENT_FIELDS)))
    texts = F.col("nutriments")
    numbers = F.transform_values(F.map_filter(texts, lambda k, v: ~k.endswith("_unit")), lambda k, v: num_nonneg(v))
    nid = lambda k: F.regexp_replace(k, "_value$", "")
    typed = F.transform_values(
        F.map_filter(F.col("n"), lambda k, v: k.endswith("_value")),
        lambda k, v: convert_unit(v, F.try_element_at(texts, F.concat(nid(k), F.lit("_unit"))), F.try_element_at(units, nid(k))))

    def v3_leaf(k: Column, x: Column) -> Column:
        target = F.try_element_at(units, k)
        value = convert_unit(num_nonneg(F.coalesce(x["value"], x["value_computed"])), F.coalesce(x["unit"], target), target)
        mark = (F.when(x["source"] == "estimate", "estimate")
                .when(x["value"].isNull() & x["value_computed"].isNotNull(), "computed")
                .when(x["modifier"] != "", "approx"))
        return F.struct(value.alias("value"), mark.alias("mark"))

    comp_units = _literal_map(UNIT_OF_COMPONENT)
    comp_leaf = lambda k, c: convert_unit(
        num_nonneg(c["value"]), F.coalesce(c["unit"], F.try_element_at(comp_units, k)), F.try_element_at(comp_units, k))
    serving = num_nonneg(F.col("serving"))
    return (df.withColumn("n", numbers)
            .withColumn("typed", typed)
            .withColumn("v3n", F.transform_values(F.map_filter("v3", lambda k, v: F.map_contains_key(units, k)), v3_leaf))
            .withColumn("comp", F.transform_values(F.map_filter("components", lambda k, v: F.map_contains_key(comp_units, k)), comp_leaf))
            .withColumn("per", F.when(F.col("per") == "serving", "serving").otherwise("100g"))
            .withColumn("scale", F.when(serving > 0, F.lit(100.0) / serving))
            .withColumn("trusted", serving_trusted()))


def serving_trusted() -> Column:
    """One factor serves all nutrients, so an impossible energy condemns every scaled value.

    The first energy value present decides; without any there is nothing to contradict.
    """
    return F.expr(f"""CASE WHEN scale IS NULL THEN false ELSE coalesce(
        coalesce(IF(per = 'serving', coalesce(n['energy-kj'], n['energy']), NULL), n['energy-kj_serving'], n['energy_serving'])
            * scale <= {BOUNDS["kJ"]}D,
        coalesce(IF(per = 'serving', n['energy-kcal'], NULL), n['energy-kcal_serving']) * scale <= {BOUNDS["kcal"]}D,
        true) END""")


def rungs(nutrient: Nutrient) -> list[tuple[str, str]]:
    """(origin, value as SQL text) from the most to the least reliable source."""
    ids = nutrient.nids
    out = [("100g", f"n['{i}_100g']") for i in ids]
    out += [("aggregated_set", f"v3n['{i}'].value") for i in ids]
    out += [("sin-sufijo", f"IF(per = '100g', n['{i}'], NULL)") for i in ids]
    out += [("value", f"IF(per = '100g', typed['{i}_value'], NULL)") for i in ids]
    if nutrient.component:
        out.append(("nutriscore", f"comp['{nutrient.component}']"))
    for i in ids:
        out.append(("sin-sufijo-racion", f"IF(per = 'serving', n['{i}'] * scale, NULL)"))
        out.append(("serving", f"n['{i}_serving'] * scale"))
        out.append(("value-racion", f"IF(per = 'serving', typed['{i}_value'] * scale, NULL)"))
    return out


def present(nutrient: Nutrient) -> str:
    """The candidates a document has, in order: array of (value, place)."""
    values = ", ".join(v for _, v in rungs(nutrient))
    return f"filter(transform(array({values}), (v, i) -> struct(v AS value, i AS place)), x -> x.value IS NOT NULL)"


def chosen(nutrient: Nutrient, key: str) -> str:
    """What is kept and what is rejected, from the array in ``cand_<key>``.

    The first candidate present is the one a reader would see at the source: if it is not usable it
    is the rejected one, also where a later candidate serves.
    """
    names = [origin for origin, _ in rungs(nutrient)]
    origins = ", ".join(f"'{o}'" for o in names)
    marks = ", ".join(f"v3n['{i}'].mark" for i in nutrient.nids)
    start, scaled = names.index("aggregated_set"), min(names.index(o) for o in SCALED)
    fits = f"x.value <= {BOUNDS[nutrient.unit]}D"
    usable = f"{fits} AND (x.place < {scaled} OR trusted)"
    winner = f"try_element_at(filter(cand_{key}, x -> {usable}), 1)"
    return f"""transform(array(struct({winner} AS w, try_element_at(cand_{key}, 1) AS x)), p -> struct(
        p.w.value AS value, try_element_at(array({origins}), p.w.place + 1) AS origin,
        IF(p.w.place >= {start} AND p.w.place < {start + len(nutrient.nids)}, array({marks})[p.w.place - {start}], NULL) AS mark,
        IF(p.x IS NULL OR (p.x.value <= {BOUNDS[nutrient.unit]}D AND (p.x.place < {scaled} OR trusted)), NULL, struct(
            '{key}' AS n, floor(p.x.value * 100 + 0.5) / 100D AS v, '{nutrient.unit}' AS u,
            IF(p.x.value <= {BOUNDS[nutrient.unit]}D, 'racion', 'max') AS m,
            try_element_at(array({origins}), p.w.place + 1) AS s)) AS rejected))[0]"""


def with_ladder(df: DataFrame) -> DataFrame:
    with_candidates = df.withColumns({f"cand_{key}": F.expr(present(n)) for key, n in NUTRIENTS.items()})
    return with_candidates.withColumns({f"ladder_{key}": F.expr(chosen(n, key)) for key, n in NUTRIENTS.items()}).drop(
        *[f"cand_{key}" for key in NUTRIENTS], "n", "typed", "v3n", "comp", "scale", "trusted")


# Derivations in order (target, source, factor, origin suffix).
DERIVED = [
    ("energy_kj", "energy_kcal", KJ_PER_KCAL, "kcal"), ("energy_kcal", "energy_kj", 1 / KJ_PER_KCAL, "kj"),
    ("salt", "sodium", 2.5, "sodio"), ("sodium", "salt", 1 / 2.5, "sal"),
]


def with_nutrients(df: DataFrame) -> DataFrame:
    """Adds the 13 values, ``origins`` and ``estimated`` (maps) and ``implausible`` (array).

    Energy and salt/sodium complete each other where one is empty and the result is possible.
    """
    keys = ", ".join(f"'{k}'" for k in NUTRIENTS)
    drop_null = lambda values: F.expr(f"map_filter(map_from_arrays(array({keys}), array({values})), (k, v) -> v IS NOT NULL)")
    rejected = F.expr("array_compact(array(" + ", ".join(f"ladder_{k}.rejected" for k in NUTRIENTS) + "))")
    marks = drop_null(", ".join(f"ladder_{k}.mark" for k in NUTRIENTS))
    rows = df.withColumns({"implausible": rejected, "estimated": marks}
                          | {k: F.col(f"ladder_{k}.value") for k in NUTRIENTS}
                          | {f"from_{k}": F.col(f"ladder_{k}.origin") for k in NUTRIENTS})
    for target, source, factor, suffix in DERIVED:
        computed = bounded(F.col(source) * factor, NUTRIENTS[target].unit)
        rows = rows.withColumns({
            f"from_{target}": F.when(F.col(target).isNull() & computed.isNotNull(),
                                     F.concat_ws(":", f"from_{source}", F.lit(suffix))).otherwise(F.col(f"from_{target}")),
            target: F.coalesce(F.col(target), computed)})
    return rows.withColumn("origins", drop_null(", ".join(f"from_{k}" for k in NUTRIENTS))).drop(
        *[f"ladder_{k}" for k in NUTRIENTS], *[f"from_{k}" for k in NUTRIENTS])


def read_nutrients(df: DataFrame) -> DataFrame:
    return with_nutrients(with_ladder(typed_sources(df)))


def declared_absent(c: Column) -> Column:
    return F.coalesce(c.isin("on", "true"), F.lit(False))
