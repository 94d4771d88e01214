"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

A source's rows are cut into blocks. In one cycle a source with target weight w gets n blocks, n in
proportion to w. Block i of n in a cycle of d slots is released at slot floor(i * d / n) and due
before slot ceil((i + 1) * d / n); earliest deadline first then fills the slots one by one. At any slot
each source is less than one block away from its share, and every cycle ends in exact balance, so
cycles are independent of each other: the order is worked out once for each set of sources that still
has blocks, in a table of a few rows, and all blocks take their slot from it by a join.

A source that runs out leaves the later cycles, where the others keep their proportions. No row is
dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.operators.prefix import with_running

#: Slots of a cycle in which every source takes part; weights are rounded to 1 / PERIOD, one block at least.
PERIOD = 1000


def supplies(rows: DataFrame, source: str, block_rows: int, weights: dict[str, float] | None, temperature: float, period: int = PERIOD) -> DataFrame:
    """(source, blocks, share): blocks a source has and its blocks in a full cycle.

    Without ``weights`` the target of a source is its number of rows to the power ``temperature``.
    A source that ``weights`` doesn't name, or names with 0 or less, gets one block a cycle.
    """
    counted = rows.groupBy(source).agg(F.count(F.lit(1)).alias("_rows"))
    if weights:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.greatest(F.coalesce(F.try_element_at(named, F.col(source)).cast("double"), F.lit(0.0)), F.lit(0.0))
    else:
        weight = F.pow(F.col("_rows").cast("double"), F.lit(float(temperature)))
    # One row a source.
    whole = F.sum("_w").over(Window.partitionBy())
    return counted.withColumn("_w", weight).select(
        source, F.ceil(F.col("_rows") / block_rows).cast("long").alias("blocks"),
        F.greatest(F.lit(1), F.round(F.coalesce(F.try_divide(F.col("_w"), whole), F.lit(0.0)) * period)).cast("long").alias("share"))


def _earliest_deadline(given: Column, slots: Column) -> Column:
    """Index of the source of every slot; ``given`` holds each source's blocks in the cycle."""
    def step(state: Column, slot: Column) -> Column:
        served = state["served"]
        ready = F.transform(given, lambda n, i: F.when(
            (n > F.get(served, i)) & (F.floor(F.get(served, i) * slots / n) <= slot),
            F.struct(F.ceil((F.get(served, i) + 1) * slots / n).alias("due"), i.alias("i"))))
        pick = F.array_min(ready)["i"]
        return F.struct(F.transform(served, lambda x, i: x + F.when(i == pick, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("served"),
                        F.array_append(state["order"], pick).alias("order"))

    start = F.struct(F.transform(given, lambda n: F.lit(0).cast("long")).alias("served"), F.array().cast("array<int>").alias("order"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, step, lambda s: s["order"])


def schedule(supply: DataFrame, source: str) -> DataFrame:
    """(source, block, slot) for all blocks of ``supplies``; blocks and slots count from 0."""
    # One row with all sources, then a row for each run of cycles in which the same blocks are given.
    every = supply.agg(F.sort_array(F.collect_list(F.struct(source, "blocks", "share"))).alias("s"))
    ends = every.select("s", F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0).cast("long")),
        F.transform("s", lambda x: F.floor(x["blocks"] / x["share"])),
        F.transform("s", lambda x: F.ceil(x["blocks"] / x["share"]))))).alias("ends"))
    runs = ends.select("s", "ends", F.posexplode("ends").alias("_p", "from_cycle"))
    runs = runs.withColumn("to_cycle", F.get("ends", F.col("_p") + 1)).filter(F.col("to_cycle").isNotNull())
    given = F.transform("s", lambda x: F.greatest(F.lit(0).cast("long"), F.least(x["share"], x["blocks"] - F.col("from_cycle") * x["share"])))
    runs = runs.withColumn("given", given)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    runs = runs.withColumns({"slots": total(F.col("given")), "before": total(F.transform("s", lambda x: F.least(x["blocks"], F.col("from_cycle") * x["share"])))})
    order = runs.select("s", "from_cycle", "to_cycle", "slots", "before", F.posexplode(_earliest_deadline(F.col("given"), F.col("slots"))).alias("_slot", "_i"))
    turn = Window.partitionBy("from_cycle", "_i").orderBy("_slot")
    turns = order.select(F.get("s", F.col("_i"))[source].alias(source), F.get("s", F.col("_i"))["share"].alias("share"), F.get("s", F.col("_i"))["blocks"].alias("blocks"),
                         "from_cycle", "to_cycle", "slots", "before", "_slot", (F.row_number().over(turn) - 1).alias("_turn"))
    cycles = turns.withColumn("_cycle", F.explode(F.sequence("from_cycle", F.col("to_cycle") - 1)))
    return cycles.select(
        source, (F.col("_cycle") * F.col("share") + F.col("_turn")).alias("block"),
        (F.col("before") + (F.col("_cycle") - F.col("from_cycle")) * F.col("slots") + F.col("_slot")).alias("slot"))


def _scheduled(rows: DataFrame, weights: dict[str, float] | None, temperature: float, block_rows: int, seed: int, period: int) -> DataFrame:
    """``rows`` (_id, _source and others) with block, slot and place; each row has a place of its own."""
    # NULL sources sort and join like the others behind a flag that no name has.
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("")))
    named = {f"s{k}": v for k, v in weights.items()} if weights else None
    plan = schedule(supplies(rows, "_source", block_rows, named, temperature, period), "_source")
    # Rows that share an id and all else are told apart by where they are read; which of them is which doesn't matter.
    rows = rows.withColumns({"_h": F.xxhash64(F.col("_id"), F.lit(seed)), "_nth": F.monotonically_increasing_id()})
    others = [c for c in rows.columns if c not in ("_h", "_id", "_source", "_nth")]
    dealt = with_running(rows, ["_source"], ["_h", "_id", *others, "_nth"])
    placed = dealt.withColumns({"block": F.floor((F.col("rank") - 1) / block_rows), "place": F.pmod(F.col("rank") - 1, F.lit(block_rows)).cast("int")})
    back = F.when(F.col("_source") != "", F.expr("substring(_source, 2)"))
    return placed.join(plan, ["_source", "block"]).select("_id", back.alias("_source"), *others, "block", "slot", "place")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_rows: int = 64,
          id_column: str = "doc_id", source_column: str = "source", seed: int = 42, period: int = PERIOD) -> DataFrame:
    """(id, source, block, slot, place): where each row stands in the mixture.

    Order by slot, then place. Within a source rows are dealt to blocks by a seeded hash of their id. NULL is
    a source like any other. Rows that repeat an id, and rows without one, are rows like the others: each
    has a place, and counts for its source. An empty table gives no rows; other columns don't matter.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("_source"))
    done = _scheduled(rows, weights, temperature, block_rows, seed, period)
    return done.select(F.col("_id").alias(id_column), F.col("_source").alias(source_column), "block", "slot", "place")


def in_mixed_order(docs: DataFrame, id_column: str = "doc_id", slot: str | None = None, place: str | None = None, source_column: str = "source",
                   weights: dict[str, float] | None = None, temperature: float = 0.5, block_rows: int = 64, seed: int = 42, period: int = PERIOD) -> DataFrame:
    """``docs`` with the same rows, sorted as ``mixed`` says; slot and place are added under the names given.

    Columns that have these names are replaced. Equal rows are kept, each in a place of its own; NULL ids and
    sources, empty texts and an empty table are taken as they are.
    """
    kept = [c for c in docs.columns if c not in (slot, place)]
    print_ = F.xxhash64(*[F.col(c) for c in kept])
    rows = docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("_source"), print_.alias("_print"))
    where = _scheduled(rows, weights, temperature, block_rows, seed, period).select(
        F.col("_id").alias("_mixed_id"), F.col("_print").alias("_mixed_print"), F.col("slot").alias("_mixed_slot"), F.col("place").alias("_mixed_place"))
    # One of equal rows meets the places of all of them.
    single = docs.select(*kept, F.col(id_column).alias("_own_id"), print_.alias("_print")).dropDuplicates(["_own_id", "_print"])
    joined = single.join(where, F.col("_own_id").eqNullSafe(F.col("_mixed_id")) & (F.col("_print") == F.col("_mixed_print"))).orderBy("_mixed_slot", "_mixed_place")
    added = [F.col(c).alias(name) for c, name in (("_mixed_slot", slot), ("_mixed_place", place)) if name]
    return joined.select(*kept, *added)


def with_stored_places(docs: DataFrame, slot: str = "slot", place: str = "place", source_column: str = "source", block_rows: int = 64) -> DataFrame:
    """Rows of a stored mixture, sorted as they lie in its files, with slot and place read off that order.

    ``docs`` is read from files that were written in order, as ``in_mixed_order`` gives it. Rows of one source that
    follow each other are a run, cut into blocks of ``block_rows``; only a source's last block can be shorter, and it
    ends its run. Sources are told apart as they are, NULL is one. Columns named like the two are replaced.
    """
    kept = [c for c in docs.columns if c not in (slot, place)]
    stored = docs.select(*kept, F.col("_metadata.file_path").alias("_stored_file"), F.col("_metadata.row_index").alias("_stored_row"))
    in_file = Window.partitionBy("_stored_file").orderBy("_stored_row")
    # Sources and places only. Of a row's run: where it starts in this file.
    named = F.coalesce(F.concat(F.lit("s"), F.col(source_column).cast("string")), F.lit(""))
    rows = stored.select("_stored_file", "_stored_row", named.alias("_name"))
    new = F.lag("_name").over(in_file).isNull() | (F.lag("_name").over(in_file) != F.col("_name"))
    rows = rows.withColumn("_new", new).withColumn("_from", F.max(F.when(F.col("_new"), F.col("_stored_row"))).over(in_file))
    # One row a file: how many rows of the run it starts with lie before it, then how many blocks start before it.
    ends = rows.groupBy("_stored_file").agg(
        F.count(F.lit(1)).alias("_rows"), F.min_by("_name", "_stored_row").alias("_first"), F.max_by("_name", "_stored_row").alias("_last"), F.max("_from").alias("_last_from"))
    files = Window.partitionBy().orderBy("_stored_file")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_goes_on": F.coalesce(F.lag("_last").over(files) == F.col("_first"), F.lit(False))})
    start = F.when((F.col("_last_from") > 0) | ~F.col("_goes_on"), F.col("_before") + F.col("_last_from"))
    ends = ends.withColumn("_start", start)
    ends = ends.select("_stored_file", F.when(F.col("_goes_on"), F.col("_before") - F.last("_start", ignorenulls=True).over(earlier)).otherwise(0).alias("_held"))
    rows = rows.join(ends, "_stored_file").withColumn("_at", F.col("_stored_row") - F.col("_from") + F.when(F.col("_from") == 0, F.col("_held")).otherwise(0))
    opens = F.when(F.col("_at") % block_rows == 0, 1).otherwise(0)
    blocks = rows.groupBy("_stored_file").agg(F.sum(opens).alias("_blocks"))
    blocks = blocks.select("_stored_file", F.coalesce(F.sum("_blocks").over(earlier), F.lit(0)).alias("_blocks_before"))
    slots = F.col("_blocks_before") + F.sum(opens).over(in_file.rowsBetween(Window.unboundedPreceding, 0)) - 1
    places = rows.join(blocks, "_stored_file").select("_stored_file", "_stored_row", slots.cast("long").alias("_stored_slot"), (F.col("_at") % block_rows).cast("int").alias("_stored_place"))
    placed = stored.join(places, ["_stored_file", "_stored_row"]).orderBy("_stored_slot", "_stored_place")
    return placed.select(*kept, F.col("_stored_slot").alias(slot), F.col("_stored_place").alias(place))
