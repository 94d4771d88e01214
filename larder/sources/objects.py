"""One huge JSON object (or array) as rows, read by many tasks.

A file is cut at every ``}``, which Spark's text reader does for each byte range on its own. What a piece does to
the state of a reader follows from the piece alone: whether it flips being inside a string, and by how much it
changes the depth if it begins outside or inside of one. These maps are composed over the pieces of a byte
range and then over the few ranges of a file, so every piece learns its state and depth, and the entries are cut
where a brace leads back to depth one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): texts between closing braces; block and at give their order."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _depths(parts: Column, odd: int) -> Column:
    """Brackets opened less brackets closed in every second of the parts between quotes."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    return (F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]]", ""))).cast("long")


def _with_maps(pieces: DataFrame) -> DataFrame:
    """Adds flips, and depth0 and depth1: what the piece adds to the depth if it begins outside or inside of a string."""
    # A backslash takes the next sign with it; then only quotes and brackets matter.
    marks = F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), r"[^\"\[\]{]+", "")
    parts = F.split(marks, '"', -1)
    return pieces.withColumn("_parts", parts).select("*", (F.size("_parts") - 1).cast("long").alias("flips"), _depths(F.col("_parts"), 0).alias("depth0"), _depths(F.col("_parts"), 1).alias("depth1")).drop("_parts")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, entry): the entries at depth one of the object or array in each file, each as JSON on its own.

    An entry of an object is an object of its own with its key; entries that aren't objects stand with the next
    object entry, or together behind the last one. An entry of an array must be an object. Only an entry's
    own text is gathered in one task. Files that hold more than one value aren't read rightly; an empty file,
    object or array has no entries.
    """
    inside = Window.partitionBy("file", "block").orderBy("at")  # a byte range, of bounded size
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    over_blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the few ranges of a file
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))

    rows = _with_maps(_pieces(spark, path)).withColumn("_run", sum_before("flips", before))
    # For a range that begins outside (0) or inside (1) of a string; its braces close unless they stand in a string.
    for start in (0, 1):
        begins, ends = (F.col("_run") + start) % 2, (F.col("_run") + start + F.col("flips")) % 2
        rows = rows.withColumns({f"_step{start}": F.when(begins == 0, F.col("depth0")).otherwise(F.col("depth1")) - (ends == 0).cast("long"), f"_closes{start}": ends == 0})
    blocks = rows.groupBy("file", "block").agg(F.sum("flips").alias("_flips"), F.sum("_step0").alias("_step0"), F.sum("_step1").alias("_step1"))
    blocks = blocks.withColumn("_start", sum_before("_flips", over_blocks) % 2)
    blocks = blocks.withColumn("_depth", sum_before(F.when(F.col("_start") == 0, F.col("_step0")).otherwise(F.col("_step1")), over_blocks)).select("file", "block", "_start", "_depth")
    known = rows.join(blocks, ["file", "block"])
    step, closes = (F.when(F.col("_start") == 0, F.col(f"_{x}0")).otherwise(F.col(f"_{x}1")) for x in ("step", "closes"))
    known = known.withColumns({"_step": step, "_closes": closes}).withColumn("_after", F.col("_depth") + F.sum("_step").over(inside))
    known = known.withColumn("_ends", (F.col("_closes") & (F.col("_after") == 1)).cast("long")).withColumn("_nth", sum_before("_ends", before))
    counts = known.groupBy("file", "block").agg(F.sum("_ends").alias("_n")).withColumn("_offset", sum_before("_n", over_blocks)).drop("_n")
    # Behind the end of the value nothing counts.
    placed = known.join(counts, ["file", "block"]).filter("_after - _step > 0 OR _step + CAST(_closes AS INT) > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: F.concat(x["value"], F.lit("}"))), "")
    found = placed.groupBy("file", (F.col("_offset") + F.col("_nth")).alias("no")).agg(text.alias("text"), F.max("_ends").alias("_whole"))
    entry = F.regexp_replace("text", r"^\s*[\[{,]\s*", "")
    # The first sign of a file says whether it holds an object or an array; of later entries the key does.
    keyed = entry.startswith('"')
    whole = F.when(keyed, F.concat(F.lit("{"), entry, F.when(F.col("_whole") == 1, "}").otherwise(""))).when(entry.startswith("{"), entry)
    return found.select("file", "no", whole.alias("entry")).filter("entry IS NOT NULL")


def read_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of an object whose values have the schema ``value``, whatever the size of its file."""
    return entries(spark, path).select(F.explode(F.from_json("entry", f"map<string,{value}>")).alias("key", "value"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of an array as rows."""
    return entries(spark, path).select(F.from_json("entry", schema).alias("_row")).select("_row.*")
