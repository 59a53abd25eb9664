"""Automatic numbering: counters of each list and level, and the text that a template makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.numbers import FORMATS, number_text

LEVELS = 9


def render(items: DataFrame, levels: DataFrame) -> DataFrame:
    """number_text of each numbered item.

    items: doc_id, num_id, ilvl, order (unique in a document). levels: doc_id,
    num_id, ilvl, num_fmt, lvl_text, start, start_override. Items whose level is
    undefined, a bullet or of an unknown format get no text and don't count. A
    column lvl_restart, if there is one, names a level (from 0) that also resets
    the level it stands at. Of items with a column shown all count, but only
    those where it holds get a text and stay.

    A level's counter starts over whenever a higher level counts, so it is the
    number of its items since then: a running count less its value when a higher
    level last counted. All levels share one sort of each list.
    """
    first = F.coalesce("start_override", "start", F.lit(1))
    restart = F.col("lvl_restart") if "lvl_restart" in levels.columns else F.lit(None).cast("int")
    spec = levels.groupBy("doc_id", "num_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("ilvl"), F.struct("num_fmt", "lvl_text", first.alias("first"), restart.alias("restart"))))).alias("spec"))
    joined = items.join(spec, ["doc_id", "num_id"])
    own = F.col("spec")[F.col("ilvl")]
    joined = joined.where(own["num_fmt"].isin([f for f in FORMATS if f != "bullet"]))
    lists = Window.partitionBy("doc_id", "num_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    runs = [F.count(F.when(F.col("ilvl") == k, 1)).over(lists).alias(f"__c{k}") for k in range(LEVELS)]
    counted = joined.select("*", *runs)
    # a running count only grows, so its value at the last higher level is the greatest there
    resets = [(F.col("ilvl") < k) | F.coalesce((F.col("ilvl") != k) & (F.col("spec")[F.lit(k)]["restart"] == F.col("ilvl")), F.lit(False)) for k in range(LEVELS)]
    past = [F.max(F.when(resets[k], F.col(f"__c{k}"))).over(lists).alias(f"__r{k}") for k in range(LEVELS)]
    counted = counted.select("*", *past)
    counted = counted.where("shown") if "shown" in items.columns else counted
    # one array of all levels' values, so that the formats are one expression and not one for each level
    values = []
    for k in range(LEVELS):
        level = F.col("spec")[F.lit(k)]
        value = F.coalesce(level["first"], F.lit(1)) + F.greatest(F.lit(0), F.col(f"__c{k}") - F.coalesce(f"__r{k}", F.lit(0)) - 1)
        values.append(F.struct(F.coalesce(level["num_fmt"], F.lit("decimal")).alias("num_fmt"), value.cast("long").alias("value"), F.lit(f"%{k + 1}").alias("mark")))
    used = F.filter(F.array(*values), lambda x: own["lvl_text"].contains(x["mark"]))
    shown = F.transform(used, lambda x: F.struct(x["mark"].alias("mark"), number_text(x["num_fmt"], x["value"]).alias("shown")))
    text = F.aggregate(shown, own["lvl_text"], lambda out, x: F.replace(out, x["mark"], x["shown"]))
    drop = ["spec", *(f"__{x}{k}" for x in "cr" for k in range(LEVELS))]
    return counted.withColumn("number_text", text).drop(*drop)
