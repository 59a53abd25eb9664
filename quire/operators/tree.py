"""Chapter trees from a document's ordered heading candidates.

Levels, flags and parents are windows over a document's nodes in order; paths are
joins by pointer doubling. No document is brought together in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quire.functions.text import number_pattern
from quire.plans.shared import cut as shared_cut


def _ordered(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def resolve_levels(candidates: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Candidates with raw_level, source, needs_review, is_node and decided.

    A decision (doc_id, idx, is_title, level) overrules the suggested level; it
    is flagged when it differs from an anchor's or states none. Without a
    decision only anchors are nodes.
    """
    if decisions is None:
        said, joined = F.lit(None).cast("boolean"), candidates.withColumn("level", F.lit(None).cast("int"))
    else:
        chosen = decisions.groupBy("doc_id", "idx").agg(F.max_by(F.struct("is_title", "level"), F.coalesce("seq", F.lit(0))).alias("d")) if "seq" in decisions.columns else decisions.dropDuplicates(["doc_id", "idx"]).select("doc_id", "idx", F.struct("is_title", "level").alias("d"))
        joined = candidates.join(chosen.withColumnRenamed("idx", "para_index"), ["doc_id", "para_index"], "left")
        joined = joined.withColumn("level", F.col("d.level")).withColumn("said", F.col("d.is_title")).drop("d")
        said = F.col("said")
    anchor = F.col("is_anchor") & F.col("suggested_level").isNotNull()
    off = said & anchor & (F.col("level") != F.col("suggested_level"))
    unsure = said & F.col("level").isNull()
    flagged = F.coalesce(off, F.lit(False)) | F.coalesce(unsure, F.lit(False))
    model = flagged | (F.coalesce(said, F.lit(False)) & ~anchor)
    out = joined.select(
        *candidates.columns,
        F.when(said.isNotNull(), F.col("level")).otherwise(F.col("suggested_level")).alias("raw_level"),
        F.when(model, "llm").otherwise("rule").alias("source"),
        flagged.cast("int").alias("needs_review"),
        F.coalesce(said, anchor).alias("is_node"),
        said.isNotNull().alias("decided"),
    )
    return out


def clamp_levels(nodes: DataFrame, key: str = "doc_id", order: str = "para_index", raw: str = "raw_level") -> DataFrame:
    """Adds order_num, level and clamped: a level is at most one more than the one before; a missing one is just that.

    With raw levels r and positions i this is i + min over j <= i of (r_j - j),
    missing values left out, so it is one running minimum.
    """
    w = _ordered(key, order)
    at = F.row_number().over(w) - 1
    placed = nodes.withColumn("order_num", at)
    start = F.when(F.col("order_num") == 0, F.coalesce(F.col(raw), F.lit(1))).otherwise(F.col(raw))
    floor = F.greatest(start, F.lit(1)) - F.col("order_num")
    level = F.col("order_num") + F.min(F.when(start.isNotNull(), floor)).over(w)
    out = placed.withColumn("level", level.cast("int"))
    return out.withColumn("clamped", F.col(raw).isNull() | (F.greatest(F.col(raw), F.lit(1)) > F.col("level")))


def parents(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds parent_order, null for a root.

    nodes: as clamped. Levels rise by one at most, so the last node above a node
    is the last one of the level before its own.
    """
    w = Window.partitionBy(key, "__on").orderBy("order_num").rowsBetween(Window.unboundedPreceding, -1)
    places = F.array(F.struct(F.col("level").alias("__on"), F.lit(True).alias("__opens")), F.struct((F.col("level") - 1).alias("__on"), F.lit(False).alias("__opens")))
    placed = nodes.select("*", F.inline(places))
    return placed.withColumn("parent_order", F.last(F.when(F.col("__opens"), F.col("order_num")), ignorenulls=True).over(w)).where("not __opens").drop("__on", "__opens")


def paths(linked: DataFrame, key: str = "doc_id", name: str = "__name", cut: Callable[[DataFrame], DataFrame] = shared_cut) -> DataFrame:
    """key, order_num, chapter_path: names from the root on, joined by ' / ', for nodes with parent_order.

    Pointer doubling: each node has the names of a stretch of its ancestors and a
    pointer to the one above these; joining a node to where it points doubles both,
    so a tree of depth d takes log2(d) joins of narrow rows, dealt by node, and no
    document is ever one row.
    """
    state = cut(linked.select(key, "order_num", F.col("parent_order").alias("__up"), F.col(name).alias("__path"), "level"))
    deepest = state.agg(F.max("level")).first()[0] or 1  # one number
    state = state.drop("level")
    for step in range(max(0, (deepest - 1).bit_length())):
        above = state.select(F.col(key), F.col("order_num").alias("__at"), F.col("__up").alias("__next"), F.col("__path").alias("__above"))
        at = F.coalesce("__up", -1 - F.col("order_num"))  # roots meet nothing, each by a key of its own
        joined = state.withColumn("__at", at).join(above, [key, "__at"], "left")
        state = joined.select(key, "order_num", F.col("__next").alias("__up"), F.concat_ws(" / ", "__above", "__path").alias("__path"))
        if step % 3 == 2:
            state = cut(state)
    return state.select(key, "order_num", F.col("__path").alias("chapter_path"))


def link_parents(nodes: DataFrame, name: Column, key: str = "doc_id", cut: Callable[[DataFrame], DataFrame] = shared_cut) -> DataFrame:
    """Adds parent_order (null for a root) and chapter_path (names from the root on, joined by ' / '); trees may be of any depth.

    cut: writes a table that is read several times and goes on from what was written.
    """
    linked = cut(parents(nodes.withColumn("__name", name), key))
    return linked.drop("__name").join(paths(linked, key, cut=cut), [key, "order_num"]).select(*nodes.columns, "parent_order", "chapter_path")


def flag_patterns(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """needs_review for all nodes of a number pattern that stands on different levels."""
    w = Window.partitionBy(key, number_pattern(F.col("number_prefix")))
    mixed = F.max("level").over(w) != F.min("level").over(w)
    return nodes.withColumn("needs_review", F.when(mixed, 1).otherwise(F.col("needs_review")))


def flag_near_pending(nodes: DataFrame, pending: DataFrame, key: str = "doc_id") -> DataFrame:
    """needs_review for the node before each candidate that no decision settled. pending: key, para_index."""
    both = nodes.select(key, "para_index", F.col("para_index").alias("node")).unionByName(pending.select(key, "para_index", F.lit(None).cast("int").alias("node")))
    before = F.last("node", ignorenulls=True).over(_ordered(key, "para_index"))
    hit = both.withColumn("before", before).where(F.col("node").isNull() & F.col("before").isNotNull()).select(key, F.col("before").alias("para_index")).distinct().withColumn("hit", F.lit(1))
    joined = nodes.join(hit, [key, "para_index"], "left")
    return joined.withColumn("needs_review", F.when(F.col("hit") == 1, 1).otherwise(F.col("needs_review"))).drop("hit")


def build_tree(candidates: DataFrame, decisions: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = shared_cut) -> DataFrame:
    """Nodes with level, parent_order, order_num, chapter_path, source, needs_review, confidence."""
    resolved = resolve_levels(candidates, decisions)
    nodes = clamp_levels(resolved.where("is_node"))
    nodes = nodes.withColumn("needs_review", F.when(F.col("clamped"), 1).otherwise(F.col("needs_review"))).withColumn("source", F.when(F.col("raw_level").isNull(), "llm").otherwise(F.col("source")))
    nodes = flag_near_pending(nodes, resolved.where("not is_node and not decided").select("doc_id", "para_index"))
    nodes = flag_patterns(nodes)
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("text"), F.lit(""))
    nodes = nodes.withColumn("title", title)
    name = F.when(F.coalesce(F.col("number_prefix"), F.lit("")) != "", F.concat_ws(" ", "number_prefix", "title")).otherwise(F.col("title"))
    linked = link_parents(nodes, name, cut=cut)
    confidence = F.when(F.col("needs_review") == 1, 0.5).when(F.col("source") == "rule", 1.0).otherwise(0.7)
    return linked.withColumn("confidence", confidence).drop("raw_level", "clamped", "is_node", "decided")
