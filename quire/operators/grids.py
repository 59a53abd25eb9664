"""Tables: cells placed on a grid, and the grid as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def place_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds col_idx: the sum of the spans before a cell in its row. cells: keys, row_idx, cell_pos, col_span."""
    w = Window.partitionBy(*keys, "row_idx").orderBy("cell_pos").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("col_idx", F.coalesce(F.sum("col_span").over(w), F.lit(0)).cast("int"))


def merge_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that continue one above in their column become part of it: row_span counts them.

    cells: as placed, with vmerge (null, 'restart', 'continue'). A cell continues
    the nearest restarted cell above in its first column, over gaps too; one
    without such a cell is a cell of its own.
    """
    column = Window.partitionBy(*keys, "__col").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    id_ = F.struct("row_idx", "col_idx")
    wide = cells.withColumn("__col", F.explode(F.sequence("col_idx", F.col("col_idx") + F.col("col_span") - 1)))
    wide = wide.withColumn("__source", F.last(F.when(F.col("vmerge") == "restart", id_), ignorenulls=True).over(column))
    first = wide.where(F.col("__col") == F.col("col_idx")).drop("__col")
    part = (F.col("vmerge") == "continue") & F.col("__source").isNotNull()
    parts = first.where(part).groupBy(*keys, F.col("__source.row_idx").alias("row_idx"), F.col("__source.col_idx").alias("col_idx")).agg(F.count("*").alias("__parts"))
    own = first.where(~F.coalesce(part, F.lit(False))).drop("__source")
    return own.join(parts, [*keys, "row_idx", "col_idx"], "left").withColumn("row_span", (F.coalesce("__parts", F.lit(0)) + 1).cast("int")).drop("__parts")


def to_markdown(grids: DataFrame) -> DataFrame:
    """Adds markdown. grids: total_rows, total_cols, cells array<struct<row_idx,col_idx,row_span,col_span,content,is_header>>.

    Every place that a cell covers shows its text, the last cell wins; the header
    row is the first header cell's, else row 0, and comes first. No cells or an
    empty grid make an empty text.
    """
    value = "replace(replace(replace(c.content, '|', '\\\\|'), '\\r', ' '), '\\n', ' ')"
    span = lambda start, size, end: f"filter(sequence({start}, {start} + greatest({size}, 1) - 1), x -> x < {end})"
    covered = f"transform({span('c.row_idx', 'c.row_span', 'total_rows')}, r -> transform({span('c.col_idx', 'c.col_span', 'total_cols')}, k -> named_struct('at', cast(r as bigint) * total_cols + k, 'i', i, 'v', {value})))"
    # every place with an empty text and whatever covers it, in order; the last entry of a place shows
    blank = "transform(sequence(0L, cast(total_rows as bigint) * total_cols - 1), a -> named_struct('at', a, 'i', -1, 'v', ''))"
    places = f"sort_array(concat({blank}, flatten(transform(cells, (c, i) -> flatten({covered})))))"
    shown = "transform(filter(__places, (x, j) -> j = size(__places) - 1 or __places[j + 1].at <> x.at), x -> x.v)"
    row = "concat('| ', array_join(slice(__shown, r * total_cols + 1, total_cols), ' | '), ' |')"
    header = "coalesce(try_element_at(filter(cells, c -> c.is_header), 1).row_idx, 0)"
    order = "concat(array(__header), filter(sequence(0, total_rows - 1), r -> r != __header))"
    rule = "concat('| ', array_join(array_repeat('---', total_cols), ' | '), ' |')"
    text = f"array_join(concat(slice(__lines, 1, 1), array({rule}), slice(__lines, 2, size(__lines))), '\\n')"
    has = "total_rows > 0 and total_cols > 0 and size(cells) > 0"
    steps = {"__header": header, "__places": places, "__shown": shown, "__lines": f"transform({order}, r -> {row})", "markdown": text}
    for name, step in steps.items():
        # a second mention of __shown outside the lambda keeps the optimizer from working it out anew for every row
        ready = f"{has} and size(__shown) > 0" if name == "__lines" else has
        grids = grids.withColumn(name, F.expr(f"case when {ready} then {step} end"))
    return grids.withColumn("markdown", F.coalesce("markdown", F.lit(""))).drop(*(x for x in steps if x != "markdown"))
