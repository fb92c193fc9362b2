"""Joins on page geometry: boxes, labels and glyphs in points.

Joins are on the page and a cell of its height, with the exact bounds as
residuals: what stands on other lines never meets, however full a page is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How far a tick box may stand from its label, the ink that ticks it, and how far a label reaches.
SAME_LINE, BEFORE, REACH, TICKED = 7, -3, 130, 0.15
LABEL_LINE, CLIP = 4, 3
#: Height of a cell; a line's neighbours are in its cell or one beside it.
CELL = 16


def cell(y: Column) -> Column:
    return F.floor(y / CELL)


def beside(df: DataFrame, y: Column, reach: float) -> DataFrame:
    """A row for each cell that is within reach of y."""
    return df.withColumn("cell", F.explode(F.sequence(cell(y - reach), cell(y + reach))))


def on_line(labels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pairs of labels and boxes of a page that stand on one line."""
    pairs = beside(labels, F.col("y"), SAME_LINE).join(boxes.withColumn("cell", cell(F.col("y0"))), ["page", "cell"])
    return pairs.where(F.abs(F.col("y0") - F.col("y")) <= SAME_LINE)


def nearest_box(labels: DataFrame, boxes: DataFrame) -> DataFrame:
    """For each label (page, label, x, y) the box (page, box, x0, y0) right of it on its line that is nearest; ties to the smaller box."""
    gap = F.col("x0") - F.col("x")
    near = on_line(labels, boxes).where((gap >= BEFORE) & (gap < REACH))
    return near.groupBy("page", "label").agg(F.min(F.struct(gap.alias("gap"), "box")).alias("m")).select("page", "label", "m.box", "m.gap")


def nth_box(labels: DataFrame, boxes: DataFrame, n: int) -> DataFrame:
    """The n-th box (from 0) right of each label on its line."""
    near = on_line(labels, boxes).where(F.col("x0") >= F.col("x"))
    rank = F.row_number().over(W.partitionBy("page", "label").orderBy("x0", "box"))
    return near.withColumn("rank", rank).where(F.col("rank") == n + 1).select("page", "label", "box")


def spread(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row for each cell between two heights."""
    return df.withColumn("cell", F.explode(F.sequence(cell(low), cell(F.greatest(low, high)))))


def inside(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, point, region) for centres within a region's edges."""
    j = points.withColumn("cell", cell(F.col("y"))).join(spread(regions, F.col("y0"), F.col("y1")), ["page", "cell"])
    return j.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select("page", "point", "region")


def overlap(marks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Share of each box under marks (page, mx0, my0, mx1, my1), and whether that ticks it. A pair counts in the first cell that both have."""
    side = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    area = side(F.col("mx0"), F.col("mx1"), F.col("x0"), F.col("x1")) * side(F.col("my0"), F.col("my1"), F.col("y0"), F.col("y1"))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    pairs = spread(boxes, F.col("y0"), F.col("y1")).join(spread(marks, F.col("my0"), F.col("my1")), ["page", "cell"])
    ink = pairs.where(F.col("cell") == cell(F.greatest("y0", "my0"))).groupBy("page", "box").agg(F.sum(area).alias("ink"))
    j = boxes.select("page", "box", size.alias("size")).join(ink, ["page", "box"], "left").withColumn("ink", F.coalesce("ink", F.lit(0.0)))
    return j.select("page", "box", F.round(F.col("ink") / F.col("size"), 4).alias("share"), (F.col("ink") > F.col("size") * TICKED).alias("ticked"))


def value_region(labels: DataFrame, start: float, width: float) -> DataFrame:
    """Where the value right of each label (page, label, x0, x1, y) may stand: (x_from, x_to), cut off before the next label on its line."""
    own = labels.withColumn("x_from", F.col("x1") + start)
    others = labels.select("page", F.col("label").alias("other"), F.col("x0").alias("ox"), F.col("y").alias("oy")).withColumn("cell", cell(F.col("oy")))
    pairs = beside(own, F.col("y"), LABEL_LINE).join(others, ["page", "cell"])
    near = (F.abs(F.col("oy") - F.col("y")) <= LABEL_LINE) & (F.col("other") != F.col("label")) & (F.col("ox") > F.col("x_from") + LABEL_LINE) & (F.col("ox") < F.col("x_from") + width)
    cut = pairs.where(near).groupBy("page", "label").agg((F.min("ox") - CLIP).alias("cut"))
    return own.join(cut, ["page", "label"], "left").select("page", "label", "x_from", F.coalesce("cut", F.col("x_from") + width).alias("x_to"))


def anchors(runs: DataFrame, name: str) -> DataFrame:
    """The first run (page, text, x, y) of each text on a page, from the top and then from the left."""
    return runs.groupBy("page", F.col("text").alias(name)).agg(F.min(F.struct("y", "x")).alias("at")).select("page", name, F.col("at.x").alias(f"{name}_x"), F.col("at.y").alias(f"{name}_y"))


def cells(rows: DataFrame, cols: DataFrame, specs: DataFrame) -> DataFrame:
    """Cells of fields (field, row, col, h, hw): from the row's anchor the height, from the column's the left edge. specs has a fixed size."""
    j = anchors(rows, "row").join(F.broadcast(specs), "row").join(anchors(cols, "col"), ["page", "col"])
    left = F.col("col_x") - 5
    return j.select("page", "field", left.alias("x0"), (F.col("row_y") - F.col("h")).alias("y0"), (left + 2 * F.col("hw")).alias("x1"), (F.col("row_y") + F.col("h")).alias("y1"))


def lines(glyphs: DataFrame, height: float = 4.0) -> DataFrame:
    """Line number of each glyph (page, glyph, x, top): a line takes glyphs less than height below its first one.

    The comparison is with a line's head, so it is a fold over the page's sorted
    glyphs (one page is bounded), not a window over neighbours.
    """
    ordered = F.array_sort(F.collect_list(F.struct("top", "x", "glyph")))
    start = F.struct(F.lit(-1e18).alias("head"), F.lit(-1).alias("line"), F.array().cast("array<struct<glyph:bigint,line:int>>").alias("out"))

    def step(done, g):
        new = g["top"] - done["head"] >= height
        line = done["line"] + new.cast("int")
        return F.struct(F.when(new, g["top"]).otherwise(done["head"]).alias("head"), line.alias("line"), F.concat(done["out"], F.array(F.struct(g["glyph"].cast("long").alias("glyph"), line.alias("line")))).alias("out"))

    return glyphs.groupBy("page").agg(F.aggregate(ordered, start, step, lambda d: d["out"]).alias("out")).select("page", F.inline("out"))
