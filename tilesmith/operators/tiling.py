"""Tile grids of multi-resolution slides, background filter, and the tree over magnifications.

A slide is a row; its tiles come from a narrow explode of the levels asked for, so no level that isn't
wanted is ever enumerated and nothing is shuffled until pixels are read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesmith.functions.ids import _c


def objective_power(properties: Column | str = "properties", key: str = "openslide.objective-power", default: float = 40.0) -> Column:
    """The objective from a property map, else the default. A value that is no whole number stops the job, as the slide is damaged."""
    return F.coalesce(F.element_at(_c(properties), key).cast("int").cast("double"), F.lit(float(default)))


def with_objective(slides: DataFrame, properties: str = "properties", key: str = "openslide.objective-power", default: float = 40.0) -> DataFrame:
    """slides with objective and error: a slide whose property is no whole number above 0 keeps its row, without an objective and with an error."""
    told = F.element_at(F.col(properties), key)
    power = told.try_cast("int")
    bad = told.isNotNull() & ~F.coalesce(power > 0, F.lit(False))
    before = F.col("error") if "error" in slides.columns else F.lit(None).cast("string")
    rows = slides.withColumn("error", F.coalesce(before, F.when(bad, F.concat(F.lit("bad objective power: "), told))))
    return rows.withColumn("objective", F.when(~bad, F.coalesce(power.cast("double"), F.lit(float(default)))))


def level_plan(slides: DataFrame, base_mag: float = 20, levels: tuple[int, ...] = (0,)) -> DataFrame:
    """slides with depth (halvings from full size), mag, dz_level (from 1 x 1 up) and position, one row for each level that exists.

    slides has width, height and objective. The first level is that of base_mag: log2(objective / base_mag),
    cut towards 0. position: 1 for the lowest magnification. Levels above the slide's own
    resolution or below 1 x 1 give no row.
    """
    first = F.log2(F.col("objective") / F.lit(float(base_mag))).cast("int")
    count = F.ceil(F.log2(F.greatest("width", "height").cast("double"))).cast("int") + 1
    wanted = F.array(*(F.lit(m).cast("int") for m in sorted(levels)))
    rows = slides.withColumn("level", F.explode(wanted)).withColumn("depth", F.col("level") + first).withColumn("level_count", count)
    rows = rows.where((F.col("depth") >= 0) & (F.col("depth") < F.col("level_count")))
    mag = F.floor(F.col("objective") / F.pow(F.lit(2.0), F.col("depth"))).cast("int")
    place = F.size(F.filter(wanted, lambda m: m >= F.col("level")))
    return rows.withColumn("mag", mag).withColumn("dz_level", (F.col("level_count") - F.col("depth") - 1).cast("int")).withColumn("position", place).drop("level_count")


def dealt(slides: DataFrame, slide: str = "slide_name") -> DataFrame:
    """slides dealt out by their name, before their tiles are enumerated: a table of slides is small enough for one task, their tiles aren't."""
    return slides.repartition(slide)


def level_size(size: Column | str, depth: Column | str = "depth") -> Column:
    return F.ceil(_c(size) / F.pow(F.lit(2.0), _c(depth))).cast("int")


def tile_grid(plan: DataFrame, tile_size: int = 224) -> DataFrame:
    """plan with col and row of every tile of the level."""
    n = lambda size: F.ceil(level_size(size) / tile_size).cast("int")
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(0), n("height") - 1)))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), n("width") - 1)))


def tile_geometry(grid: DataFrame, tile_size: int = 224, overlap: int = 0) -> DataFrame:
    """grid with x0, y0, w, h in pixels of its level: tiles reach over inner edges by the overlap and end with the level.

    Where the slide is ``bounded``, read_x and read_y give where the tile begins at full size, the bounds' offset included.
    """
    out = grid
    for at, size, name, length in (("col", "width", "x0", "w"), ("row", "height", "y0", "h")):
        start = F.greatest(F.col(at) * tile_size - overlap, F.lit(0))
        end = F.least((F.col(at) + 1) * tile_size + overlap, level_size(size))
        out = out.withColumn(name, start.cast("int")).withColumn(length, (end - start).cast("int"))
    for at, offset, name in (("x0", "offset_x", "read_x"), ("y0", "offset_y", "read_y")):
        if offset in grid.columns:
            out = out.withColumn(name, (F.col(offset) + F.col(at) * F.pow(F.lit(2), F.col("depth"))).cast("int"))
    return out


def bounded(slides: DataFrame) -> DataFrame:
    """slides cut down to their non-empty bounds (bounds struct<x, y, width, height>), where they are known."""
    b = F.col("bounds")
    return slides.withColumn("offset_x", F.coalesce(b["x"], F.lit(0))).withColumn("offset_y", F.coalesce(b["y"], F.lit(0))).withColumn("width", F.coalesce(b["width"], F.col("width"))).withColumn("height", F.coalesce(b["height"], F.col("height")))


#: Names of the properties that give a slide's bounds.
BOUNDS = {"x": "openslide.bounds-x", "y": "openslide.bounds-y", "width": "openslide.bounds-width", "height": "openslide.bounds-height"}


def with_bounds(slides: DataFrame, properties: str = "properties") -> DataFrame:
    """slides with bounds struct<x, y, width, height> from their properties, and error: each part may be missing, and is null then.

    A part that is no whole number, or an empty extent, is an error of its slide, whose bounds are null.
    """
    told = {k: F.element_at(F.col(properties), name) for k, name in BOUNDS.items()}
    parts = {k: F.trim(v).try_cast("int") for k, v in told.items()}
    bad = [F.when(v.isNotNull() & (parts[k].isNull() | (parts[k] < (1 if k in ("width", "height") else 0))), F.concat(F.lit(f"bad bounds {k}: "), v)) for k, v in told.items()]
    before = F.col("error") if "error" in slides.columns else F.lit(None).cast("string")
    wrong = F.coalesce(*bad)
    rows = slides.withColumn("bounds", F.when(wrong.isNull(), F.struct(*(v.alias(k) for k, v in parts.items()))))
    return rows.withColumn("error", F.coalesce(before, wrong))


def foreground(tiles: DataFrame, threshold: float = 15, edge: str = "edge") -> DataFrame:
    """Tiles whose edge score is above the threshold: a higher one drops more."""
    return tiles.where(F.col(edge) > threshold)


def failures(tiles: DataFrame) -> DataFrame:
    """Tiles that could not be read, with their error; never dropped in silence."""
    return tiles.where(F.col("error").isNotNull())


def pending(grid: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("slide_name", "mag", "col", "row")) -> DataFrame:
    """The tiles that aren't stored yet. Neither side is broadcast, as in children_kept."""
    return grid.join(stored.select(*keys).hint("merge"), list(keys), "left_anti")


def _parent_key(high: DataFrame, factor: int) -> DataFrame:
    return high.withColumn("parent_col", F.expr(f"col div {factor}").cast("int")).withColumn("parent_row", F.expr(f"row div {factor}").cast("int"))


def _parents(low: DataFrame, slide: str) -> DataFrame:
    return low.select(F.col(slide).alias("_slide"), F.col("col").alias("_col"), F.col("row").alias("_row"))


def children_kept(high: DataFrame, low: DataFrame, factor: int, slide: str = "slide_name") -> DataFrame:
    """High tiles whose low tile survived, with its position: an equi-join on the divided position.

    Neither side is broadcast: a grid's size is estimated by that of its slides, so that the tiles of many slides would pass the driver.
    """
    h, p = _parent_key(high, factor), _parents(low, slide).hint("merge")
    return h.join(p, (h[slide] == p._slide) & (h.parent_col == p._col) & (h.parent_row == p._row), "left_semi")


def patch_tree(low: DataFrame, high: DataFrame, factor: int, slide: str = "slide_name", drop_childless: bool = False) -> DataFrame:
    """(slide, col, row, child_col, child_row): each low tile with its high tiles; one without any stays, with nulls, unless dropped. Neither side is broadcast, as in children_kept."""
    h = _parent_key(high, factor).select(F.col(slide).alias("_slide"), F.col("col").alias("child_col"), F.col("row").alias("child_row"), "parent_col", "parent_row")
    on = (low[slide] == h._slide) & (low["col"] == h.parent_col) & (low["row"] == h.parent_row)
    return low.join(h.hint("merge"), on, "inner" if drop_childless else "left").select(low[slide], low["col"], low["row"], "child_col", "child_row")


def _spread(x: Column) -> Column:
    """The 32 bits of a position at the even places of a long."""
    x = x.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(col: Column | str = "col", row: Column | str = "row") -> Column:
    """The bits of both positions in turn: of a tile, the code of its parent at half the size is the code without its last two bits."""
    return _spread(_c(col)).bitwiseOR(F.shiftleft(_spread(_c(row)), 1))


def _level_table(table: str, depth: int) -> str:
    return f"{table}_{depth}"


def store_levels(tiles: DataFrame, table: str, depths: tuple[int, ...], path: str | None = None, buckets: int = 200, slide: str = "slide_name") -> None:
    """A bucketed table for each depth of tiles (slide, depth, col, row, ...), with code and top.

    top is the code of the tile's ancestor at the largest of the depths. All levels are bucketed by slide and top, so a tile, its parent
    and its children lie in buckets of the same number at every depth, and a slide spreads over many. path: a folder for the tables, else the
    warehouse. Rows without a position are left out.
    """
    for depth in depths:
        rows = tiles.where((F.col("depth") == depth) & F.col("col").isNotNull() & F.col("row").isNotNull()).withColumn("code", morton())
        rows = rows.withColumn("top", F.shiftright("code", 2 * (max(depths) - depth)))
        out = rows.repartition(buckets, slide, "top").write.mode("overwrite").bucketBy(buckets, slide, "top").sortBy(slide, "top", "code")
        out = out.option("path", f"{path}/{depth}") if path else out
        out.saveAsTable(_level_table(table, depth))


def stored_tree(spark: SparkSession, table: str, depths: tuple[int, ...], slide: str = "slide_name", keep: tuple[str, ...] = ("col", "row")) -> DataFrame:
    """(slide, {column}_{depth}...): each tile of the largest depth with its descendants at all others; where there are none, nulls.

    Neighbouring depths may differ by more than one. Joins are by bucket: no level is shuffled, however many there are, if the session lets
    a join use buckets of some of its keys (spark.sql.requireAllClusterKeysForCoPartition off, as in this engine's sessions). Tiles whose parent
    isn't stored have no row.
    """
    order = sorted(depths, reverse=True)
    out = None
    for i, depth in enumerate(order):
        level = spark.table(_level_table(table, depth)).select(F.col(slide), F.col("top"), F.col("code").alias(f"code_{depth}"), *(F.col(c).alias(f"{c}_{depth}") for c in keep))
        if out is None:
            out = level
            continue
        up = order[i - 1]
        level = level.withColumnsRenamed({slide: "_slide", "top": "_top"})
        on = (out[slide] == F.col("_slide")) & (out["top"] == F.col("_top")) & (F.col(f"code_{up}") == F.shiftright(f"code_{depth}", 2 * (up - depth)))
        out = out.join(level, on, "left").drop("_slide", "_top")
    return out.select(slide, *(f"{c}_{d}" for d in order for c in keep))


def grid_size(width: int, height: int, depth: int, tile_size: int = 224) -> tuple[int, int]:
    """Columns and rows of a level, for planning on the driver."""
    return tuple(ceil(ceil(x / 2**depth) / tile_size) for x in (width, height))
