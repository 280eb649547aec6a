"""Capture grids: traversal orders, cells from file names, neighbours, missing and locked edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RIGHT_DOWN = [(0, 1), (1, 0)]
EIGHT_ONCE = [(0, 1), (1, 0), (1, 1), (1, -1)]
#: Fixed value: what a name says of its cell.
NAME = r"^(\d+)[_-](\d+)\.(?:jpe?g)$"


def plan(spark: SparkSession, rows: int, columns: int, order: str = "snake") -> DataFrame:
    """sequence, row, column of a grid in snake, row or column order; no input is read."""
    s = F.col("sequence")
    if order == "column":
        row, column = s % rows, F.expr(f"sequence div {rows}")
    else:
        row, column = F.expr(f"sequence div {columns}"), s % columns
        if order == "snake":
            column = F.when(row % 2 == 1, columns - 1 - column).otherwise(column)
    return spark.range(rows * columns).select(F.col("id").alias("sequence")).select("sequence", row.alias("row"), column.alias("column"))


def plans(grids: DataFrame, key: str, order: str = "snake") -> DataFrame:
    """key, sequence, row, column of every grid (key, rows, columns) in snake, row or column order; grids without cells have no row."""
    sized = grids.where("rows > 0 and columns > 0").select(key, F.col("rows").cast("long").alias("rows"), F.col("columns").cast("long").alias("columns"))
    cells = sized.withColumn("sequence", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") * F.col("columns") - 1)))
    row, column = F.expr("sequence div columns"), F.expr("sequence % columns")
    if order == "column":
        row, column = F.expr("sequence % rows"), F.expr("sequence div rows")
    elif order == "snake":
        column = F.when(row % 2 == 1, F.col("columns") - 1 - column).otherwise(column)
    return cells.select(key, "sequence", row.alias("row"), column.alias("column"))


def corner_orders(grids: DataFrame, key: str) -> DataFrame:
    """All 16 orders of every grid (key, rows, columns): row or column first, from any corner, straight or serpentine."""
    kinds = grids.sparkSession.sql(
        "select * from values ('row'), ('column') a(axis) cross join values (false), (true) b(bottom) "
        "cross join values (false), (true) c(right) cross join values (false), (true) d(serpentine)"
    )
    width = F.when(F.col("axis") == "row", F.col("columns")).otherwise(F.col("rows"))
    sized = grids.where("rows > 0 and columns > 0").select(key, F.col("rows").cast("long").alias("rows"), F.col("columns").cast("long").alias("columns"))
    cells = sized.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") * F.col("columns") - 1))).crossJoin(F.broadcast(kinds)).withColumn("width", width)
    line, step = F.expr("id div width"), F.expr("id % width")
    step = F.when(F.col("serpentine") & (line % 2 == 1), F.col("width") - 1 - step).otherwise(step)
    row = F.when(F.col("axis") == "row", line).otherwise(step)
    column = F.when(F.col("axis") == "row", step).otherwise(line)
    return cells.select(
        key, "axis", "bottom", "right", "serpentine", F.col("id").alias("sequence"),
        F.when(F.col("bottom"), F.col("rows") - 1 - row).otherwise(row).alias("row"),
        F.when(F.col("right"), F.col("columns") - 1 - column).otherwise(column).alias("column"),
    )


def from_names(files: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """keys, name, row, column of captures whose names are all like 3_07.jpg, counted from the least row and column.

    It is all or nothing for each capture (keys): one name of another form, one cell with two names or one cell without any voids its mapping.
    """
    lower = F.lower(name)
    number = lambda k: F.when(lower.rlike(NAME), F.regexp_extract(lower, NAME, k).cast("long"))
    read = files.select(*keys, name, number(1).alias("r"), number(2).alias("c"))
    span = lambda v: F.max(v) - F.min(v) + 1
    whole = (F.count("*") == F.count("r")) & (F.count("*") == F.countDistinct("r", "c")) & (F.count("*") == span("r") * span("c"))
    fine = read.groupBy(*keys).agg(F.min("r").alias("r0"), F.min("c").alias("c0"), whole.alias("whole")).where("whole")
    return read.join(fine, keys).select(*keys, name, (F.col("r") - F.col("r0")).alias("row"), (F.col("c") - F.col("c0")).alias("column"))


def check(cells: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, distinct cells, and whether the grid is complete without duplicates."""
    got = cells.agg((F.max("row") + 1).alias("rows"), (F.max("column") + 1).alias("columns"), F.count("*").alias("cells"), F.countDistinct("row", "column").alias("distinct_cells"))
    return got.withColumn("complete", (F.col("cells") == F.col("rows") * F.col("columns")) & (F.col("cells") == F.col("distinct_cells")))


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(from, to) ids of cells at the offsets: an equi-join on the shifted cell, never a theta join."""
    shift = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])).alias("d")
    wanted = cells.select(F.col("id").alias("from"), "row", "column", shift).select("from", (F.col("row") + F.col("d.r")).alias("row"), (F.col("column") + F.col("d.c")).alias("column"))
    return wanted.join(cells.select(F.col("id").alias("to"), "row", "column"), ["row", "column"]).select("from", "to")


def missing(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """Expected edges that no visual edge covers."""
    return expected.join(edges, ["from", "to"], "left_anti")


def without_locked(edges: DataFrame, locked: DataFrame) -> DataFrame:
    """Edges that touch no locked cell (id)."""
    one = edges.join(locked.select(F.col("id").alias("from")), "from", "left_anti")
    return one.join(locked.select(F.col("id").alias("to")), "to", "left_anti").select(*edges.columns)


def natural_key(name: Column) -> Column:
    """A sort key: text in lower case, digit runs by value (leading zeros dropped, padded to 20)."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    padded = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p))
    return F.array_join(padded, "\x01")
