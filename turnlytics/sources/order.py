"""The order of rows over many files, whatever tasks read them.

Spark packs files and parts of files into tasks by size, so counting rows per task says nothing about their order.  A row's place is its
file's path, the start of the block that a task read of it, and a count that rises within the block; places sort like the rows of all
files, read one after the other in the order of their paths.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = "struct<file:string,block:bigint,row:bigint>"


def _from_files(rows: DataFrame) -> bool:
    try:
        rows.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """Rows as a reader gives them, with their place; rows that come from no file have only the count."""
    found = _from_files(rows)
    file, block = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start")) if found else (F.lit(""), F.lit(0).cast("long"))
    return rows.select("*", F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row")).alias(name))


def numbered(rows: DataFrame, name: str = "row_number", place: str = "place") -> DataFrame:
    """Rows with a place and a number from 0 on over all files, the same for every packing.

    A first pass counts the rows of each block, a second one adds the number of rows before the block.  Both passes plan the same
    scan; what lies between them is a row per block of a file.
    """
    rows = rows if place in rows.columns else placed(rows, place)
    blocks = rows.groupBy(F.col(f"{place}.file").alias("__file"), F.col(f"{place}.block").alias("__block")).agg(F.min(f"{place}.row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    line = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("__file", "__block", (F.coalesce(F.sum("__n").over(line), F.lit(0)) - F.col("__first")).alias("__offset"))
    joined = rows.join(before, (F.col(f"{place}.file") == F.col("__file")) & (F.col(f"{place}.block") == F.col("__block")))
    return joined.withColumn(name, F.col(f"{place}.row") + F.col("__offset")).drop("__file", "__block", "__offset")
