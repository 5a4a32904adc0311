"""Parameter files: a header with a path column first, then one row of typed cells for each collection path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import typed_cell


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragment, name, value: typed cell; errors: path, message) from lines (path, line_no, line).

    A later row for a path replaces the earlier one whole. Cells are not quoted. Blank cells are absent. A header of fewer
    than two columns is an error of its file, which then has no rows."""
    filled = lines.where(F.trim("line") != "").withColumn("f", F.transform(F.split("line", ",", -1), lambda x: F.trim(x)))
    first = Window.partitionBy("path").orderBy("line_no")
    numbered = filled.withColumn("n", F.row_number().over(first)).withColumn("names", F.first("f").over(first))
    errors = numbered.where("n = 1 AND size(f) < 2").select("path", F.lit("a path column and one more are needed").alias("message"))
    rows = numbered.where("n > 1 AND size(names) >= 2").withColumn("fragment", F.array_join(F.filter(F.split(F.col("f")[0], "/", -1), lambda x: x != ""), "/"))
    last = rows.groupBy("path", "fragment").agg(F.max(F.struct("line_no", "f", "names")).alias("r"))
    cells = last.select("fragment", F.posexplode("r.names").alias("at", "name"), F.col("r.f").alias("f")).where("at > 0")
    typed = cells.select("fragment", "name", typed_cell(F.try_element_at("f", F.col("at") + 1)).alias("value"))
    return typed.where("value IS NOT NULL"), errors
