"""Tags, notes and layout files, read in bulk from lines (path, line_no, line) and written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import split_row

_HEX = r"^#?[0-9A-Fa-f]{6}$"


def parse_tags(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog: path, name, color, priority, position; assignments: path, key, tag; errors: path, line_no, message).

    Sections are headed [catalog] and [assignments]; blank lines and # comments are passed over. Errors are rows with
    other fields than their section asks for, rows outside of any section, and headings of unknown sections, whose rows are
    outside of any. Good rows of a file with errors are returned all the same: `require_parsed` refuses the file."""
    text = F.trim("line")
    heading = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]")) & ~F.startswith(text, F.lit("#"))
    name = F.trim(F.substring(text, F.lit(2), F.length(text) - 2))
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("heading", F.when(heading, name)).withColumn("section", F.last("heading", ignorenulls=True).over(order))
    rows = marked.where((text != "") & ~F.startswith(text, F.lit("#"))).withColumn("f", split_row("line"))
    known = F.col("section").isin("catalog", "assignments")
    good = F.when(F.col("section") == "catalog", (F.size("f") == 3) & F.rlike(F.try_element_at("f", F.lit(2)), F.lit(_HEX)) & F.try_element_at("f", F.lit(3)).try_cast("bigint").isNotNull()).when(
        F.col("section") == "assignments", F.size("f") == 2
    )
    rows = rows.withColumn("good", F.when(F.col("heading").isNotNull(), known).otherwise(F.coalesce(good, F.lit(False))))
    field = lambda n: F.col("f")[n - 1]
    cells = rows.where("good AND heading IS NULL")
    catalog = cells.where("section = 'catalog'").select("path", field(1).alias("name"), F.concat(F.lit("#"), F.lower(F.ltrim(field(2), F.lit("#")))).alias("color"), field(3).cast("bigint").alias("priority"), F.col("line_no").alias("position"))
    assigned = cells.where("section = 'assignments'").select("path", field(1).alias("key"), field(2).alias("tag")).distinct()
    message = F.when(F.col("heading").isNotNull(), F.lit("unknown section: ")).when(F.coalesce(known, F.lit(False)), F.lit("malformed row: ")).otherwise(F.lit("row outside of any section: "))
    errors = rows.where("NOT good").select("path", "line_no", F.concat(message, text).alias("message"))
    return catalog, assigned, errors


def require_parsed(errors: DataFrame) -> None:
    """Raises for the first errors (path, line_no, message) of the files, if there are any."""
    found = [f"{r['path']}, line {r['line_no']}: {r['message']}" for r in errors.orderBy("path", "line_no").limit(10).collect()]
    if found:
        raise ValueError("; ".join(found))


def format_tags(catalog: DataFrame, assignments: DataFrame) -> DataFrame:
    """path, value: the text of each file, which parses back to the same rows."""
    line = lambda *c: F.concat_ws("\t", *(F.col(x).cast("string") for x in c))
    one = catalog.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", line("name", "color", "priority").alias("t")))).alias("c"))
    two = assignments.groupBy("path").agg(F.sort_array(F.collect_list(line("key", "tag"))).alias("a"))
    text = F.concat_ws("\n", F.lit("[catalog]"), F.transform("c", lambda x: x["t"]), F.lit("[assignments]"), F.col("a"))
    return one.join(two, "path", "full").select("path", F.concat(text, F.lit("\n")).alias("value"))


def _sections(lines: DataFrame) -> DataFrame:
    """lines with `text` (trimmed), `fences` (up to and with this line), `body` (between fences), and `mark`, which tells
    headings, fences and stray text apart outside of bodies."""
    text = F.trim("line")
    order = Window.partitionBy("path").orderBy("line_no")
    marked = lines.withColumn("text", text).withColumn("fences", F.sum((text == "```").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("body", (F.col("fences") % 2 == 1) & (text != "```"))
    heading = F.rlike(text, F.lit(r"^\[.*\S.*\]$"))
    mark = F.when(text == "```", F.when(F.col("fences") % 2 == 1, F.lit("open")).otherwise(F.lit("close"))).when(heading, F.lit("heading")).when(text != "", F.lit("stray"))
    return marked.withColumn("mark", F.when(~F.col("body"), mark))


def parse_notes(lines: DataFrame) -> DataFrame:
    """path, key, body: each [key] line followed by a fenced block; lines inside a fence are body whatever they look like.

    A fence is a line of ``` alone. Of a key's sections the last counts. note_errors has what does not fit."""
    marked = _sections(lines)
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(F.col("mark") == "heading", F.trim(F.substring("text", F.lit(2), F.length("text") - 2)))
    keyed = marked.withColumn("key", F.last(key, ignorenulls=True).over(order))
    opened = keyed.where("(body OR mark = 'open') AND key IS NOT NULL").groupBy("path", "key", "fences").agg(
        F.array_sort(F.collect_list(F.when(F.col("body"), F.struct("line_no", "line")))).alias("lines")
    )
    text = opened.select("path", "key", "fences", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"))
    return text.groupBy("path", "key").agg(F.max_by("body", "fences").alias("body"))


def note_errors(lines: DataFrame) -> DataFrame:
    """path, line_no, message: text outside of any section, a heading without a fence after it, a fence without a heading
    before it, and a fence that is never closed."""
    marked = _sections(lines).where("mark IS NOT NULL")
    order = Window.partitionBy("path").orderBy("line_no")
    beside = marked.withColumns({"before": F.lag("mark").over(order), "after": F.lead("mark").over(order)})
    message = (
        F.when(F.col("mark") == "stray", F.lit("text outside of any section"))
        .when((F.col("mark") == "heading") & ~F.col("after").eqNullSafe(F.lit("open")), F.lit("no fence after the heading"))
        .when((F.col("mark") == "open") & ~F.col("before").eqNullSafe(F.lit("heading")), F.lit("no heading before the fence"))
        .when((F.col("mark") == "open") & ~F.col("after").eqNullSafe(F.lit("close")), F.lit("the fence is never closed"))
    )
    return beside.select("path", "line_no", message.alias("message")).where("message IS NOT NULL")


def format_notes(notes: DataFrame) -> DataFrame:
    """path, value from notes (path, key, body); empty bodies are left out."""
    part = F.concat(F.lit("["), F.col("key"), F.lit("]\n```\n"), F.col("body"), F.lit("\n```\n"))
    return notes.where("body <> ''").groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(part)), "\n").alias("value"))


def parse_layout(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, key, x, y; errors: path, line_no, message) from rows `key <tab> x <tab> y`; a repeated key's last row counts."""
    cells = F.split("line", "\t", -1)
    rows = lines.where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#"))).withColumn("f", cells)
    x, y = (F.trim(F.try_element_at("f", F.lit(n))).try_cast("double") for n in (2, 3))
    good = F.coalesce((F.size("f") == 3) & x.isNotNull() & y.isNotNull(), F.lit(False))
    placed = rows.where(good).select("path", F.col("f")[0].alias("key"), "line_no", x.alias("x"), y.alias("y"))
    last = placed.groupBy("path", "key").agg(F.max_by(F.struct("x", "y"), "line_no").alias("p")).select("path", "key", "p.x", "p.y")
    return last, rows.where(~good).select("path", "line_no", F.concat(F.lit("malformed row: "), "line").alias("message"))


def format_layout(positions: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", "key", F.col("x").cast("string"), F.col("y").cast("string"))
    return positions.groupBy("path").agg(F.concat(F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n")).alias("value"))
