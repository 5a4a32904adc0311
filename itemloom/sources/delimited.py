"""Delimited text whose layout is not known: delimiter, header and first data row are found for many files in one job.

Lines of all files are rows (path, line_no from 1, line). A large file is read in splits, its lines are numbered from the
splits' counts, and quotes that stay open at a line's end are followed over chunks of lines, each of which is cut for both
states that it may begin in, so no task holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import sized, stored

#: Lines of a file that one group of a window holds.
CHUNK_LINES = 1 << 16
#: Candidates in order of preference, and the lines that vote.
DELIMITERS = [",", "\t", ";"]
VOTING_LINES = 80
_ON_LINE = r'[^"\n]'
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def lines_of(files: DataFrame) -> DataFrame:
    """path, line_no, line from files (path, value: whole text); a trailing line break ends the last line."""
    text = F.regexp_replace("value", r"\r?\n\z", "")
    return files.select("path", F.posexplode(F.split(text, r"\r?\n", -1)).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, root: str, recursive: bool = True, folder: str | None = None) -> DataFrame:
    """path, line_no, line of all files below root, as lines_of gives them, with files cut into splits of
    spark.sql.files.maxPartitionBytes. An empty file is not seen, as Spark's readers pass it by.

    The lines are kept once as a table in `folder` (by default a new one under spark.checkpoint.dir), so that their order
    within a split is fixed whatever reads them; the counts of splits, one row each, give the numbers."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive).text(root)
    split = F.col("_metadata.file_block_start")
    kept = stored(text.select(F.col("_metadata.file_path").alias("path"), split.alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r\z", "").alias("line")), "lines", folder)
    sizes = kept.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(sizes.select("path", "split", (before - F.col("first") + 1).alias("shift")), "splits")
    return kept.join(sized(starts), ["path", "split"]).select("path", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def fields(line: Column, delimiter: str) -> Column:
    """Trimmed fields of a line, empty ones kept; a blank line or a comment (#) has none."""
    text = F.trim(line)
    cut = F.split(text, delimiter, -1)
    return F.when((text == "") | F.startswith(text, F.lit("#")), F.array().cast("array<string>")).otherwise(F.transform(cut, lambda x: F.trim(x)))


def by_delimiter(line: Column, delimiter: Column, cut=fields) -> Column:
    """cut(line, d), where the delimiter d is a column of one of the candidates."""
    out = F.array().cast("array<string>")
    for d in DELIMITERS:
        out = F.when(delimiter == d, cut(line, d)).otherwise(out)
    return out


def _in_quotes(text: str = '[^"]') -> str:
    """Text up to a quote that is not doubled; repetitions never go back, so length costs no stack."""
    return f'{text}*+(?:""{text}*+)*+'


def cells(line: Column, delimiter: str) -> Column:
    """Fields of a data row, where one in double quotes may hold the delimiter, and two quotes in it stand for one. A row of
    several lines has fields whose quotes are closed on a later line: there, at the first single quote that ends the field."""
    text, d = F.trim(line), f"[{delimiter}]"
    lines = rf' *+"{_in_quotes(_ON_LINE)}\n{_until_closed(d)}" *+(?={d}|\z)'
    # each field comes with the delimiter before it, the first one with one of its own
    parts = F.regexp_extract_all(F.concat(F.lit(delimiter), text), F.lit(rf'{d}({_closed(d)}|{lines}|[^{delimiter}]*+)'), F.lit(1))
    plain = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')
    quoted = F.transform(F.transform(parts, lambda x: F.trim(x)), lambda x: F.when(F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"')) & (F.length(x) > 1), plain(x)).otherwise(x))
    return F.when(F.contains(text, F.lit('"')) & ~F.startswith(text, F.lit("#")), quoted).otherwise(fields(line, delimiter))


def _closed(d: str) -> str:
    """A field in quotes, on one line."""
    return rf' *+"{_in_quotes(_ON_LINE)}" *+(?={d}|\z)'


def _until_closed(d: str) -> str:
    """What follows in a field whose quotes were opened on an earlier line: up to a quote that ends the field."""
    return rf'[^"]*+(?:"(?:"|(?! *+(?:{d}|\z)))[^"]*+)*+'


def _opens(d: str) -> str:
    """The rest of a line, from the start of a field, whose last field opens quotes and has no other single one."""
    opening = rf' *+"{_in_quotes()}\z'
    return rf'(?:(?>{_closed(d)}|(?!{opening})[^{d[1:-1]}]*+){d})*+{opening}'


def _quotes_after(line: Column, delimiter: Column) -> tuple[Column, Column]:
    """Whether (1, 0) quotes are open after a line, if they were not before it, and if they were."""
    outside, inside = F.lit(False), F.lit(True)
    for c in DELIMITERS:
        d = f"[{c}]"
        outside = F.when(delimiter == c, F.rlike(line, F.lit(f"^{_opens(d)}"))).otherwise(outside)
        inside = F.when(delimiter == c, F.rlike(line, F.lit(rf'^{_until_closed(d)}(?:\z|" *+{d}{_opens(d)})'))).otherwise(inside)
    any_ = F.contains(line, F.lit('"'))
    return (any_ & ~F.startswith(F.trim(line), F.lit("#")) & outside).cast("int"), (~any_ | inside).cast("int")


def records(lines: DataFrame) -> DataFrame:
    """path, row from 1, line: data rows, of one line or several, from the lines of data (path, line_no, line, delimiter).

    Quotes open at the end of a line go on to the next one. Quotes that no later line of the file closes are text: their line
    and those after it stand for themselves. Blank lines and comments between rows are none.

    A line turns the state before it (quotes open or not) into that after it: to a fixed one, or keeps it, or swaps it. So the
    state after any line is the last fixed one, or the chunk's first, swapped by the parity of swaps since. Each chunk is
    summed up for both first states, and these sums, one row a chunk, settle which state each chunk begins in."""
    in_chunk = Window.partitionBy("path", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    odd = lambda c: F.pmod(c, F.lit(2))
    off, on = _quotes_after(F.col("line"), F.col("delimiter"))
    filled = (F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#"))
    # all uses of the lines share one shuffle: its filters are stated here, and what a line does is one number
    known = " AND ".join(f"{c} IS NOT NULL" for c in ("path", "line_no", "chunk", "line", "delimiter"))
    turn = (off + 2 * on + 4 * filled.cast("int")).alias("turn")
    turned = lines.withColumn("chunk", F.expr(f"line_no div {CHUNK_LINES}")).where(known).select("path", "chunk", "line_no", "line", "delimiter", turn).repartition("path", "chunk")
    turned = turned.withColumns({n: F.getbit("turn", F.lit(i)).cast("int") for i, n in enumerate(("off", "on", "filled"))})
    turned = turned.withColumn("swap", (F.col("off") > F.col("on")).cast("int")).withColumns({"swaps": F.sum("swap").over(in_chunk), "seen": F.sum("filled").over(in_chunk)})
    # a fixed state, as it would be with no swap in the chunk so far
    turned = turned.withColumn("fixed", F.when(F.col("off") == F.col("on"), odd(F.col("off") + F.col("swaps"))))
    turned = turned.withColumn("last", F.last("fixed", True).over(in_chunk)).withColumns({"last0": F.lag("last").over(Window.partitionBy("path", "chunk").orderBy("line_no")), "swaps0": F.col("swaps") - F.col("swap")})
    before = lambda s: odd(F.coalesce("last0", s) + F.col("swaps0"))

    began = lambda s: before(F.lit(s)) == 0
    ends = {f"rows{s}": F.sum(F.when(began(s), F.col("filled")).otherwise(0)) for s in (0, 1)} | {f"start{s}": F.max(F.when(began(s), F.struct("line_no", "seen"))) for s in (0, 1)}
    sums = turned.groupBy("path", "chunk").agg(F.max_by("last", "line_no").alias("last"), F.sum("swap").alias("swap"), F.sum("filled").alias("filled"), *(c.alias(n) for n, c in ends.items()))
    so_far = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    earlier, whole = so_far.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    sums = sums.withColumn("swaps", F.sum("swap").over(so_far))
    # last is counted from the chunk's first line, so swaps before the chunk are added to take them away again
    sums = sums.withColumn("fixed", F.when(F.col("last").isNotNull(), odd(F.col("last") + F.col("swaps") - F.col("swap"))))
    after = odd(F.coalesce(F.last("fixed", True).over(so_far), F.lit(0)) + F.col("swaps"))
    sums = sums.withColumn("after", after).withColumn("first", F.coalesce(F.lag("after").over(Window.partitionBy("path").orderBy("chunk")), F.lit(0)))
    pick = lambda n: F.when(F.col("first") == 0, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))
    sums = sums.withColumns({"start": pick("start"), "rows": pick("rows"), "final": F.max_by("after", "chunk").over(whole)})
    sums = sums.withColumn("loose", F.when(F.col("final") == 1, F.max("start.line_no").over(whole)))
    loose_at = F.expr(f"loose div {CHUNK_LINES}")
    rows = F.when(F.col("loose").isNull() | (F.col("chunk") < loose_at), F.col("rows")).when(F.col("chunk") > loose_at, F.col("filled"))
    sums = sums.withColumn("rows", rows.otherwise(F.col("rows") + F.col("filled") - F.col("start.seen")))
    chunks = sums.select("path", "chunk", "first", "loose", F.last("start.line_no", True).over(earlier).alias("open_row"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))

    told = turned.join(chunks, ["path", "chunk"])
    alone = F.coalesce(F.col("line_no") >= F.col("loose"), F.lit(False))
    told = told.withColumns({"before": F.when(alone, 0).otherwise(before(F.col("first"))), "after": F.when(alone, 0).otherwise(odd(F.coalesce("last", "first") + F.col("swaps")))})
    counted = F.sum(F.when(F.col("before") == 0, F.col("filled")).otherwise(0)).over(in_chunk)
    start = F.coalesce(F.last(F.when(F.col("before") == 0, F.col("line_no")), True).over(in_chunk), F.col("open_row"))
    told = told.withColumns({"start": start, "row": F.when(F.col("before") == 0, F.col("rows_before") + counted)})
    one = told.where("before = 0 AND after = 0 AND filled = 1").select("path", "row", "line", "delimiter")
    # the lines of a row meet in their chunk; only rows that cross its ends, two at most, meet again
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    several = told.where("before = 1 OR after = 1").groupBy("path", "chunk", "start").agg(F.max("row").alias("row"), listed.alias("l"), F.max_by("after", "line_no").alias("after"), F.first("delimiter").alias("delimiter"))
    several = several.withColumn("crosses", (F.col("after") == 1) | (F.expr(f"start div {CHUNK_LINES}") != F.col("chunk")))
    crossing = several.where("crosses").groupBy("path", "start").agg(F.max("row").alias("row"), F.flatten(F.array_sort(F.collect_list(F.struct("chunk", "l")))["l"]).alias("l"), F.first("delimiter").alias("delimiter"))
    joined = lambda df: df.select("path", "row", F.array_join("l.line", "\n").alias("line"), "delimiter")
    return one.unionByName(joined(several.where("NOT crosses"))).unionByName(joined(crossing))


def sniff(lines: DataFrame) -> DataFrame:
    """path, delimiter, header_row, data_start, has_header, data_rows, width for each file.

    The delimiter with most further fields over the first lines wins, of equals the earlier candidate; files where none
    has any get null. The first line with two fields or more is the header, unless all of them are numbers: then the file
    has no header, header_row is null, and that line is the first of data. Fields are counted at delimiters, in quotes or
    not. Each file's lines are read and cut once: within a chunk of lines, and then over a file's chunks, it is known how
    many filled lines come before the first one with two fields, whichever delimiter wins."""
    text = F.trim("line")
    filled = F.coalesce(text != "", F.lit(False))
    width = lambda d: F.when(filled & ~F.startswith(text, F.lit("#")), F.length(text) - F.length(F.replace(text, F.lit(d), F.lit(""))) + 1).otherwise(0)
    named = lambda d: F.exists(F.split(text, d, -1), lambda x: ~F.rlike(F.trim(x), F.lit(_NUMBER)))
    each = range(len(DELIMITERS))
    cut = lines.select("path", F.expr(f"line_no div {CHUNK_LINES}").alias("chunk"), "line_no", filled.alias("filled"), *(width(d).alias(f"w{i}") for i, d in enumerate(DELIMITERS)), "line")
    cut = cut.select("path", "chunk", "line_no", "filled", *(f"w{i}" for i in each), *(F.when(F.col(f"w{i}") >= 2, named(d)).alias(f"h{i}") for i, d in enumerate(DELIMITERS)))
    so_far = Window.partitionBy("path", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({f"narrow{i}": F.col("filled") & (F.max(f"w{i}").over(so_far) < 2) for i in each})
    vote = lambda i: F.sum(F.when(F.col("line_no") <= VOTING_LINES, F.greatest(F.col(f"w{i}") - 1, F.lit(0))).otherwise(0))
    first = lambda i: F.min(F.when(F.col(f"w{i}") >= 2, F.struct("line_no", F.col(f"w{i}").alias("width"), F.col(f"h{i}").alias("header"))))
    sums = {k: v for i in each for k, v in {f"score{i}": vote(i), f"first{i}": first(i), f"before{i}": F.count_if(f"narrow{i}")}.items()}
    chunks = cut.groupBy("path", "chunk").agg(F.count_if("filled").alias("filled"), *(c.alias(n) for n, c in sums.items()))
    chunks = chunks.withColumns({f"first{i}": F.min(f"first{i}").over(Window.partitionBy("path")) for i in each})
    before = lambda i: F.sum(F.when(F.col("chunk") <= F.expr(f"first{i}.line_no div {CHUNK_LINES}"), F.col(f"before{i}")))
    shape = lambda i, d: F.struct(F.sum(f"score{i}").alias("score"), F.lit(-i).alias("order"), F.lit(d).alias("delimiter"), F.min(f"first{i}").alias("first"), before(i).alias("before"))
    seen = chunks.groupBy("path").agg(F.sum("filled").alias("filled"), *(shape(i, d).alias(f"c{i}") for i, d in enumerate(DELIMITERS)))
    best = seen.select("path", "filled", F.greatest(*(f"c{i}" for i in each)).alias("b"))
    header = F.col("b.first.header").cast("int")
    told = lambda c: F.when(F.col("b.score") > 0, c)
    return best.select(
        "path", told(F.col("b.delimiter")).alias("delimiter"), told(F.when(F.col("b.first.header"), F.col("b.first.line_no"))).alias("header_row"),
        told(F.col("b.first.line_no") + header).alias("data_start"), told(F.col("b.first.header")).alias("has_header"),
        told(F.col("filled") - F.col("b.before") - header).alias("data_rows"), told(F.col("b.first.width")).alias("width"),
    )


def read_rows(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """path, row, names, values: data rows of all files (see records), names verbatim from the header (one line) and null for
    files without one; quoted cells without their quotes, those of several lines with \\n between them. What is known of each
    file is kept as a table of one row a file, and joined to its lines by broadcast if such rows are few."""
    cut = by_delimiter(F.col("line"), F.col("delimiter"), cells)
    known = stored(layouts.where("delimiter IS NOT NULL AND data_start IS NOT NULL").select("path", "delimiter", "header_row", "data_start"), "layouts")
    heads = lines.join(sized(known), "path").where(F.col("line_no") == F.col("header_row")).select("path", cut.alias("names"))
    heads = stored(heads, "heads")
    data = lines.join(sized(known), "path").where(F.col("line_no") >= F.col("data_start"))
    rows = records(data.select("path", "line_no", "line", "delimiter"))
    return rows.join(sized(heads), "path", "left").select("path", "row", "names", cut.alias("values"))


def cell(name: str) -> Column:
    """The value of a named column in read_rows, null where the row or its file has none."""
    at = F.array_position("names", name)
    return F.when(at > 0, F.try_element_at("values", at.cast("int")))


def read_table(lines: DataFrame, layouts: DataFrame, limit: int | None = None) -> DataFrame:
    """path, row, column, name, value: cells of all files in long form, of rows as read_rows gives them, columns without a
    name being column1, column2, …; with limit, of the first rows of each file."""
    rows = read_rows(lines, layouts)
    if limit is not None:
        rows = rows.where(F.col("row") <= limit)
    cells_ = rows.select("path", "row", "names", F.posexplode("values").alias("at", "value"))
    name = F.coalesce(F.try_element_at("names", F.col("at") + 1), F.concat(F.lit("column"), (F.col("at") + 1).cast("string")))
    return cells_.select("path", "row", (F.col("at") + 1).alias("column"), name.alias("name"), "value")


def layout_errors(layouts: DataFrame) -> DataFrame:
    """path, message of files in which no table was found."""
    return layouts.where("delimiter IS NULL OR data_start IS NULL").select("path", F.lit("no delimiter found").alias("message"))
