"""Names, paths, ids, colours and what file names say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = str | Column


def col(c: Cols) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mint_id(source: Cols, kind: Cols, position: Cols, key: Cols | None = None) -> Column:
    """An item's id: source#kind:key, or its position among its siblings where it has no key."""
    last = col(position).cast("string") if key is None else F.coalesce(col(key).cast("string"), col(position).cast("string"))
    return F.concat(col(source).cast("string"), F.lit("#"), col(kind), F.lit(":"), last)


def label_or(label: Cols, fallback: Cols) -> Column:
    """The label, or the source's own where it is null or empty."""
    return F.coalesce(F.nullif(col(label), F.lit("")), col(fallback))


def parts(path: Cols) -> Column:
    """Non-empty segments of a slash path."""
    return F.filter(F.split(col(path), "/", -1), lambda x: x != "")


def base_name(path: Cols) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def directory(path: Cols) -> Column:
    """The path without its last segment."""
    return F.regexp_replace(col(path), "/[^/]*$", "")


def relative(path: Cols, root: Cols) -> Column:
    """The path below root, or the path itself if it is not below."""
    head = F.concat(F.regexp_replace(col(root), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(col(path), head), F.substring(col(path), F.length(head) + 1, F.length(col(path)))).otherwise(col(path))


def collection_of(path: Cols, root: Cols) -> Column:
    """Default collection of a file: the directories between root and the file."""
    segments = parts(relative(path, root))
    return F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))


def stem(name: Cols) -> Column:
    return F.regexp_replace(col(name), r"\.[^.]*$", "")


def name_fields(name: Cols, separator: str = "_") -> Column:
    """Fields of a file name without its extension."""
    return F.split(stem(name), separator, -1)


def split_row(line: Cols) -> Column:
    """Cells of a row: at tabs if it has one, else at white space; empty cells go."""
    text = F.trim(col(line))
    cells = F.when(F.contains(text, F.lit("\t")), F.split(text, "\t", -1)).otherwise(F.split(text, r"\s+", -1))
    return F.filter(F.transform(cells, lambda x: F.trim(x)), lambda x: x != "")


#: How file names carry a time, in order of precedence.
_SPACED_TIME = r"; (\d{4}-\d{2}-\d{2}) (\d{2})_(\d{2})_(\d{2})\]"
_DENSE_TIME = r"_(\d{8})_(\d{6})_"


def file_time(name: Cols) -> Column:
    """When a file was taken, from `; YYYY-MM-DD HH_MM_SS]` in its name or else from `_YYYYMMDD_HHMMSS_`.

    A name of the first form whose digits are no time has none, even if it is of the second form too."""
    piece = lambda p, i: F.regexp_extract(col(name), p, i)
    spaced = F.concat(piece(_SPACED_TIME, 1), F.lit(" "), F.concat_ws(":", *(piece(_SPACED_TIME, i) for i in (2, 3, 4))))
    dense = F.concat(piece(_DENSE_TIME, 1), piece(_DENSE_TIME, 2))
    return F.when(F.rlike(col(name), F.lit(_SPACED_TIME)), F.try_to_timestamp(spaced, F.lit("yyyy-MM-dd HH:mm:ss"))).otherwise(F.try_to_timestamp(dense, F.lit("yyyyMMddHHmmss")))


def rgb(color: Cols) -> Column:
    """red, green, blue of `#rrggbb`; null if it is no such colour."""
    part = lambda at: F.conv(F.substring(col(color), at, 2), 16, 10).cast("int")
    return F.when(F.rlike(col(color), F.lit("^#[0-9A-Fa-f]{6}$")), F.struct(part(2).alias("red"), part(4).alias("green"), part(6).alias("blue")))


def hex_color(red: Cols, green: Cols, blue: Cols) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(col(c).cast("long"))), 2, "0") for c in (red, green, blue)))


def cell_text(value: Cols) -> Column:
    """A cell as text of at most 90 characters; of a longer one the first 87 and an ellipsis."""
    text = col(value).cast("string")
    return F.when(F.length(text) > 90, F.concat(F.substring(text, 1, 87), F.lit("..."))).otherwise(text)
