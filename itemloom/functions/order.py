"""Order keys of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import Cols, col

#: Roman digits.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50}


def natural_key(label: Cols) -> Column:
    """Sorts digit runs as numbers and other runs by their lower case; text before digits, shorter before longer."""
    runs = F.regexp_extract_all(col(label), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda x: F.rlike(x, F.lit(r"^\d"))
    return F.transform(
        runs,
        lambda x: F.struct(
            F.when(digits(x), F.lit(1)).otherwise(F.lit(0)).alias("kind"),
            F.when(digits(x), F.try_to_number(x, F.lit("9" * 38))).otherwise(F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("number"),
            F.when(digits(x), F.lit("")).otherwise(F.lower(x)).alias("text"),
        ),
    )


def is_roman(label: Cols) -> Column:
    """Whether the label is made of the digits I, V, X and L alone."""
    return F.coalesce(F.rlike(col(label), F.lit("^[IVXLivxl]+$")), F.lit(False))


def roman_value(label: Cols) -> Column:
    """The value of a Roman numeral, a smaller digit before a larger one counting negative; null for other labels."""
    digit = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    digits = F.transform(F.reverse(F.filter(F.split(F.upper(col(label)), ""), lambda c: c != "")), lambda c: F.element_at(digit, c))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda a, d: F.struct((a["sum"] + F.when(d < a["last"], -d).otherwise(d)).alias("sum"), F.greatest(a["last"], d).alias("last"))
    return F.when(is_roman(label), F.aggregate(digits, start, step, lambda a: a["sum"]))
