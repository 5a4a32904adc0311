import datetime as dt
import math

from pyspark.sql import functions as F

from itemloom.functions import arrays, cells, names, order


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_natural_order(spark):
    rows = spark.createDataFrame([("run-10",), ("Run-1",), ("run-2",), ("7",), ("",)], "label string")
    assert [r[0] for r in rows.orderBy(order.natural_key("label")).collect()] == ["", "Run-1", "run-2", "run-10", "7"]


def test_roman(spark):
    rows = spark.createDataFrame([("IV",), ("XI",), ("XL",), ("run",), ("",)], "label string")
    assert [r[0] for r in rows.select(order.roman_value("label")).collect()] == [4, 11, 40, None, None]


def test_file_time(spark):
    rows = spark.createDataFrame([("a_20251128_175954_x.csv",), ("b [w ; 2025-10-01 16_27_53].csv",), ("c_20251399_175954_x.csv",), ("d.csv",), (None,), ("20250101_000000.csv",), ("a_20250101_000000.csv",), ("a_20250101_000000_[w ; 2024-05-06 07_08_09]",), ("a_20250101_000000_[w ; 2024-13-06 07_08_09]",)], "n string")
    at = [r[0] for r in rows.select(F.date_format(names.file_time("n"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert at == ["2025-11-28 17:59:54", "2025-10-01 16:27:53", None, None, None, None, None, "2024-05-06 07:08:09", None]


def test_typed_cells(spark):
    texts = ["", " Yes ", "f", "12", "-1.5e3", "2024-02-29", "2024/02/30", "2024-02-29T10:00:00", "0x1F", "1.5d", None, "NaN", "-inf", "+Infinity", "info"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(cells.typed_cell("t").alias("v")).select("v.vtype", cells.show_typed("v").alias("s")).collect()
    assert [tuple(r) for r in rows] == [
        (None, None), ("Bool", "true"), ("Bool", "false"), ("Int64", "12"), ("Float64", "-1500.0000"), ("Date", "2024-02-29"), ("String", "2024/02/30"),
        ("DateTime", "2024-02-29 10:00:00"), ("String", "0x1F"), ("String", "1.5d"), (None, None),
        ("Float64", "NaN"), ("Float64", "-Infinity"), ("Float64", "Infinity"), ("String", "info"),
    ]


def test_arrays(spark):
    rows = spark.createDataFrame([([1.0, 3.0],), ([2.0, 2.0],), ([1.0, float("nan")],), ([],)], "a array<double>")
    got = [r[0] for r in rows.select(arrays.normalized("a")).collect()]
    assert got[0] == [0.0, 1.0] and got[1] == [0.0, 0.0] and all(math.isnan(x) for x in got[2]) and got[3] == []
    assert [r[0] for r in rows.select(arrays.mean("a")).collect()][::3] == [2.0, None]
    assert one(spark, arrays.ratio_or_zero("a", "b"), a=1.0, b=0.0) == 0.0


def test_text(spark):
    assert one(spark, names.cell_text("a"), a="x" * 91) == "x" * 87 + "..."
    assert one(spark, names.cell_text("a"), a="x" * 90) == "x" * 90
    assert one(spark, names.hex_color("r", "g", "b"), r=1, g=255, b=16) == "#01ff10"
    assert tuple(one(spark, names.rgb("c"), c="#01FF10")) == (1, 255, 16)
    assert one(spark, names.rgb("c"), c="red") is None
    assert one(spark, names.split_row("c"), c=" a b  c ") == ["a", "b", "c"]
    assert one(spark, names.split_row("c"), c="a b\t\tc") == ["a b", "c"]
    assert one(spark, names.collection_of("p", F.lit("/root/")), p="/root/x/y/f.txt") == ["x", "y"]
    assert one(spark, names.collection_of("p", F.lit("/root")), p="/root/f.txt") == []
    assert one(spark, names.mint_id("s", F.lit("k"), F.lit(2), F.lit(None).cast("string")), s="src") == "src#k:2"
    assert one(spark, names.label_or("a", "b"), a="", b="z") == "z"


def test_as_number(spark):
    rows = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), (None,), ("1e400",)], "v string")
    assert [r[0] for r in rows.select(cells.as_number("v")).collect()] == [1.5, None, None, None, None]


def test_time_is_a_timestamp(spark):
    assert one(spark, cells.typed_cell("t")["t"], t="2024-02-29") == dt.datetime(2024, 2, 29)
