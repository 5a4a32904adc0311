"""What shows on larger tables alone: ties, Python on many items, and memory of tasks."""

import duckdb
import pandas as pd

from itemloom.queries import ORACLE_SQL, QUERIES


def test_lines_of_one_number_stand_in_the_order_of_the_sql(spark, tmp_path):
    lines = pd.DataFrame({"l_orderkey": [6, 6, 6, 7, 7], "l_linenumber": 1, "l_quantity": 5.0, "l_suppkey": [548, 5, 54, 12, 1]})
    spark.createDataFrame(lines.astype({"l_linenumber": "int32"})).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {tuple(r) for r in QUERIES["delimited_read"](spark, str(tmp_path)).select("path", "row", "column", "name", "value").collect()}
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = set(c.execute(ORACLE_SQL["delimited_read"]).fetchall())
    assert found == wanted
    assert [v for _, _, c, _, v in sorted(r for r in found if r[0] == "6") if c == 3] == ['5,"x"', '54,"x"', '548,"x"']


def _rows(spark, items):
    """Rows of items (id, values), as interpreted, with the item's id as metadata."""
    flat = [(i, 1, None, "c", r, v) for i, values in items for r, v in enumerate(values)]
    rows = spark.createDataFrame(flat, "item_id string, source_item_id bigint, entry string, collection_id string, __row bigint, n bigint").repartition(3, "__row")
    return rows.selectExpr("*", "map('who', item_id) AS metadata", "map('who', 'string') AS metadata_types")


def test_many_items_in_one_batch_are_apart(spark):
    from itemloom.plans import project

    big = 2**60 + 1
    items = [("a", [big, 2]), ("b", [3, None]), ("c", [5]), ("d", list(range(25_000))), *((f"e{i:03}", [i]) for i in range(300))]
    seen = lambda rows, known: {"of": f"{known['who']} {rows['n'].dtype} {len(rows)}", "sum": rows["n"].sum()}

    def fails_for_c(rows, known):
        if known["who"] == "c":
            raise ValueError("no c")
        return rows.assign(m=rows["n"])

    found = {(r["item_id"], r["name"]): r["value"] for r in project.analyze_items(_rows(spark, items), seen).collect()}
    assert found["a", "of"] == "a int64 2" and found["a", "sum"] == str(big + 2)
    assert found["b", "of"] == "b float64 2" and found["d", "of"] == "d int64 25000" and found["d", "sum"] == str(sum(range(25_000)))
    assert len(found) == 2 * len(items)
    out = project.process_items(_rows(spark, items), fails_for_c, "m bigint").collect()
    assert [r["_error"] for r in out if r["item_id"] == "c"] == ["ValueError: no c"]
    held = {i: [r["m"] for r in sorted((r for r in out if r["item_id"] == i), key=lambda r: r["__row"])] for i in "abd"}
    assert held == {i: v for i, v in items if i in "abd"}


def test_python_runs_once_for_each_item(spark, tmp_path):
    from pyspark.sql import functions as F

    from itemloom.plans.project import ItemRecipe, Project
    from itemloom.plans.refresh import LiveCatalogue
    from itemloom.plans.store import Store

    calls = tmp_path / "calls"
    calls.mkdir()

    def told(stage, known):
        with open(calls / stage, "a") as f:
            f.write(known["who"] + "\n")

    def process(rows, known):
        told("process", known)
        if known["who"] == "3":
            raise ValueError("three")
        return rows

    def analyze(rows, known):
        told("analyze", known)
        return {"n": len(rows)}

    read = lambda s: s.select("source_item_id", F.lit(1.0).alias("x"))
    recipe = ItemRecipe("k", F.lit(True), read, collection=F.array(F.lit("c")), metadata={"who": F.col("source_item_id")}, process=process, process_schema="x double", analyze=analyze)
    live = LiveCatalogue(Project().register(recipe), Store(spark, str(tmp_path / "store")))
    live.refresh(spark.range(1, 6).select(F.col("id").alias("source_item_id"), F.lit("").alias("label"), F.lit("").alias("path"), F.lit("1").alias("fingerprint")))
    assert sorted((calls / "process").read_text().split()) == list("12345")
    assert sorted((calls / "analyze").read_text().split()) == list("1245")
    assert {r["source_item_id"]: r["message"] for r in live.failures().collect()}.keys() == {3}


def _below_exchange(df):
    """The part of a plan under its last shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.rindex("Exchange") :]


def test_text_is_not_aggregated_before_it_is_dealt(spark):
    from itemloom.operators import changes, metadata

    layers = spark.createDataFrame([("i", 0, "x", "a", "string"), ("i", 4, "x", "b", "string")], "entity_id string, layer int, name string, value string, vtype string")
    log = layers.selectExpr("*", "1L AS revision", "'upsert' AS op")
    for df in (metadata.fold(layers), metadata.fold_typed(layers), changes.latest(log, "entity_id", "layer", "name", by="entity_id")):
        assert "Aggregate" not in _below_exchange(df)
    assert [r["value"] for r in metadata.fold(layers).collect()] == ["b"]


def test_a_task_reads_a_bounded_part_of_a_shuffle(spark):
    from itemloom.session import prepare

    assert prepare(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_a_sniff_reads_lines_once_and_counts_rows_behind_any_line(spark, monkeypatch):
    from itemloom.sources import delimited

    files = {"a": "# x\nalone\n\nk,v\n1,2\nloose\n# y\n3,4\n", "b": "1;2\n\n3;4;5,6\n", "c": "one\n\ntwo\n", "d": "t\n#\n\ti\tj\nu\n,\n"}
    lines = delimited.lines_of(spark.createDataFrame(list(files.items()), "path string, value string").repartition("path"))
    want = {"a": (4, 5, 4, 2), "b": (None, 1, 2, 2), "c": (None, None, None, None), "d": (3, 4, 2, 3)}
    for size in (1 << 16, 3, 2, 1):
        monkeypatch.setattr(delimited, "CHUNK_LINES", size)
        df = delimited.sniff(lines)
        assert {r["path"]: (r["header_row"], r["data_start"], r["data_rows"], r["width"]) for r in df.collect()} == want, size
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate ") == 1 and "Join" not in plan


def test_readers_of_payloads_compute_rows_once(spark, tmp_path):
    from itemloom.queries import live
    from itemloom.session import stored

    data, kept = "/root/testdata/sf0.001", []
    seen = live._catalogue(spark, data, keep=lambda name, df: kept.append(name) or stored(df, name, str(tmp_path / name))).payloads
    assert sorted(kept) == ["folds-large", "folds-small", "rows-large", "rows-small"]
    for kind, plain in live._catalogue(spark, data).payloads.items():
        plan = seen[kind]._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        rows = lambda df: sorted(map(tuple, df.select("item_id", "l_extendedprice", "scaled", "share").collect()))
        assert rows(seen[kind]) == rows(plain)


def _shuffle_files(spark):
    import os

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    import time

    from itemloom.plans.store import Store
    from itemloom.session import stored

    rows = spark.range(1000).selectExpr("id % 7 AS k", "cast(id AS string) AS v").repartition(3, "v").groupBy("k").max("k").selectExpr("k", "`max(k)` AS m")
    before = _shuffle_files(spark)
    log = Store(spark, str(tmp_path / "s")).append("x", rows, 0, "upsert")
    assert stored(rows, "x", str(tmp_path / "t")).count() == log.count() == 7
    for _ in range(50):  # files are removed in the background; those of counts are a few bytes and stay
        left = [f for f in _shuffle_files(spark) - before if f.endswith(".data")]
        if len(left) <= 2:
            break
        time.sleep(0.1)
    assert len(left) <= 2, left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_what_a_revision_writes_is_folded_as_it_stands(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from itemloom.plans.project import CollectionRecipe, ItemRecipe, Project
    from itemloom.plans.refresh import LiveCatalogue
    from itemloom.plans.store import Store

    read = lambda s: s.select("source_item_id", F.explode(F.sequence(F.lit(1), F.col("source_item_id"))).alias("y"))
    recipe = ItemRecipe("k", F.lit(True), read, collection=F.array("label"), process={"entry": F.lit("lost"), "collection_id": F.lit("lost"), "z": F.col("y") * 2})
    group = CollectionRecipe("k", folds={"top": F.max("z")}, process={"share": F.col("z") / F.col("top")}, analyze={"rows": F.count(F.lit(1)), "high": F.max("z")})
    listing = lambda last: spark.createDataFrame([(i, "ab"[i % 2], "", str(i if i < 4 else i + last)) for i in range(1, 5)], "source_item_id bigint, label string, path string, fingerprint string")
    live = LiveCatalogue(Project().register(recipe).register(group), Store(spark, str(tmp_path / "live")))
    with monkeypatch.context() as m:
        m.setattr(LiveCatalogue, "_payload", lambda *a, **k: 1 / 0)  # nothing is looked up of what was written just now
        live.refresh(listing(0))
    values = lambda: sorted((r["name"], r["value"]) for r in live.collections().collect())
    want = [("high", "6"), ("high", "8"), ("rows", "4"), ("rows", "6")]
    assert values() == want and {"source_item_id", "entry", "collection_id"}.isdisjoint(live.payload("k").columns)
    assert live.refresh(listing(1)).changed == 1 and values() == want
    assert sorted(r["share"] for r in live.payload("k", "collected").collect()) == sorted([1 / 3, 1 / 3, 2 / 3, 1.0, *(y / 4 for y in (1, 2, 1, 2, 3, 4))])


def test_a_node_is_named_alike_at_any_depth(spark):
    from pyspark.sql import functions as F

    from itemloom.operators import hierarchy

    paths = [[], ["a"], ["a", "b/c"], ["a", "b", "c"], ["a", "b", "c", "ü"], ["a", None], list("abcde"), list("abcdefg"), None]
    rows = spark.createDataFrame([(p,) for p in paths], "p array<string>")
    got = rows.select(hierarchy.node_id("p").alias("a"), F.try_element_at(hierarchy.id_path("p"), F.lit(-1)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and len({r["a"] for r in got}) == 7


def test_effective_metadata_are_sorted_once(spark):
    from itemloom.plans import pipeline

    rows = [("i", 0, "x", "low", "string"), ("i", 2, "x", "7", "bigint"), ("i", 1, "x", "mid", "string"), ("i", 4, "x", "found", "string"), ("i", 0, "y", "a", "string"), ("j", 3, "x", "b", "string")]
    maps = pipeline.effective_maps(spark.createDataFrame(rows, "entity_id string, layer int, name string, value string, vtype string"))
    assert "SortAggregate" not in maps._jdf.queryExecution().executedPlan().toString()
    got = {r["item_id"]: (r["metadata"], r["metadata_types"]) for r in maps.collect()}
    assert got == {"i": ({"x": "7", "y": "a"}, {"x": "bigint", "y": "string"}), "j": ({"x": "b"}, {"x": "string"})}


def test_tables_of_items_in_a_batch_are_their_own(spark):
    from itemloom.plans import project

    def first(rows, known):
        rows.loc[0, "n"] = -1
        rows["m"] = list(rows.index)
        return {"of": f"{rows['n'].tolist()} {rows['m'].tolist()}"}

    found = {r["item_id"]: r["value"] for r in project.analyze_items(_rows(spark, [("a", [1, 2]), ("b", [3]), ("c", [4, 5, 6])]), first).collect()}
    assert found == {"a": "[-1, 2] [0, 1]", "b": "[-1] [0]", "c": "[-1, 5, 6] [0, 1, 2]"}
