import pytest
from pyspark.sql import functions as F

from itemloom.operators import analysis, annotations, changes, hierarchy, metadata, profile, selection, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


@pytest.fixture(scope="module")
def tree(spark):
    return hierarchy.nodes(spark.createDataFrame([(["runs", "A"],), (["runs", "B"],), (["x", "A"],), ([],)], "path array<string>"))


def test_nodes(tree):
    assert rows(tree, "label", "depth") == [("A", 2), ("A", 2), ("B", 2), ("runs", 1), ("x", 1)]
    assert tree.select("collection_id").distinct().count() == 5  # equal labels under two parents


def test_ids_are_injective(spark):
    paths = spark.createDataFrame([(["a/1:b"],), (["a", "b"],), (["a/b"],), (["a:", "b"],)], "path array<string>")
    assert paths.select(F.element_at(hierarchy.id_path("path"), -1)).distinct().count() == 4


def test_prune_and_affected(spark, tree):
    leaf = tree.where("label = 'B'").select("collection_id")
    assert rows(hierarchy.kept_nodes(tree, leaf), "label") == [("B",), ("runs",)]
    assert hierarchy.affected(tree, leaf).count() == 2
    assert hierarchy.kept_nodes(tree, leaf.limit(0)).count() == 0


def test_fragments(spark):
    paths = spark.createDataFrame([(["runs", "A"],), (["runs", "B"],)], "path array<string>")
    params = spark.createDataFrame([("runs/A", "scale", "2"), ("runs/B", "scale", "3"), ("A", "scale", "9"), ("runs", "gain", "1")], "fragment string, name string, value string")
    join = F.concat_ws("/", "path")
    assert rows(metadata.by_suffix(paths, params), join, "name", "value") == [("runs/A", "scale", "2"), ("runs/B", "scale", "3")]
    assert ("runs/A", "gain", "1") in rows(metadata.by_fragment(paths, params), join, "name", "value")


def test_layers(spark):
    df = spark.createDataFrame([("i", "a", None)], "id string, x string, y string")
    both = metadata.layer(df, "id", 0, {"x": "x", "y": "y"}).unionByName(metadata.layer(df, "id", 3, {"x": F.lit("late")}))
    assert rows(metadata.fold(both)) == [("i", "x", "late")]


def test_type_registry_does_not_depend_on_row_order(spark):
    values = [(2, "x", "String"), (1, "x", "Float64"), (3, "x", None), (4, "y", "Bool")]
    for data in (values, values[::-1]):
        df = spark.createDataFrame(data, "position int, name string, vtype string")
        registry = metadata.register_types(df)
        assert rows(registry, "name", "vtype") == [("x", "Float64"), ("y", "Bool")]
        assert rows(metadata.type_conflicts(df, registry), "position") == [(2,)]


def test_view_renames_clashes(spark):
    items = spark.createDataFrame([("a", "k")], "item_id string, kind string")
    wide = spark.createDataFrame([("a", "other", 1)], "entity_id string, kind string, n int")
    view = metadata.query_view(items, wide)
    assert view.columns == ["item_id", "kind", "kind_1", "n"]
    assert rows(selection.query_items(view, "kind = 'k' AND kind_1 = 'other'")) == [("a",)]


def test_text_filter(spark):
    df = spark.createDataFrame([("Alpha one",), ("beta",), ("alpha two",)], "t string")
    assert rows(df.where(selection.text_filter("alpha,-two", "t"))) == [("Alpha one",)]
    assert df.where(selection.text_filter("", "t")).count() == 3
    assert rows(df.where(selection.text_filter("-alpha", "t"))) == [("beta",)]


def test_missing_selection(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    with pytest.raises(KeyError, match="zz"):
        selection.require_all(items, spark.createDataFrame([("a",), ("zz",)], "item_id string"))


def test_root_items_are_a_group(spark):
    items = spark.createDataFrame([("a", None, None), ("b", "c", "2024")], "item_id string, collection_id string, ts string")
    assert rows(selection.items_of(items, items.where("collection_id IS NULL")), "item_id") == [("a",)]


def test_plot_pairs(spark):
    df = spark.createDataFrame([(1.0, True), (float("nan"), True), (float("inf"), False), (None, True), (2.0, False)], "x double, b boolean")
    assert rows(selection.plot_pairs(df, "x", "b")) == [(1.0, 1.0), (2.0, 0.0)]
    assert selection.plot_pairs(df.withColumn("s", F.lit("t")), "x", "s").count() == 0


def test_merge(spark):
    a, b = spark.createDataFrame([(1, 2), (3, 4)], "x int, y int"), spark.createDataFrame([(5, 6), (7, 8)], "y int, z int")
    merged = tables.merge([("1", a), ("2", b)])
    assert merged.columns == ["x", "y", "z", "_item_"] and merged.count() == 4
    assert sorted(r["_item_"] for r in merged.collect()) == ["1", "1", "2", "2"]
    assert tables.merge([("1", a)]).columns == ["x", "y"]


def test_annotations(spark, tree):
    placed = tree.where("depth = 2").withColumn("x", F.when(F.col("label") == "A", 0.0).otherwise(200.0)).withColumn("y", F.when(F.col("label") == "A", 0.0).otherwise(150.0)).select("collection_id", "x", "y")
    box = annotations.bounding_boxes(tree, placed).join(tree.where("label = 'runs'").select("collection_id"), "collection_id")
    assert rows(box, "x0", "y0", "x1", "y1") == [(0.0, 0.0, 200.0, 150.0)]
    assert [annotations.grid_columns(n) for n in (0, 1, 4, 7)] == [0, 1, 2, 3]


def test_tags(spark):
    nodes = spark.createDataFrame([("a/b", ["a"]), ("a", [])], "key string, ancestors array<string>")
    tags = spark.createDataFrame([("a", "t"), ("a/b", "u"), ("a/b", "none")], "key string, tag string")
    effective = annotations.effective_tags(nodes, tags)
    assert rows(effective) == [("a", "t"), ("a/b", "none"), ("a/b", "t"), ("a/b", "u")]
    catalog = spark.createDataFrame([("t", "#111111", 1, 1), ("u", "#222222", 1, 2)], "name string, color string, priority int, position int")
    assert rows(annotations.dominant_colors(effective, catalog)) == [("a", "#111111"), ("a/b", "#111111")]
    assert annotations.with_catalog_entry(catalog, "t", "#0", 0).count() == 2
    assert annotations.with_catalog_entry(catalog, "bad", "#0", 0).count() == 3


def test_diff_without_fingerprint_is_changed(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (5, "e")], "source_item_id int, fingerprint string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (4, "d")], "source_item_id int, fingerprint string")
    assert rows(changes.diff(old, new)) == [(1, "same"), (2, "changed"), (3, "changed"), (4, "new"), (5, "removed")]


def test_latest(spark):
    log = spark.createDataFrame([("a", 1, "upsert", 1), ("a", 2, "upsert", 2), ("b", 1, "upsert", 3), ("b", 2, "delete", None), ("c", 3, "upsert", 4), ("c", 3, "delete", 4)], "k string, revision int, op string, v int")
    assert rows(changes.latest(log, "k"), "k", "v") == [("a", 2)]


def test_profile(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "g string, ms double")
    assert rows(profile.span_summary(df, "g"), "median", "p90", "p99") == [(5.5, 9.1, 9.91)]
    assert rows(profile.tail(df, 3, "ms", "g"), "ms") == [(8.0,), (9.0,), (10.0,)]
    times = spark.createDataFrame([("a", t) for t in (0, 100, 250, 400, 500, 760)], "g string, t bigint")
    assert rows(profile.thin(times, "t", 250, "g"), "kept") == [(0,), (250,), (500,), (760,)]
    stacks = spark.createDataFrame([(["f", "g", "f"],), (["g"],), ([],)], "frames array<string>")
    assert rows(profile.hotspots(stacks)) == [("f", 1, 1), ("g", 2, 1)]
    flat = spark.createDataFrame([(2.0, 5.0), (2.0, 7.0)], "x double, y double")
    assert profile.power_law(flat, "x", "y").first()["r2"] == 1.0


def test_failures_stay_in_their_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, v int")

    def halve(group):
        if group["g"].iloc[0] == "b":
            raise ValueError("no")
        return group.assign(v=group["v"] * 2)[["g", "v"]]

    good, bad = analysis.apply_to_groups(df, ["g"], halve, "g string, v int", one_for_one=True)
    assert rows(good) == [("a", 2), ("a", 4)]
    assert rows(bad) == [("b", "ValueError: no")]
    _, wrong = analysis.apply_to_groups(df, ["g"], lambda g: g.head(1), "g string, v int", one_for_one=True)
    assert [r[0] for r in rows(wrong)] == ["a"]


def test_quantiles_are_exact(spark):
    """Hot groups, ties, few values, infinities, nulls: what the exact aggregate says, which holds a group's values in a task."""
    tail = F.pow(F.rand(3), F.lit(-3.0))
    value = F.when(F.col("id") % 7 == 0, F.lit(5.0)).when(F.col("id") % 11 == 0, F.round(tail)).when(F.col("id") % 1013 == 0, F.lit(float("inf"))).when(F.col("id") % 13 == 0, None).otherwise(tail)
    group = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 50).cast("string"))
    some = spark.range(0, 200_000, 1, 4).select(group.alias("g"), value.alias("v")).persist()
    some = some.unionByName(spark.createDataFrame([("one", 2.0), ("two", 1.0), ("two", 4.0), ("none", None)], "g string, v double"))
    fractions = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    expected = {r["g"]: r["q"] for r in some.groupBy("g").agg(F.percentile("v", F.array(*(F.lit(p) for p in fractions))).alias("q")).collect() if r["q"]}
    for broadcast in (None, False):
        got = {r["g"]: r["q"] for r in profile.quantiles(some, ["g"], "v", fractions, broadcast).collect()}
        assert got.keys() == expected.keys() and all(got[g] == pytest.approx(expected[g], rel=1e-12) for g in got)
    assert profile.quantiles(some, [], "v", [0.5]).first()["q"] == pytest.approx(some.agg(F.percentile("v", F.array(F.lit(0.5)))).first()[0])
    assert profile.quantiles(some.limit(0), ["g"], "v", [0.5]).count() == 0
    plan = profile.quantiles(some, ["g"], "v", [0.5])._jdf.queryExecution().toString()
    assert " percentile(" not in plan
    assert rows(profile.span_summary(some.limit(0), value="v"), "n", "median") == [(0, 0.0)]


def test_thinning_of_a_hot_series(spark, monkeypatch):
    """Blocks of one gap and of many, bursts, pauses, repeated and negative times, null names: as one greedy pass gives."""
    import random

    rng, gap = random.Random(5), 100
    hot = [t for base in range(-3000, 9000, 700) for t in (base + rng.randrange(650) for _ in range(rng.choice([1, 3, 90])))]
    series = {"hot": hot * 2, None: [5 * i for i in range(400)], "gaps": [i * 250 for i in range(20)], "one": [7, 7], "edge": [0, 99, 100, 199, 200, 299, 301, 400]}
    samples = spark.createDataFrame([(g, t, 1) for g, ts in series.items() for t in (*ts, None)], "g string, t long, kept int").repartition(5)

    def greedy(times, out=()):
        for t in sorted(times):
            out = (*out, t) if not out or t - out[-1] >= gap else out
        return out

    expected = sorted((str(g), t) for g, ts in series.items() for t in greedy(ts))
    for size in (1, 60, 500, 1 << 18):
        monkeypatch.setattr(profile, "BLOCK_TIMES", size)
        got = profile.thin(samples, "t", gap, "g")
        assert sorted((str(r.g), r.kept) for r in got.collect()) == expected
    monkeypatch.setattr(profile, "BLOCK_TIMES", 60)
    assert tuple(sorted(r.kept for r in profile.thin(samples, "t", gap).collect())) == greedy([t for ts in series.values() for t in ts])
    assert profile.thin(samples.where("t IS NULL"), "t", gap, "g").count() == 0
    assert profile.thin(samples, "t", 0, "g").count() == sum(len(ts) for ts in series.values())
