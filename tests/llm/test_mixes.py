"""Filter audits, source mixes and the trie of conversations, against plain versions and SQL."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.llm import filter_audit, prefix_trie, registry, source_mix
from itemloom.llm._store import attach, in_order, stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op8_line_dedup", "op11_filter_audit", "op12_source_mix", "op13_prefix_trie"])
def test_query_is_its_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    out = duck.execute(registry.ORACLE_SQL[name])
    at = [d[0] for d in out.description]
    assert sorted(at) == columns
    expected = sorted(repr([r[at.index(c)] for c in columns]) for r in out.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == expected and expected


# tables


def test_attach_is_a_join(spark):
    rows = [(k, i) for i, k in enumerate([1] * 40 + [None] * 30 + list(range(2, 60)))]
    many = stored(spark.createDataFrame(rows, "k int, i int").repartition(3), "many")
    one = stored(spark.createDataFrame([(k, f"v{k}") for k in [1, None, 3, 5, 99]], "key int, v string"), "one")
    full = sorted(((k, i, f"v{k}" if k in (1, None, 3, 5) else None) for k, i in rows), key=str)
    assert sorted((tuple(r) for r in attach(many, one, {"k": "key"}, outer=True).select("k", "i", "v").collect()), key=str) == full
    assert sorted((tuple(r) for r in attach(many, one, {"k": "key"}).select("k", "i", "v").collect()), key=str) == [r for r in full if r[2]]
    assert attach(many.limit(0), one, {"k": "key"}).count() == 0 and attach(many, one.limit(0), {"k": "key"}, outer=True).count() == len(rows)


def test_in_order_counts_through(spark):
    words = [f"w{i * 37 % 101:03d}" for i in range(101)] + [None]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r["w"]: r["ordinal"] for r in in_order(df, F.col("w").asc_nulls_last(), name="words").collect()}
    assert [got[w] for w in sorted(w for w in words if w)] == list(range(101)) and got[None] == 101
    assert in_order(df.limit(0), "w", name="words").count() == 0


# filter audit


def test_gallop_and_unions():
    rng = np.random.default_rng(3)
    for span in (1, 7, 500):
        for _ in range(30):
            a, b = (np.flatnonzero(rng.random(span) < rng.random() ** 3) for _ in range(2))
            assert filter_audit.gallop(a, b, span).tolist() == np.searchsorted(a, b).tolist()
            assert filter_audit.difference(b, a, span)[0].tolist() == sorted(set(b) - set(a))
    lists = [np.flatnonzero(rng.random(200) < p) for p in (0.5, 0.01, 0, 1)]
    merged, beyond = filter_audit.unions(lists, 200)
    for s in range(16):
        union = set().union(*(lists[i] for i in range(4) if s >> i & 1))
        assert merged[s].tolist() == sorted(union)
        assert all(beyond[i, s].tolist() == sorted(set(lists[i]) - union) for i in range(4) if not s >> i & 1)


def plain_audit(rows, filters, marks):
    """rows: (part, {name: bool}); every order of filters applied document by document."""
    out, shapley = {}, collections.Counter()
    for part in {p or "" for p, _ in rows}:
        mine = [f for p, f in rows if (p or "") == part]
        for order in itertools.permutations(filters):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if f[name]]
                failing = [f for f in mine if f[name]]
                left = [f for f in left if not f[name]]
                alone = [f for f in failing if sum(bool(f[x]) for x in filters) == 1]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = [name, len(left), len(gone), len(failing) - len(gone), len(alone), *(sum(bool(f[m]) for f in gone) for m in marks)]
    return {k: (*v, shapley[k[0], v[0]]) for k, v in out.items()}


def test_audit_is_plain(spark):
    rng, names, marks = random.Random(5), list("XYZ"), ["good", "bad"]
    rows = []
    for i in range(400):
        flags = {n: rng.choice([True, False, False, None]) for n in [*names, *marks]}
        rows.append((rng.choice(["a", "a", "a", "b", "", None]), flags, rng.choice([i, i, None, 7])))
    df = spark.createDataFrame([(p, d, *f.values(), "x") for p, f, d in rows], "part string, doc_id long, X boolean, Y boolean, Z boolean, good boolean, bad boolean, removed string")
    got = filter_audit.audit(df.repartition(3), names, marks).collect()
    assert {(r["part"], r["filter_order"], r["step"]): (r["filter"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good"], r["bad"], r["shapley"]) for r in got} == plain_audit([r[:2] for r in rows], names, marks)
    assert len(got) == 3 * 6 * 3
    lists = filter_audit.posting_lists(df, names, marks).collect()
    assert sum(len(r["doc_ids"]) for r in lists) == 400 and sum(len(r["fails"][0]) for r in lists) == sum(bool(f["X"]) for _, f, _ in rows)
    assert filter_audit.audit(df.limit(0), names, marks).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(df, [], marks)


def test_contract_filters(spark, table):
    words = " ".join(f"w{i}" for i in range(100))
    pairs = [(1, words), (2, words), (3, words + " w0" * 30), (4, "ABC " * 5), (5, words + " a|b"), (6, None), (7, ""), (None, words), (2, words), (8, words.replace(" ", " ")), (9, "é" * 99 + "X" * 11)]
    flags = filter_audit.later_copies(stored(filter_audit.text_filters(table(pairs)), "flags"), "E")
    got = sorted((str(r["doc_id"]), "".join(n for n in "ABCDE" if r[n])) for r in flags.collect())
    assert got == sorted([("1", ""), ("2", "E"), ("2", "E"), ("3", "B"), ("4", "ABC"), ("5", "D"), ("6", "A"), ("7", "AE"), ("None", ""), ("8", "A"), ("9", "A")])
    assert filter_audit.text_filters(table([])).count() == 0
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab AB\n\t　é#") for _ in range(rng.randrange(900))) for _ in range(40)]
    for r in filter_audit.text_filters(table(list(enumerate(texts)))).collect():
        text = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert [r["A"], r["B"], r["C"], r["D"]] == [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "#" in text]


# source mix


def plain_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:  # what is over goes round again
        total, over = sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * weight[s] / total
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                over, target[s] = over + target[s] - most * sizes[s], most * sizes[s]
                open_.discard(s)
        left = over
    return target


@pytest.mark.parametrize("weights, share, most", [((5, 2, 1), 1.5, 2.0), ((1,), 0.3, 1.0), ((1, 9), 2.5, 2.0)])
def test_targets(spark, weights, share, most):
    sizes = {"b": 10, "a": 1000, "c": 0, "": 300, "\U0001f600": 50, "￮": 60, None: 400, "a ": 5}
    df = spark.createDataFrame([(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r for r in source_mix.source_targets(df, weights, share, most).collect()}
    for s, t in plain_targets(sizes, weights, share, most).items():
        assert got[s]["source_size"] == sizes[s] and got[s]["target"] == pytest.approx(t, abs=1e-6)
        assert got[s]["rate"] == pytest.approx(t / sizes[s] if sizes[s] else 0)
    assert source_mix.source_targets(df.limit(0)).count() == 0


def test_mix(spark, prose):
    rng = random.Random(1)
    rows = [(i, rng.choice(["x", "x", "y", None]), None if i % 50 == 0 else prose(rng.randrange(60), i), i, "c") for i in range(1500)]
    rows += [(3, "y", "twice said", 1, "c")] * 2 + [(None, "x", "no id", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, copy string").repartition(3)
    plan = source_mix.mix_plan(df, seed=4)
    planned = sorted(tuple(r) for r in plan.select(F.coalesce("doc_id", F.lit(-1)), "size", "copies").collect())
    assert len(planned) == len(rows) and planned == sorted(tuple(r) for r in source_mix.mix_plan(df.repartition(7), seed=4).select(F.coalesce("doc_id", F.lit(-1)), "size", "copies").collect())
    assert planned != sorted(tuple(r) for r in source_mix.mix_plan(df, seed=5).select(F.coalesce("doc_id", F.lit(-1)), "size", "copies").collect())
    for r in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("all")).collect():
        assert abs(r["taken"] - r["target"]) < 0.1 * r["all"]
    assert plan.where("copies > 2").count() == 0
    mixed = source_mix.mix(df, seed=4)
    assert mixed.columns == df.columns and mixed.where("size = doc_id OR doc_id = 3 OR doc_id IS NULL").count() == mixed.count() == sum(c for *_, c in planned)
    assert sorted(r["copy"] for r in mixed.where("doc_id = 3 AND source = 'y' AND text = 'twice said'").collect()) in ([], [0, 0], [0, 0, 1, 1])
    assert source_mix.mix(df.limit(0)).count() == source_mix.mix_plan(df.limit(0)).count() == 0


# trie


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in convs:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        built[c] = tuple(convs.get(base, [])[:h] + convs[c][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    out = set()
    for node, mine in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.add((mine[0], len(node), members[node[:-1]][0] if node else None, len(mine), len(kids), len(leaves), saved, digest))
    return out


TURNS = "conv_id long, turn long, role string, text string, depth string"


def grown(spark, rows):
    turns = stored(prefix_trie.turns_of(spark.createDataFrame([(*r, "x") for r in rows], TURNS).repartition(3)), "turns")
    return {tuple(r) for r in prefix_trie.trie(*prefix_trie.with_shared_heads(turns)).collect()}


def test_trie_is_plain(spark):
    rng, rows = random.Random(9), []
    for c in [*range(40), -7, -10, 1003]:
        if c in (5, 20):
            continue  # groups whose first conversation is absent
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["ok", "ok", "é", None, "no"])))
    rows += [(0, 1, "user", "twice")] * 2 + [(None, 0, "user", "nobody's")] * 3
    rows += [(500, t, "user", f"t{t % 3}") for t in range(120)]
    assert grown(spark, rows) == plain_trie(rows)


def test_trie_edges(spark):
    assert grown(spark, []) == set() and grown(spark, [(None, 1, "user", "x")]) == set()
    h = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    empty = hashlib.sha256(b"").hexdigest()
    assert grown(spark, [(h, 1, "user", "x")]) == {(h, 0, None, 1, 0, 1, 0, hashlib.sha256(str(h).encode()).hexdigest())}  # turnless
    same = [(c, t, "user", "x" * 1000) for c in range(0, 500, 5) for t in range(3)]  # one group of copies
    got = grown(spark, same)
    every = ",".join(map(str, range(0, 500, 5))).encode()
    assert got == {(0, d, 0 if d else None, 100, int(d < 3), 1, 99 * 1000 * min(3, 4 - max(d, 1)), hashlib.sha256(every).hexdigest() if d == 3 else empty) for d in range(4)}


def test_subtree_sums(spark):
    """Random trees, a path, a star, a caterpillar and many small trees, side by side."""
    rng, tree = random.Random(4), []
    shapes = [lambda i: rng.randrange(i), lambda i: i - 1, lambda i: 0, lambda i: i - 1 if i % 2 else max(i - 2, 0), lambda i: None if i % 60 == 0 else i - 1 if i % 60 < 4 else i - rng.choice([1, 2, 3])]
    for k, parent in enumerate(shapes):
        above = [None, *(parent(i) for i in range(1, 300))]
        tree += [(1000 * k + i, None if p is None else 1000 * k + p, i * i, 1) for i, p in enumerate(above)]
    total = {i: [v, w] for i, _, v, w in tree}
    for i, p, _, _ in reversed(tree):
        if p is not None:
            total[p] = [a + b for a, b in zip(total[p], total[i], strict=True)]
    df = stored(spark.createDataFrame(tree, "id long, parent long, v long, w long").repartition(3), "tree")
    got = prefix_trie.subtree_sums(df, ["v", "w"]).collect()
    assert len(got) == len(tree) and {r["id"]: [r["v"], r["w"]] for r in got} == total
