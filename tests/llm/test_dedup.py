import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from itemloom.llm import decontaminate, line_dedup, minhash_dedup, substring_dedup


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def near_by_force(pairs, percent=85):
    sets = {}
    for i, t in pairs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(table, prose):
    base = prose(300, 1)
    words = base.split()
    pairs = [(10 * i, prose(80 + i, 50 + i)) for i in range(20)]
    for k in range(12):  # a chain and a star of near copies
        changed = list(words)
        for j in range(k % 4 + 1):
            changed[(37 * k + 61 * j) % 300] = f"new{k}{j}"
        pairs.append((1000 + k, " ".join(changed)))
    pairs += [(5, base.upper()), (7, base), (8, "  ".join(words)), (900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  two"), (905, "one two three"), (906, "x" * 200_000), (907, "é ü ÀB c d e")]
    expected = near_by_force(pairs)
    got = minhash_dedup.near_duplicates(table(pairs))
    assert rows(got) == sorted(((i, n, c, c == i) for i, (n, c) in expected.items()), key=str)


def test_large_group_with_a_common_centre(table, prose):
    """Copies that are like their origin, but not like one another, in a group larger than a block."""
    words = prose(200, 3).split()
    pairs = [(500, " ".join(words))]
    for k in range(150):
        changed = list(words)
        for j in range(3):
            changed[(17 * k + 66 * j) % 200] = f"own{k}x{j}"
        pairs.append((k, " ".join(changed)))
    expected = near_by_force(pairs)
    assert rows(minhash_dedup.near_duplicates(table(pairs)), "doc_id", "component_id") == sorted(((i, c) for i, (_, c) in expected.items()), key=str)


def test_near_duplicates_of_odd_tables(table, prose):
    assert minhash_dedup.near_duplicates(table([])).count() == 0
    text = prose(50, 9)
    got = rows(minhash_dedup.near_duplicates(table([(1, text), (1, text), (2, text), (None, text)])), "doc_id", "component_id", "kept")
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=str)


def test_rows_with_one_id_and_different_texts(table, prose):
    one, two, three = prose(60, 21), prose(60, 22), prose(60, 23)
    pairs = [(5, one), (5, two), (7, f"{two} tail"), (9, f"{one} tail"), (3, three), (11, f"{three} tail"), (2, prose(9, 1))]
    got = rows(minhash_dedup.near_duplicates(table(pairs)), "doc_id", "component_id")
    assert got == sorted([(5, 5), (5, 5), (7, 5), (9, 5), (3, 3), (11, 3), (2, 2)], key=str)


def test_sets_that_share_a_short_hash_are_told_apart(table, prose, monkeypatch):
    texts = [prose(60, i) for i in range(12)]
    df = table([(i, t) for i, t in enumerate([*texts, *texts[:6], texts[0] + " end", "", None, "a b"])])
    before = sorted(map(tuple, minhash_dedup.near_duplicates(df).collect()))
    full = minhash_dedup._short
    monkeypatch.setattr(minhash_dedup, "_short", lambda *more: F.pmod(full(*more), F.lit(3)))
    assert sorted(map(tuple, minhash_dedup.near_duplicates(df).collect())) == before
    assert sum(i == c for i, _, c, _ in before) == 15


def test_leftovers_of_a_large_bucket_grow_with_its_outliers(spark, monkeypatch):
    n = 5000
    placed = [(1, i, 0 if i != 4321 else 4321) for i in range(n)] + [(2, i, 0) for i in range(n)] + [(3, i, i % 3) for i in range(30)]
    blocks = minhash_dedup.leftover_blocks(spark.createDataFrame(placed, "bucket long, id long, component long"))
    per = dict(rows(blocks.groupBy("bucket").count()))
    assert set(per) == {1, 3} and per[1] == n + -(-n // minhash_dedup.OTHERS)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "OTHERS", 7)
    met = set()
    got = minhash_dedup.leftover_blocks(spark.createDataFrame(placed[-30:], "bucket long, id long, component long")).collect()
    for x in got:
        for y in got:
            if x["first"] and not y["first"] and (x["i"], x["j"]) == (y["i"], y["j"]) and x["component"] != y["component"]:
                met.add((min(x["id"], y["id"]), max(x["id"], y["id"])))
    assert met == {(a, b) for a in range(30) for b in range(a + 1, 30) if a % 3 != b % 3}


def test_an_outlier_in_a_bucket_of_many_copies(table, prose):
    """Texts that differ from a common one by more and more words: links exist between leftovers alone."""
    words = prose(120, 31).split()
    pairs = [(k, " ".join(words[: 120 - k % 3] + [f"own{k}"])) for k in range(300)]
    for k in range(30):
        pairs.append((1000 + k, " ".join(words[: 114 - k] + [f"far{k}x{j}" for j in range(k // 2)])))
    expected = near_by_force(pairs)
    assert len({c for _, c in expected.values()}) > 1
    assert rows(minhash_dedup.near_duplicates(table(pairs)), "doc_id", "component_id") == sorted(((i, c) for i, (_, c) in expected.items()), key=str)


def test_near_duplicate_query_on_its_whole_table(spark):
    from itemloom.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    expected = near_by_force(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = rows(QUERIES["op1_minhash_dedup"](spark, sf), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(((i, n, c, c == i) for i, (n, c) in expected.items()), key=str)


def test_lower_threshold_finds_its_pairs(table, prose):
    pairs, dropped = [], set()
    for k in range(40):
        words = prose(204, 900 + k).split()  # 200 shingles
        n = 21 + k % 6  # shingles of each that the other lacks
        changed = words[: 204 - n] + [f"own{k}x{j}" for j in range(n)]
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        if 100 * (200 - n) >= 80 * (200 + n):
            assert 80 * (200 + n) <= 100 * (200 - n) < 85 * (200 + n)
            dropped.add(2 * k + 1)
    got = minhash_dedup.near_duplicates(table(pairs), percent=80).where("NOT kept")
    assert {r["doc_id"] for r in got.collect()} == dropped and len(dropped) >= 10


def test_bands_follow_the_threshold():
    assert minhash_dedup.bands_for(85) == 24
    for percent in (50, 70, 80, 85, 95, 100):
        assert (1 - (percent / 100) ** minhash_dedup.ROWS) ** minhash_dedup.bands_for(percent) < 1e-6


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (7, 6)]
    got = dict(rows(minhash_dedup.components(spark.createDataFrame(path, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert minhash_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


LINES = [(i, "Shared line \nown %d\n\nshared LINE" % i) for i in range(12)] + [(50, None), (51, ""), (52, "\n\n"), (53, "only\x0b\n rare \n"), (54, "x" * 100_000), (None, "shared line\nz")]


def test_line_dedup_against_sql(spark, table):
    docs = table(LINES)
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    got = rows(out.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(cast(array_join(kept_lines, '\n') as binary), 256)"))
    documents = docs.where("doc_id IS NOT NULL").toPandas()  # noqa: F841  read by name in the SQL
    expected = duckdb.sql(line_dedup.OP8_SQL).fetchall()
    assert [r for r in got if r[0] is not None] == sorted(expected, key=str)
    assert [r[1:3] for r in got if r[0] is None] == [(2, 1)]


def test_line_dedup_keeps_first(table):
    docs = table(LINES)
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, keep_first=True)).where("doc_id IS NOT NULL")
    dropped = dict(rows(out, "doc_id", "n_dropped"))
    assert dropped[0] == 2 and dropped[1] == 2  # the null document comes first and holds the first occurrence
    docs = docs.where("doc_id IS NOT NULL")
    dropped = dict(rows(line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, keep_first=True)), "doc_id", "n_dropped"))
    assert dropped[0] == 1 and dropped[1] == 2 and dropped[50] == 0
    empty = table([])
    assert line_dedup.drop_lines(empty, line_dedup.keep_bitmaps(empty)).count() == 0
    clash = docs.withColumnRenamed("score", "n_lines").withColumnRenamed("source", "text_hash").withColumnRenamed("lang", "Dropped")
    out = line_dedup.drop_lines(clash, line_dedup.keep_bitmaps(clash))
    assert out.columns == ["doc_id", "text", "Dropped", "text_hash", "n_chars", "kept_lines", "n_lines", "n_dropped"]
    assert {(r["Dropped"], r["text_hash"]) for r in out.collect()} == {("en", "src0")} and dict(rows(out, "doc_id", "n_lines"))[0] == 4


def test_line_dedup_counts_documents_not_rows(table):
    pairs = [(1, "copied\nlines")] * 10 + [(i, f"nine {i}\nshared by nine\nlate") for i in range(20, 29)] + [(28, "shared by nine"), (29, "late"), (30, "copied")]
    docs = table(pairs)
    got = rows(line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs)), "doc_id", "n_lines", "n_dropped")
    documents = table(list(dict.fromkeys(pairs))).where("text <> 'shared by nine'").toPandas()  # noqa: F841  read by name in the SQL
    expected = {r[0]: r[1:3] for r in duckdb.sql(line_dedup.OP8_SQL).fetchall()}
    assert [r for r in got if r[0] == 1] == [(1, 2, 0)] * 10 and (28, 1, 0) in got
    assert [r for r in got if r[1] == 3 or r[0] in (29, 30)] == sorted(((i, *n) for i, n in expected.items() if i != 1), key=str)
    assert (29, 1, 1) in got and (30, 1, 0) in got


def test_line_dedup_of_a_document_of_many_lines(table):
    import time

    docs = table([(1, "\n".join(f"line {i}" for i in range(100_000)))] + [(i, "line 7\nline 99999") for i in range(2, 11)])
    began = time.perf_counter()
    got = rows(line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs)), "doc_id", "n_lines", "n_dropped")
    assert got[0] == (1, 100_000, 2) and got[1:] == sorted([(i, 2, 2) for i in range(2, 11)], key=str)
    assert time.perf_counter() - began < 60


def test_long_document_drops_lines_past_the_first_word_of_bits(table):
    many = "\n".join(f"line {i}" for i in range(200))
    docs = table([(i, many + f"\nown {i}") for i in range(10)])
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    assert rows(out.selectExpr("n_lines", "n_dropped", "size(kept_lines)")) == [(201, 200, 1)] * 10


def cut_by_force(pairs, k=13):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in pairs]
    for i, w in sorted(words, key=lambda x: x[0]):
        for a in range(len(w) - k + 1):
            first.setdefault(tuple(w[a : a + k]), i)
    out = []
    for i, w in words:
        drop = [False] * len(w)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                drop[a : a + k] = [True] * k
        out.append((i, len(w), sum(drop), hashlib.sha256(b" ".join(x for x, d in zip(w, drop) if not d)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(table, prose):
    shared, other = prose(60, 1), prose(30, 2)
    pairs = [(i, f"{prose(20, 100 + i)} {shared} {prose(15, 200 + i)}") for i in range(8)]
    pairs += [(20, shared), (21, f"{other} {shared}"), (22, f"{shared} {other}"), (3000, f"{other} {other}"), (-5, other), (30, None), (31, ""), (32, "a b c"), (33, shared[:40]), (34, " ".join(["tic"] * 500)), (35, " ".join(["tic"] * 40))]
    docs = table(pairs)
    out = substring_dedup.remove_repeats(docs, substring_dedup.repeated_spans(docs))
    got = rows(out.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept_text as binary), 256)"))
    assert got == cut_by_force(pairs)


def test_substring_dedup_in_small_blocks(table, prose, monkeypatch):
    """Passages over many blocks, tiles and a crowded memory; a long document, repeated rows, a passage in most documents."""
    for name, value in (("PACK_BYTES", 3000), ("REMEMBERED", 150), ("TILE_BITS", 3)):
        monkeypatch.setattr(substring_dedup, name, value)
    shared, long = prose(60, 1), prose(1500, 2)
    pairs = [((i * 37) % 101, f"{prose(i % 9, 100 + i)} {shared if i % 3 else prose(40, 5)} {prose(15, 200 + i)}") for i in range(101)]
    pairs += [(200, long), (150, f"x {long} y"), (151, long[: len(long) // 2] + " odd " + long[len(long) // 2 :]), (210, long), (210, long), (201, f"{shared} {shared}")]
    docs = table(pairs).repartition(3)
    out = substring_dedup.remove_repeats(docs, substring_dedup.repeated_spans(docs))
    assert rows(out.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept_text as binary), 256)")) == cut_by_force(pairs)
    spans = rows(substring_dedup.repeated_spans(docs).where("doc_id IN (151, 200)"), "doc_id", "start", "n", "source_id", "source_start")
    assert (200, 0, 1500, 150, 1) in spans and len(spans) == 3


def test_paths_are_compacted_over_many_tiles(spark):
    from pyspark.sql import functions as F

    size, step = 1 << substring_dedup.TILE_BITS, "doc_id long, start long, end long, back long, lag long"
    pieces = [(1, t * size, (t + 1) * size, 1, 7) for t in range(37)] + [(1, 40 * size, 41 * size - 5, 1, 7), (1, 41 * size, 41 * size + 3, 1, 7), (2, 5, size, 1, 0), (2, size, size + 9, 2, 0), (2, 2 * size, 2 * size + 9, 2, 0)]
    got = rows(substring_dedup.compact(spark.createDataFrame(pieces, step).withColumn("doc_id", F.col("doc_id"))))
    assert got == sorted([(1, 0, 37 * size, 1, 7), *pieces[37:]], key=str)
    assert substring_dedup.compact(spark.createDataFrame([], step)).count() == 0


def test_substring_query_on_its_whole_table(spark):
    from itemloom.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    got = rows(QUERIES["op7_substring_dedup"](spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == cut_by_force(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def test_substring_spans_point_at_their_source(table, prose):
    shared = prose(40, 1)
    docs = table([(1, f"x y {shared}"), (2, f"z {shared} q"), (None, shared)])
    assert rows(substring_dedup.repeated_spans(docs)) == [(2, 1, 40, 1, 2)]
    assert substring_dedup.repeated_spans(table([])).count() == 0


def test_substring_dedup_of_ids_with_several_texts(table, prose, monkeypatch):
    """Each text of a doc_id loses its own repeated words and no others; crowded sources are asked by several rows."""
    monkeypatch.setattr(substring_dedup, "SPANS_A_ROW", 3)
    a, b, c = prose(30, 1), prose(30, 2), prose(400, 3)
    pairs = [(1, f"x {a}"), (2, a), (2, b), (2, b), (3, f"y {b} z"), (3, None), (3, f"{a} {b}"), (4, c), (4, f"{c} {a}"), (None, a), (None, b)]
    parts = c.split()
    pairs += [(10 + k, f"own{k} {' '.join(parts[7 * k : 7 * k + 20 + k])} end{k}") for k in range(20)]
    docs = table(pairs).repartition(3)
    spans = substring_dedup.repeated_spans(docs, variants=True)
    got = rows(substring_dedup.remove_repeats(docs.where("doc_id IS NOT NULL"), spans).selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept_text as binary), 256)"))
    assert got == cut_by_force([(i, t) for i, t in pairs if i is not None])
    assert rows(spans.where("doc_id = 2").select("start", "n", "source_id")) == [(0, 30, 1)]
    assert {r.n_removed for r in substring_dedup.remove_repeats(docs, spans).where("doc_id IS NULL").collect()} == {0}


def test_a_benchmark_of_many_blocks_keeps_one_index_alive(spark, table, prose, monkeypatch):
    items = [(i, prose(12, 500 + i)) for i in range(60)] + [(None, prose(15, 700)), (61, prose(200, 701)), (62, None), (63, " ")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    pairs = [(i, f"{prose(20, i)} {items[i % 64][1] or ''} {prose(9, 90 + i)}") for i in range(80)] + [(None, items[5][1]), (7, None), (8, "")]
    docs = table(pairs).repartition(3)
    whole = rows(decontaminate.leaks(docs, bench))
    assert {r[1] for r in whole} == {*range(60), 61, None}
    alive, most, broadcast = [], [], type(spark.sparkContext).broadcast

    def counted(context, value):
        made = broadcast(context, value)
        alive.append(made)
        most.append(len(alive))
        destroy = made.destroy
        made.destroy = lambda *a: (alive.remove(made), destroy(*a))
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    out = decontaminate.leaks(docs, bench)
    assert rows(out) == whole
    assert len(most) > 50 and max(most) == 1 and not alive
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_decontamination(spark, table, prose):
    items = [(i, prose(25, 500 + i)) for i in range(6)] + [(90, None), (91, ""), (92, "short"), (93, prose(25, 500))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, extra int")
    clean, leak = prose(200, 1), items[2][1]
    edited = leak.split()
    edited[3], edited[11] = "zz", edited[11] + "x"
    far = " ".join(w if i % 2 else "other" for i, w in enumerate(leak.split()))
    pairs = [(1, clean), (2, f"{clean} {leak} {clean}"), (3, f"{clean} {' '.join(edited).upper()}"), (4, far), (5, leak), (6, leak.replace(" ", "\n  ")), (7, None), (8, ""), (9, items[0][1]), (10, leak[: len(leak) // 2]), (11, "x" * 300_000)]
    got = rows(decontaminate.leaks(table(pairs), bench), "doc_id", "item_id")
    assert got == sorted([(2, 2), (3, 2), (5, 2), (6, 2), (9, 0), (9, 93)], key=str)
    distance = dict(rows(decontaminate.leaks(table(pairs), bench).where("item_id = 2"), "doc_id", "distance"))
    assert distance[2] == distance[5] == distance[6] == 0 and 0 < distance[3] <= 10
    assert decontaminate.leaks(table([]), bench).count() == 0
    assert decontaminate.leaks(table(pairs), bench.limit(0)).count() == 0


def test_leaks_in_a_large_block_of_texts_and_items(prose):
    """Rows times items beyond 2**30."""
    items = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(110_000)]
    index = decontaminate.Index(list(range(len(items))), items)
    texts = [b"-"] * 10_000
    planted = {9_800: 5, 9_900: 60_000, 9_999: 109_999}
    for r, i in planted.items():
        texts[r] = items[i].encode()
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert len(texts) * len(items) >= 1 << 30
    found = decontaminate._leaks(data, offsets, index)
    assert {k: v[0] for k, v in found.items() if v[0] == 0} == {k: 0 for k in planted.items()}


def test_items_without_an_id_are_evidence(spark, table, prose):
    leak, other = prose(25, 700), prose(25, 701)
    bench = spark.createDataFrame([(None, leak), (4, other), (None, None)], "item_id long, text string")
    docs = table([(1, f"before {leak} after"), (2, prose(60, 1)), (3, f"{other} and {leak}")])
    assert rows(decontaminate.leaks(docs, bench), "doc_id", "item_id") == sorted([(1, None), (3, 4), (3, None)], key=str)


def leaks_by_force(pairs, items, rate=0.1):
    """(row, item) -> fewest edits, by a plain edit distance to every part of the text."""
    flat = lambda t: re.sub("[ \t\n\x0b\x0c\r]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, item in items:
        item = flat(item).strip(" ")
        for d, text in pairs:
            text, row = flat(text), list(range(len(item) + 1))
            best = len(item) + 1
            for c in text:
                new = [0]
                for j, x in enumerate(item):
                    new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
                row = new
                best = min(best, row[-1])
            if item and best <= len(item) * 10 // 100:
                out[d, i] = best
    return out


def odd_leaks():
    import random

    rng = random.Random(8)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    items = [(n, word("abc dé" if n % 3 else "ab", n)) for n in range(1, 61)] + [(100, " \n"), (101, None), (102, "日本語テキスト"), (103, "A" * 40), (104, "ab" * 20)]
    pairs = [(0, None), (1, ""), (2, "a" * 300), (3, "ab" * 150), (4, "日本語 テキスト日本語テキスト"), (5, " ".join(t or "" for _, t in items))]
    for d in range(10, 50):
        text = word("xyz é", 20)
        for _, item in rng.sample(items[:60], 4):
            copy = list(item)
            for _ in range(rng.randrange(0, len(copy) // 8 + 2)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice("abcéZ")] * rng.randrange(2)
                copy = copy or ["a"]
            text += "".join(copy).upper().replace(" ", rng.choice([" ", "\n\t"])) + word("xyz é", 6)
        pairs.append((d, text))
    return pairs, items


def test_leaks_against_a_plain_edit_distance(spark, table, monkeypatch):
    pairs, items = odd_leaks()
    expected = leaks_by_force(pairs, items)
    assert {i for _, i in expected} >= set(range(1, 61)) and len(set(expected.values())) > 4
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table(pairs), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == expected and len(got) == len(expected)
    raw = [(t or "").encode() for _, t in pairs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    index = decontaminate.Index(*zip(*items))
    whole = decontaminate._leaks(data, offsets, index)
    monkeypatch.setattr(decontaminate, "PIECE", 200)
    assert decontaminate._leaks(data, offsets, index) == whole and len(whole) == len(expected)
    monkeypatch.setattr(decontaminate, "PART", 13)  # items from 27 characters on are looked for by their parts
    parts = decontaminate._leaks(data, offsets, decontaminate.Index(*zip(*items)))
    assert {k: v[:1] for k, v in parts.items()} == {k: v[:1] for k, v in whole.items()}


def test_leaks_of_long_and_repeated_rows(spark, table, prose):
    item = prose(30, 1)
    text = f"{prose(60_000, 2)} {item} {prose(60_000, 3)} {item}"
    bench = spark.createDataFrame([(1, item), (1, item), (2, prose(20_000, 4))], "item_id long, text string")
    edited = " ".join(w if i % 97 else "changed" for i, w in enumerate(prose(20_000, 4).split()[:4000]))
    bench = bench.unionByName(spark.createDataFrame([(3, prose(20_000, 4)[: len(edited)])], bench.schema))
    docs = table([(1, text), (1, text), (None, item), (2, prose(20_000, 4).upper()), (4, f"{prose(30, 6)} {edited} {prose(30, 7)}")])
    got = rows(decontaminate.leaks(docs, bench), "doc_id", "item_id", "distance")
    assert [r for r in got if r[0] != 4] == sorted([(1, 1, 0)] * 4 + [(None, 1, 0)] * 2 + [(2, 2, 0), (2, 3, 0)], key=str)
    assert [r[:2] for r in got if r[0] == 4] == [(4, 3)] and 0 < [r for r in got if r[0] == 4][0][2] < 500


def test_decontamination_query_on_its_whole_tables(spark):
    from itemloom.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    pairs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    flat = lambda t: " ".join((t or "").lower().split())
    exact = {(d, i) for i, item in items for d, t in pairs if flat(item) and flat(item) in flat(t)}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    assert {k for k, d in got.items() if d == 0} == exact and exact
    near = sorted(k for k, d in got.items() if d)[:5]
    assert {k: v for k, v in leaks_by_force([p for p in pairs if p[0] in {d for d, _ in near}], [x for x in items if x[0] in {i for _, i in near}]).items() if k in near} == {k: got[k] for k in near}


def test_alignment_is_the_edit_distance():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 15)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))
        text = item[: len(item) // 2] + text + item[len(item) // 2 :]
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        raw = lambda s: np.frombuffer(s.encode(), np.uint8)
        assert decontaminate.align(raw(item), raw(text), len(item))[0] == min(row)


def test_counts_are_of_all_documents(table):
    docs = table([(i, "a\nb" if i % 2 else "a") for i in range(20)])
    dropped = Counter(r["n_dropped"] for r in line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs)).collect())
    assert dropped == {1: 10, 2: 10}
    assert defaultdict(int, dropped)[3] == 0
