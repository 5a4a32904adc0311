"""run() against a plain version of its stages."""

import hashlib
from collections import defaultdict

import duckdb
import public_tokenizers
import sentencepiece

from test_dedup import near_by_force

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline_on_a_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    kept = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    where = defaultdict(set)
    for i, t in kept:
        for line in t.split("\n"):
            where[strip(line)].add(i)
    kept = [(i, "\n".join(x for x in t.split("\n") if not strip(x) or len(where[strip(x)]) < 10)) for i, t in kept]
    components = near_by_force(kept, 80)
    kept = [(i, t) for i, t in kept if components[i][1] == i]
    flat = lambda t: " ".join(t.lower().split())
    found = [flat(t) for t in items]
    kept = [(i, t) for i, t in kept if not any(x in flat(t) for x in found)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = sorted((i, len(ids := library.encode(t)), hashlib.sha256(library.decode(ids).encode()).hexdigest()) for i, t in kept)
    got = sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected


def test_near_duplicates_from_eighty_percent_on_and_repeated_rows(spark, table, prose):
    words = prose(204, 5).split()  # 200 shingles
    changed = lambda n, own: " ".join(words[: 204 - n] + [f"own{own}x{j}" for j in range(n)])  # noqa: E731  n shingles of each differ
    rows = [(1, " ".join(words)), (2, changed(20, 2)), (3, changed(24, 3)), (4, prose(50, 6)), (4, prose(50, 6)), (5, prose(40, 7)), (5, prose(40, 8)), (None, prose(50, 6)), (6, None), (6, None), (7, "")]
    assert 80 * 220 <= 100 * 180 < 85 * 220 and 100 * 176 < 80 * 224
    got = corpus_pipeline.drop_near_duplicates(spark, table(rows), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(i), t or "") for i, t in [rows[0], rows[2], rows[3], rows[5], rows[6], rows[7], rows[8], rows[10]])


def test_leaking_documents_go_with_or_without_an_id(spark, table):
    item = duckdb.sql(f"select text from '{SF}/benchmark.parquet' order by item_id limit 1").fetchall()[0][0]
    docs = table([(1, f"x {item} y"), (2, "clean words"), (None, item), (None, "clean too"), (2, "clean words"), (2, item)])
    got = corpus_pipeline.drop_leaks(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("2", "clean words"), ("2", "clean words"), ("None", "clean too")]


def test_other_columns_stay_behind(spark, table):
    docs = table([(1, "some letters"), (2, "more of them")])
    for name, (_, stage) in zip(("lang_pred", "kept_lines", "component_id", "key"), corpus_pipeline.STAGES[:-1], strict=True):
        out = stage(spark, docs.withColumnRenamed("score", name).withColumn("_text", docs.doc_id), SF)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == 2


def test_stages_keep_columns_and_take_odd_rows(spark, table):
    docs = table([(1, None), (2, ""), (3, "letters here"), (None, "more letters"), (3, "letters here"), (4, "123")]).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            assert stage(spark, rows, SF).columns == corpus_pipeline.COLUMNS, name
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.identify_language(spark, docs, SF).collect()) == ["3", "3", "None"]
