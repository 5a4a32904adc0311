import csv
import io
import random

from itemloom.sources import annotation_files, delimited, directory, parameters


def lines(spark, **files):
    return delimited.lines_of(spark.createDataFrame(list(files.items()), "path string, value string"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_sniff(spark):
    text = lines(spark, a="# note\nfree text\ntime_s,current_A,voltage_V\n1,2,3\n4,5,6\n", b="1\t2\t3\n4\t5\t6\n", c="no table\n", d="", e="x;y\n1;\n")
    got = {r["path"]: r for r in delimited.sniff(text).collect()}
    assert (got["a"]["delimiter"], got["a"]["header_row"], got["a"]["has_header"], got["a"]["data_rows"]) == (",", 3, True, 2)
    assert (got["b"]["delimiter"], got["b"]["header_row"], got["b"]["data_start"], got["b"]["has_header"], got["b"]["data_rows"]) == ("\t", None, 1, False, 2)
    assert got["c"]["delimiter"] is None and got["d"]["delimiter"] is None
    assert rows(delimited.layout_errors(delimited.sniff(text)), "path") == [("c",), ("d",)]
    cells = rows(delimited.read_table(text, delimited.sniff(text), limit=1), "path", "row", "name", "value")
    assert ("a", 1, "current_A", "2") in cells and ("b", 1, "column3", "3") in cells and ("e", 1, "y", "") in cells
    assert max(c[1] for c in cells) == 1


def test_parameters(spark):
    good, bad = parameters.parse(lines(spark, m="collection_path, scale\nruns/A,2\nruns/B,3\nruns/A,4\n", broken="only\nx\n"))
    assert rows(good.selectExpr("fragment", "name", "value.i")) == [("runs/A", "scale", 4), ("runs/B", "scale", 3)]
    assert rows(bad, "path") == [("broken",)]


def test_tags_and_back(spark):
    text = "[catalog]\nred #FF0000 5\n# comment\nblue\t#0000ff\tx\n[assignments]\nruns/A red\nruns/A red\nlonely\n"
    catalog, assigned, errors = annotation_files.parse_tags(lines(spark, t=text))
    assert rows(catalog, "name", "color", "priority") == [("red", "#ff0000", 5)]
    assert rows(assigned, "key", "tag") == [("runs/A", "red")]
    assert errors.count() == 2
    again = annotation_files.parse_tags(delimited.lines_of(annotation_files.format_tags(catalog, assigned)))
    assert rows(again[0], "name", "color", "priority") == rows(catalog, "name", "color", "priority") and rows(again[1]) == rows(assigned)


def test_notes_and_back(spark):
    text = "[runs/A]\n```\nfirst\n[not a key]\n```\n\n[runs]\n```\n```\n[runs/A]\n```\nlast\n```\n"
    notes = annotation_files.parse_notes(lines(spark, n=text))
    assert rows(notes, "key", "body") == [("runs", ""), ("runs/A", "last")]
    again = annotation_files.parse_notes(delimited.lines_of(annotation_files.format_notes(notes)))
    assert rows(again, "key", "body") == [("runs/A", "last")]


def test_layout(spark):
    placed, errors = annotation_files.parse_layout(lines(spark, f="a\t1\t2\nb\tx\t2\na\t3\t4\nc\n"))
    assert rows(placed, "key", "x", "y") == [("a", 3.0, 4.0)] and errors.count() == 2


def test_discover(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name in ("a.dbitem", "metadata.txt", ".hidden", "nested/b_20250101_000000_x.csv"):
        (tmp_path / name).write_text("x")
    assert rows(directory.discover(spark, str(tmp_path)), "label") == [("a.dbitem",), ("b_20250101_000000_x.csv",)]
    assert rows(directory.discover(spark, str(tmp_path), recursive=False), "label") == [("a.dbitem",)]


def test_quoted_cells(spark):
    text = lines(spark, q='name,size,note\n"a, b",1,"say ""x"""\n,"",\n"open,2,3\nc,"4"5,6\n', t='x\ty\n"p\tq"\t\n')
    cells = rows(delimited.read_table(text, delimited.sniff(text)), "path", "row", "name", "value")
    values = lambda p, r: [c[3] for c in sorted((c for c in cells if c[:2] == (p, r)), key=lambda c: ["name", "size", "note", "x", "y"].index(c[2]))]
    assert values("q", 1) == ["a, b", "1", 'say "x"'] and values("q", 2) == ["", "", ""] and values("q", 3) == ['"open', "2", "3"] and values("q", 4) == ["c", '"4"5', "6"]
    assert values("t", 1) == ["p\tq", ""]


def test_errors_of_tags_and_notes(spark):
    import pytest

    text = "early row\n[catalog]\nred #ff0000 1\n[colours]\nblue #0000ff 2\n[ assignments ]\na red\n"
    catalog, assigned, errors = annotation_files.parse_tags(lines(spark, t=text))
    assert rows(catalog, "name") == [("red",)] and rows(assigned, "key") == [("a",)]
    assert rows(errors, "line_no", "message") == [(1, "row outside of any section: early row"), (4, "unknown section: [colours]"), (5, "row outside of any section: blue #0000ff 2")]
    with pytest.raises(ValueError, match="t, line 1: row outside"):
        annotation_files.require_parsed(errors)
    annotation_files.require_parsed(errors.limit(0))
    files = dict(good="[a]\n\n```\nx\n[b]\n```\n", stray="[a]\n```\n```\nwords\n", headless="```\nx\n```\n", bare="[a]\n[b]\n```\n```\n", open="[a]\n```\nx\n")
    found = rows(annotation_files.note_errors(lines(spark, **files)), "path", "line_no", "message")
    assert found == [("bare", 1, "no fence after the heading"), ("headless", 1, "no heading before the fence"), ("open", 2, "the fence is never closed"), ("stray", 4, "text outside of any section")]


def test_a_source_of_items_is_checked(spark, tmp_path):
    import pytest

    (tmp_path / "a.txt").write_text("x")
    assert directory.as_source(directory.discover(spark, str(tmp_path))).count() == 1
    with pytest.raises(TypeError, match="label string"):
        directory.as_source(spark.createDataFrame([("a", 1)], "source_item_id string, label int"))


def as_csv_reads(text, delimiter=","):
    """Rows of well-formed text by Python's csv module, blank lines left out."""
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]


def read_rows(lines, layouts=None):
    cells = delimited.read_table(lines, layouts if layouts is not None else delimited.sniff(lines)).collect()
    out = {}
    for c in sorted(cells, key=lambda c: (c["path"], c["row"], c["column"])):
        out.setdefault(c["path"].rsplit("/", 1)[-1], {}).setdefault(c["row"], []).append(c["value"])
    assert all(sorted(rows) == list(range(1, len(rows) + 1)) for rows in out.values())
    return {p: list(rows.values()) for p, rows in out.items()}


def random_table(seed, rows, delimiter):
    r, out = random.Random(seed), io.StringIO(newline="")
    w = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    w.writerow(["id", "note", "more"])
    parts = ["a", "b c", delimiter, '"', '""', "\n", "\n\n", "#", "x" * 5]
    for i in range(rows):
        w.writerow([i, *("".join(r.choice(parts) for _ in range(r.randrange(6))).strip(" ") for _ in range(2))])
    return out.getvalue()


def test_cells_over_lines_equal_csv(spark, monkeypatch):
    files = {f"{i}": random_table(i, 40, delimited.DELIMITERS[i % 3]) for i in range(12)} | {"torn": 'name,size\n"a\nb",4\nc,5\n'}
    wanted = {p: as_csv_reads(t, delimited.DELIMITERS[int(p) % 3] if p.isdigit() else ",")[1:] for p, t in files.items()}
    layouts = spark.createDataFrame([(p, delimited.DELIMITERS[int(p) % 3] if p.isdigit() else ",", 1, 2) for p in files], "path string, delimiter string, header_row int, data_start int")
    for chunk in (1, 3, 7, 1 << 16):
        monkeypatch.setattr(delimited, "CHUNK_LINES", chunk)
        assert read_rows(lines(spark, **files), layouts) == wanted


def test_quotes_never_closed_are_text(spark, monkeypatch):
    text = 'k,v\n1,"a\nb"\n# "\n\n2,"open\n3,"x"\n4,"y""z\n5,"4"5\n'
    for chunk in (1, 2, 5, 1 << 16):
        monkeypatch.setattr(delimited, "CHUNK_LINES", chunk)
        # the quotes opened in row 2 are closed on the next line by the first quote that ends a field
        assert read_rows(lines(spark, a=text, b='k,v\n1,"a\n2,b\n#\n\n3,c\n')) == {"a": [["1", "a\nb"], ["2", 'open\n3,"x'], ["4", '"y""z'], ["5", '"4"5']], "b": [["1", '"a'], ["2", "b"], ["3", "c"]]}


def test_a_long_cell_costs_no_stack(spark):
    long = "x" * 200_000 + '""' * 100_000 + "\n" + "y" * 100_000
    assert read_rows(lines(spark, a=f'k,v\n1,"{long}"\n')) == {"a": [["1", long.replace('""', '"')]]}


def test_files_are_read_in_splits(spark, tmp_path):
    files = {f"{i}.csv": random_table(i, n, ",") for i, n in enumerate((400, 3, 0))} | {"empty.csv": "", "blank.csv": "\n\n", "dos.csv": "a,b\r\n1,2\r\n", "bare.csv": "a,b\n1,2"}
    (tmp_path / "d").mkdir()
    for name, text in files.items():
        (tmp_path / "d" / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        kept = str(tmp_path / "kept")
        got = delimited.read_lines(spark, str(tmp_path / "d"), folder=kept)
        assert spark.read.parquet(kept).select("path", "split").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = delimited.lines_of(spark.createDataFrame([f for f in files.items() if f[1]], "path string, value string"))
    assert sorted((r["path"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in got.collect()) == rows(whole)
    assert rows(delimited.layout_errors(delimited.sniff(got)).selectExpr("element_at(split(path, '/'), -1)")) == [("blank.csv",)]
    assert read_rows(got) == {p: as_csv_reads(files[p])[1:] for p in ("0.csv", "1.csv", "dos.csv", "bare.csv")}
