from __future__ import annotations

import zipfile

import pytest

from schemalign.operators import conform as c
from schemalign.plans.map_files import map_files, reviewed
from schemalign.sources import delimited, tables, workbook
from schemalign.streaming.landing import land_stream


def test_conform(spark):
    df = spark.createDataFrame([("0250", "nan", 3)], "k string, v string, `a.b``c` int")
    mapping = [("k", "Code"), ("v", "Note"), ("k", "Note"), ("a.b`c", "Odd/Name?"), ("gone", "Amount")]
    got = c.conform(df, mapping, ["Note", "Amount", "Code", "Odd/Name?"])
    assert got.columns == ["Amount", "Code", "Note", "Odd/Name?"]
    assert tuple(got.first()) == (None, "0250", None, "3")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="no columns mapped"):
        c.conform(df, [("k", "(Ignored)")], ["Code"])
    with pytest.raises(ValueError, match="no target"):
        c.conform(df, mapping, [])


def test_columns_that_differ_in_case_only(spark):
    df = spark.createDataFrame([("1", "2", "3")], "Dob string, dob string, x string")
    assert tuple(c.conform(df, [("Dob", "A"), ("dob", "B")], ["A", "B"]).first()) == ("1", "2")
    with pytest.raises(ValueError, match="case only"):
        c.conform(df, [("Dob", "A")], ["A", "a"])


def test_conform_many_both_ways(spark, monkeypatch):
    rows = spark.createDataFrame([("f", ["1", "x"]), ("g", ["y", "2", "3"]), ("h", ["z"])], "source_id string, values array<string>")
    mapping = spark.createDataFrame(
        [("f", 0, "N"), ("f", 1, "S"), ("f", 1, "N"), ("g", 0, "S"), ("g", 5, "N"), ("h", 0, "(Ignored)")],
        "source_id string, position int, target string",
    )
    want = [("f", "1", "x", None), ("g", None, "y", None)]
    assert sorted(tuple(r) for r in c.conform_many(rows, mapping, ["N", "S", "U"]).collect()) == want
    monkeypatch.setattr(c, "BROADCAST_LAYOUTS", 0)
    assert sorted(tuple(r) for r in c.conform_many(rows, mapping, ["N", "S", "U"]).collect()) == want


def test_headers():
    assert delimited.distinct_headers(["A", "a", "A", "", "A.1", "A"]) == ["A", "a", "A.2", "Unnamed: 3", "A.1", "A.3"]
    assert delimited.distinct_headers(["A", "A", "A.1"]) == ["A", "A.2", "A.1"]


def test_delimited(spark, tmp_path):
    (tmp_path / "one file.csv").write_text('A,b,A\n007,"x, ""q""\nnext",\n , ,NA\n')
    (tmp_path / "two.txt").write_text("n|m,k\n1|2\n3|4\n")
    (tmp_path / "three.txt").write_text("p\tq|r\r\n5\t6\r\n")
    files, rows = delimited.read_delimited(spark, str(tmp_path))
    assert {(r["source_id"].split("/")[-1], r["delimiter"], tuple(r["columns"])) for r in files.collect()} == {
        ("one%20file.csv", ",", ("A", "b", "A.1")), ("two.txt", "|", ("n", "m,k")), ("three.txt", "\t", ("p", "q|r"))
    }
    got = {}
    for r in rows.collect():
        got.setdefault(r["source_id"].split("/")[-1], []).append(r["values"])
    assert got["one%20file.csv"] == [["007", 'x, "q"\nnext', None], [" ", " ", "NA"]]
    assert sorted(got["two.txt"]) == [["1", "2"], ["3", "4"]] and got["three.txt"] == [["5", "6"]]
    stats = {tuple(r)[1:] for r in c.file_stats(rows, files).collect()}
    assert stats == {(2, 3, "CSV"), (2, 2, "TXT"), (1, 2, "TXT")}
    named = delimited.as_table(rows.filter("source_id LIKE '%two.txt'"), ["n", "m,k"])
    assert named.columns == ["n", "m,k"]


def test_headers_over_lines_odd_names_and_long_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "r[1].csv").write_text('"a\nx",b\n1,2\n')
    (folder / "r{2}.csv").write_text("n|m\n3|4\n5\n")
    (folder / "wide.csv").write_text("a,b,c,d\n1,2,3,4\n")
    files, rows = delimited.read_delimited(spark, str(folder))
    assert sorted(r["columns"] for r in files.collect()) == [["a", "b", "c", "d"], ["a\nx", "b"], ["n", "m"]]
    assert sorted((r["values"] for r in rows.collect()), key=repr) == [["1", "2", "3", "4"], ["1", "2"], ["3", "4"], ["5", None]]


def _read(spark, folder):
    files, rows = delimited.read_delimited(spark, str(folder))
    told = {r["source_id"].split("/")[-1]: (r["columns"], r["error"]) for r in files.collect()}
    got = {}
    for r in rows.collect():
        got.setdefault(r["source_id"].split("/")[-1], []).append(r["values"])
    return told, {name: sorted(values, key=repr) for name, values in got.items()}


def test_bad_files_are_told_and_good_ones_read(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.csv").write_text("a,b\n1,2\n\n3\n")
    (folder / "long.csv").write_text("a,b\n3,4\n1,2,,5\n")
    (folder / "long2.csv").write_text('a,b\n"x\ny",4\n1,2,\n')
    (folder / "open.csv").write_text('a,b\n1,"2\n3,4\n')
    (folder / "open_head.csv").write_text('a,"b\n1,2\n')
    (folder / "latin.csv").write_bytes("a,b\nné,2\n".encode("latin-1"))
    (folder / "empty.csv").write_text("")
    (folder / "blank.csv").write_text("\n\r\n")
    (folder / "late.csv").write_text("\n\nk,l\n1,2\n")
    (folder / "bom.csv").write_bytes(b"\xef\xbb\xbfk\tl\r\n1\t\r\n")
    (folder / "mac.csv").write_text("k|l\r1|2\r3|4\r")
    (folder / "quote.csv").write_text('size,b\n5" pipe,x\n"6"" pipe",y\n')
    told, got = _read(spark, folder)
    assert told == {
        "good.csv": (["a", "b"], None), "long.csv": (["a", "b"], "a row has 4 fields, the header 2"),
        "long2.csv": (["a", "b"], "a row has 3 fields, the header 2"), "open.csv": (["a", "b"], "a quote is not closed"),
        "open_head.csv": (["a", "b\n1,2"], "a quote is not closed"), "latin.csv": (["a", "b"], "not UTF-8"),
        "blank.csv": (None, "no header"), "late.csv": (["k", "l"], None), "bom.csv": (["k", "l"], None), "mac.csv": (["k", "l"], None),
        "quote.csv": (["size", "b"], None),
    }
    assert got == {
        "good.csv": [["1", "2"], ["3", None]], "late.csv": [["1", "2"]], "bom.csv": [["1", None]], "mac.csv": [["1", "2"], ["3", "4"]],
        "quote.csv": [['5" pipe', "x"], ['6" pipe', "y"]],
    }


@pytest.mark.parametrize("facts_fit", [True, False])
def test_records_over_the_ends_of_splits(spark, tmp_path, monkeypatch, facts_fit):
    import csv as standard
    import random

    from schemalign.sources import delimited as d

    monkeypatch.setattr(d, "BROADCAST_LAYOUTS", 50_000_000 if facts_fit else 0)
    draw = random.Random(2)
    texts = ["plain", 'say "x"', "two\nlines", "a,b", "", "long " * 30, "many\n" * 40, '"', '\n"\n']
    want = {}
    for name in ("p.csv", "q.csv", "r.csv"):
        rows = [[str(k), draw.choice(texts), draw.choice(texts[:1] if name == "r.csv" else texts)] for k in range(150)]
        with open(tmp_path / name, "w", newline="") as out:
            standard.writer(out, lineterminator="\n").writerows([["id", "x", "y"], *rows])
        want[name] = sorted([[v or None for v in row] for row in rows], key=repr)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        told, got = _read(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(told) == 3 and all(t == (["id", "x", "y"], None) for t in told.values())
    assert got == want


def test_states_of_lines():
    for line, inside, want in [('a,"b', False, True), ('a,"b"', False, False), ('b"', True, False), ('b""', True, True), ('b"",', True, True),
                               ('5" x', False, False), ('"a""b', False, True), ('"a"b,"c', False, True), ('x","y', True, True), ("", True, True)]:
        assert delimited.ends_open(line, ",", inside) == want, line


def test_map_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order Date,TOT_PRC,junk zzz\n2024-01-01,007,1\nnan,8,2\n")
    (tmp_path / "b.txt").write_text("total-price|Order_Dt\n9|x\n")
    (tmp_path / "c.csv").write_text("order date,ORDER DATE!\n1,2\n")
    dictionary = spark.createDataFrame(
        [("Order Date", "Order Date"), ("ORDER_DT", "Order Date"), ("Total Price", "Total Price"), ("TOT_PRC", "Total Price"), ("nothing", "Unused")],
        "src string, target string",
    )
    files, rows = delimited.read_delimited(spark, str(tmp_path))
    mapped = map_files(files, rows, dictionary)
    ready = {r["source_id"].split("/")[-1]: r["ready"] for r in mapped.summary.collect()}
    assert ready == {"a.csv": True, "b.txt": True, "c.csv": False}
    got = sorted((tuple(r)[1:] for r in mapped.rows.collect()), key=repr)
    assert mapped.rows.columns == ["source_id", "Order Date", "Total Price", "Unused"]
    assert got == sorted([("2024-01-01", "007", None), (None, "8", None), ("x", "9", None)], key=repr)
    choice = files.filter("source_id LIKE '%c.csv'").selectExpr("source_id", "'ORDER DATE!' AS src_col", "'(Ignored)' AS target")
    assert reviewed(mapped.mapping, choice).filter("target <> '(Ignored)' AND source_id LIKE '%c.csv'").count() == 1


SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Amount</t></is></c><c r="D1" t="s"><v>0</v></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>12.5</v></c><c r="C2" s="1"><v>45292</v></c><c r="D2" t="b"><v>1</v></c></row>
<row r="3"/><row r="4"><c r="B4"><v>7</v></c></row></sheetData></worksheet>"""


def test_workbook(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    docs = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    for name in ("x.xlsx", "y.xlsx"):
        with zipfile.ZipFile(tmp_path / name, "w") as book:
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{docs}"><sheets><sheet name="S" r:id="r7"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r7" Target="worksheets/s.xml"/></Relationships>')
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Name</t></si><si><r><t>Al</t></r><r><t>ice</t></r></si></sst>')
            book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
            book.writestr("xl/worksheets/s.xml", SHEET)
    (tmp_path / "notes.txt").write_text("not a workbook")
    files, rows = workbook.read_workbook(spark, str(tmp_path))
    assert [r["columns"] for r in files.collect()] == [["Name", "Amount", "Unnamed: 2", "Name.1"]] * 2
    assert sorted((r["values"] for r in rows.collect()), key=repr) == [["Alice", "12.5", "2024-01-01", "True"]] * 2 + [[None, "7"]] * 2


def test_moments_and_readings():
    day = workbook.datetime(1904, 1, 1)
    assert workbook._as_moment("0", "date", day) == "1904-01-01"
    assert workbook._as_moment("0.5", "time", day) == "12:00:00"
    assert workbook._as_moment("45292.25", "date", workbook.datetime(1899, 12, 30)) == "2024-01-01 06:00:00"
    main = workbook.MAIN[1:-1]
    si = workbook.ElementTree.fromstring(f'<si xmlns="{main}"><r><t>a</t></r><t>b</t><rPh><t>x</t></rPh></si>')
    assert sorted(workbook._plain(si)) == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    source, out, mapping, targets = tmp_path / "in", str(tmp_path / "out"), [("a.b", "X"), ("c", "Y")], ["X", "Y", "Z"]
    source.mkdir()

    def land():
        land_stream(spark, str(source), ["a.b", "c"], mapping, targets, str(tmp_path / "cp"), path=out).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    (source / "1.csv").write_text('a.b,c\n01,"x\ny"\n')
    assert land() == [("01", "x\ny", None)]
    (source / "2.csv").write_text("a.b,c\n02,z\n")
    assert land() == [("01", "x\ny", None), ("02", "z", None)]
    assert land() == [("01", "x\ny", None), ("02", "z", None)]


def test_tables(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('SRC,TARGET,DESCRIPTION\nA_B,A B,"one, two ""x"""\n,Nothing,skipped\nC,C,\n')
    dictionary = tables.read_dictionary(spark, str(path))
    assert [tuple(r) for r in dictionary.collect()] == [("A_B", "A B", 'one, two "x"'), ("C", "C", None)]
    tables.export_csv(dictionary, str(tmp_path / "out"))
    assert sorted(tables.read_dictionary(spark, str(tmp_path / "out")).collect()) == sorted(dictionary.collect())
    dictionary.write.mode("overwrite").saveAsTable("stored_dictionary")
    assert [r["src"] for r in tables.dictionary(spark, "stored_dictionary").collect()] == ["A_B", "C"]
    missing = tables.dictionary(spark, "no_such_table")
    assert missing.columns == ["src", "target", "description"] and missing.count() == 0
    conformed = c.conform(dictionary, [("src", "Name")], ["Name", "Other"])
    assert tables.write_conformed(conformed, "conformed_out", ["Name"]) == ("conformed_out", 2, 1, 1)
    assert spark.table("conformed_out").count() == 2


def test_profile_sample_preview(spark):
    df = spark.createDataFrame([(1, None, "x" * 40), (2, "b", "y"), (3, "c", None), (4, "d", "z"), (5, "e", "w")], "id int, s string, t string")
    profile = {r["column_name"]: (r["position"], r["data_type"], r["n_values"], r["n_rows"]) for r in c.profile_table(df).collect()}
    assert profile == {"id": (1, "int", 5, 5), "s": (2, "string", 4, 5), "t": (3, "string", 4, 5)}
    samples = {r["column_name"]: r["sample"] for r in c.sample_values(df, "id").collect()}
    assert samples == {"s": "b, c, d...", "t": "x" * 30 + ", y, z..."}
    shown = c.preview(df.orderBy("id"), 2, [("t", "Text"), ("id", "Key")])
    assert shown.columns == ["Text", "Key"] and [r["Key"] for r in shown.collect()] == [1, 2]
