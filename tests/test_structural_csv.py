import datetime as dt

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.operators.structural_csv import failures, load_cases, split_records, structural_index

SPEC = "module string, pos int, column_name string, leaf_type string, optional boolean, enum_values array<string>, item_type string, description string, is_decision boolean, decision_name string"
LINE = "line_id bigint, import_file string, module string, row_num int, line string, received_at timestamp, module_name string"


def by_hand(line):
    """Fields of a line, or None where its quoting does not hold, read one character at a time."""
    line = line.rstrip("\r\n") if line.count('"') % 2 == 0 else line
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    break
                out, i = out + line[i], i + 1
            i += 1
            if i < len(line) and line[i] not in ",\r\n":
                return None
        else:
            j = i
            while j < len(line) and line[j] not in ",\r\n":
                j += 1
            out = line[i:j]
            if '"' in out:
                return None
            i = j
        fields.append(out)
        if i >= len(line):
            return fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a",\n é', max_size=14), min_size=1, max_size=6))
def test_index_agrees_with_reading_by_hand(lines):
    fine, fields = structural_index(pa.array(lines))
    for line, ok, got in zip(lines, fine.to_pylist(), fields.to_pylist()):
        want = by_hand(line)
        assert ok == (want is not None), line
        if ok:
            assert got == want, line


def test_index_of_nothing_and_of_null():
    assert structural_index(pa.array([], pa.string()))[1].to_pylist() == []
    fine, fields = structural_index(pa.array([None, "", "a,b"]))
    assert fine.to_pylist() == [None, True, True] and fields.to_pylist() == [None, [""], ["a", "b"]]


def tables(spark, lines):
    spec = [("m", 1, "size", "int", False, None, None, None, False, None), ("m", 2, "kind", "enum", True, ["A", "B"], None, None, False, None), ("m", 3, "paid", "money", True, None, None, None, False, None), ("m", 4, "day", "date", True, None, None, None, False, None)]
    at = dt.datetime(2024, 1, 1)
    rows = [(i, "f", "m", r, line, at, "clash") for i, r, line in lines]
    return spark.createDataFrame(rows, LINE), spark.createDataFrame(spec, SPEC)


def test_reasons_and_what_is_no_case(spark):
    lines, spec = tables(
        spark,
        [
            (1, 1, "case_id,short_description,description,size,kind,paid,day,tags,notes"),
            (2, 2, "#desc,,,number,,,,,"),
            (3, 3, "c3,label,text,,,,,,"),
            (4, 4, 'c4,label,"long, ""quoted""\ntext",+7,A,"$1,234.5",2024-02-29,x; y,'),
            (4, 4, 'c4,label,"long, ""quoted""\ntext",+7,A,"$1,234.5",2024-02-29,x; y,'),
            (5, 5, 'c5,label,"text,1,A,,,,'),
            (6, 6, "c6|label|text|1|A||||"),
            (7, 7, "c7,label,text"),
            (8, 8, "c8,, text ,three,C,12 50,2023-02-29,,"),
            (9, 9, "c9,label,text, ,,-$5,,,"),
            (10, None, None),
        ],
    )
    got = {tuple(r) for r in failures(lines, spec).collect()}
    assert got == {
        (5, "", "BROKEN_QUOTING"), (6, "", "WRONG_COLUMN_COUNT"), (7, "", "WRONG_COLUMN_COUNT"), (8, "short_description", "MISSING_REQUIRED"), (8, "size", "INVALID_INT"),
        (8, "kind", "INVALID_ENUM"), (8, "paid", "INVALID_MONEY"), (8, "day", "INVALID_DATE"), (9, "size", "MISSING_REQUIRED"),
    }
    loaded = load_cases(lines, spec).collect()
    assert [r.line_id for r in loaded] == [4]
    cells = {c.column_name: c.value for c in loaded[0].cells}
    assert int(cells["size"].whole) == 7 and str(cells["paid"].amount) == "1234.50" and cells["day"].day == dt.date(2024, 2, 29) and loaded[0].description == 'long, "quoted"\ntext'


def test_empty_tables_and_unknown_modules(spark):
    lines, spec = tables(spark, [(1, 2, "a,b,c,d")])
    assert failures(lines.limit(0), spec).count() == 0
    assert [tuple(r) for r in failures(lines, spec.limit(0)).collect()] == [(1, "", "WRONG_COLUMN_COUNT")]


def test_nothing_valid_is_lost_on_loading(spark):
    spec = spark.createDataFrame([("m", 1, "n", "int", False, None)], "module string, pos int, column_name string, leaf_type string, optional boolean, enum_values array<string>")
    big = "9" * 45
    rows = spark.createDataFrame([(1, "f", "m", 2, f"c,s,d,{big},,", None), (2, "f", "other", 2, "c,s,d,t,n", None)], "line_id bigint, import_file string, module string, row_num int, line string, received_at timestamp")
    got = {r.line_id: r.cells for r in load_cases(rows, spec).collect()}
    cell = next(c for c in got[1] if c.column_name == "n").value
    assert cell.whole is None and cell.text == big and [c.column_name for c in got[2]] == ["case_id", "short_description", "description", "tags", "notes"]


def test_a_line_of_very_many_fields_is_no_stub(spark):
    names = [(("m"), i, f"c{i}", "string", True, None) for i in range(10_010)]
    spec = spark.createDataFrame(names, "module string, pos int, column_name string, leaf_type string, optional boolean, enum_values array<string>")
    line = "c,s,d," + "," * 10_009 + "x,,"
    rows = spark.createDataFrame([(1, "f", "m", 2, line, None), (2, "f", "m", 2, line.replace("x", ""), None)], "line_id bigint, import_file string, module string, row_num int, line string, received_at timestamp")
    assert [r.line_id for r in load_cases(rows, spec).select("line_id").collect()] == [1]


def test_texts_are_read_record_by_record(spark):
    rows = spark.createDataFrame([(1, 'a,"b, ""c""\nd"\r\n\n1,2\n'), (2, 'x"y,1'), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.records for r in split_records(rows).collect()}
    assert [x for x in got[1] if any(x)] == [["a", 'b, "c"\nd'], ["1", "2"]] and got[2] is None and got[3] is None and got[4] == [[""]]
