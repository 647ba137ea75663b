import csv
import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.sources import delimited as D

H = "type,sessionId,uuid,timestamp,content,eventIndex,model"
U = "5726e60b-9816-4874-bed0-eec0975dc72a"
GOOD = f'user,{U},{U.upper()},2026-02-28T23:59:59.123456+02:00,"[{{""a"": 1}}]",07,'


def frame(spark, rows):
    return spark.createDataFrame([(i, f, n, r, "clash", "clash") for i, (f, n, r) in enumerate(rows)], "line_id long, file_name string, line_no int, raw_line string, reason string, type string")


def reasons(spark, *lines, header=H):
    rows = [("f", 0, header), *[("f", i + 1, x) for i, x in enumerate(lines)]]
    return {r.line_id - 1: r.reason for r in D.failed_lines(frame(spark, rows)).collect()}


def test_reasons(spark):
    lines = [
        GOOD,
        GOOD.replace('"[{', '[{'),  # quote inside an unquoted field
        GOOD + '"open',
        GOOD.replace('}]"', '}]"x'),
        GOOD + ",more",
        GOOD.replace("user", "User"),
        GOOD.replace("2026-02-28", "2026-02-30"),
        GOOD.replace(".123456", ".1234567"),
        GOOD.replace("+02:00", ""),
        GOOD.replace(",07,", ",,"),
        GOOD.replace('"[{""a"": 1}]"', '"{""a"": 1}"'),
        GOOD.replace('"[{""a"": 1}]"', "[NaN]"),
        GOOD.replace('"[{""a"": 1}]"', '"""text"""'),
        "   ",
        None,
        "",
        GOOD.replace("T23", "T24"),
    ]
    want = {1: "quoting", 2: "quoting", 3: "quoting", 4: "column_count", **dict.fromkeys((5, 6, 7, 8, 9, 10, 11, 16), "invalid_value")}
    assert reasons(spark, *lines) == want


def test_headers_and_delimiters(spark):
    rows = [("a", 0, '"uuid"\t"type"\t"timestamp"\t"sessionId"\t"content"'), ("a", 1, f"{U}\tuser\t2026-01-01T00:00:00Z\t{U}\t[]"), ("b", 1, "x,y"), (None, 1, "x"), ("c", 0, None)]
    assert {r.line_id: r.reason for r in D.failed_lines(frame(spark, rows)).collect()} == {2: "column_count", 3: "column_count"}
    assert D.valid_records(frame(spark, rows)).count() == 1
    assert D.read_delimited(frame(spark, [])).count() == 0


def test_very_long_and_deep(spark):
    long = "x" * 300_000
    deep = "[" * 200_000 + "]" * 200_000
    got = reasons(spark, GOOD.replace('"[{""a"": 1}]"', f'"""{long}"""'), GOOD.replace('"[{""a"": 1}]"', deep))
    assert got == {1: "invalid_value"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from('ab",; \n')), min_size=1, max_size=5), st.sampled_from(",;\t|"))
def test_split_reads_what_csv_writes(fields, delimiter):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert D.split_record(out.getvalue(), delimiter) == (fields, True)


def test_json_kind():
    for text, kind in (('"a"', "string"), (" [1, 2] ", "array"), ("{}", "other"), ("1", "other"), ("[1,]", None), ("[01]", None), ("'a'", None), ('"\t"', None), ("[Infinity]", None), ("", None), (None, None), ("[1] x", None), (json.dumps(["é"]), "array"), ("1" * 5000, "other")):
        assert D.json_kind(text) == kind, text
