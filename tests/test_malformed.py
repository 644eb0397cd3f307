import csv
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandframe.operators.malformed import parse_lines, rejected_rows, valid_rows


def reason(line):
    """The rules, read letter by letter."""
    if line is not None and line.endswith("\r"):
        line = line[:-1]
    if not line:
        return "column_count"
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, out = i + 1, ""
            while True:
                if j >= len(line):
                    return "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        out += '"'
                        j += 2
                        continue
                    break
                out += line[j]
                j += 1
            j += 1
            if j < len(line) and line[j] != ",":
                return "quoting"
            fields.append(out)
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
        if j >= len(line):
            break
        i = j + 1
    if len(fields) != 4:
        return "column_count"
    name, lane, seq, qual = fields
    good = re.fullmatch(r"[!-~]+", name) and re.fullmatch(r"[1-8]", lane) and re.fullmatch(r"[ACGTNacgtn]+", seq)
    good = good and (qual == "*" or (len(qual) == len(seq) and re.fullmatch(r"[!-~]+", qual)))
    return None if good else "invalid_value"


LINES = [
    None, "", "\r", "\r\r", "a,1,A,F", "a,1,A,F\r", "a,1,A,F\n", "a,1,A", "a,1,A,F,", '"a,1,A,F', 'a"b,1,A,F', '"a","1","A","F"', '"a""b",1,A,""""',
    '"a"b,1,A,F', 'a,9,A,F', "a,1,AX,FF", "a,1,AC,*", "a,1,AC,F", "a b,1,A,F", ",1,A,F", '"",1,A,F', 'a,1,A,"F', '"a\nb",1,A,F', "é,1,A,F",
    "a,1," + "A" * 50000 + "," + "F" * 50000, '"' + '""' * 30000 + '",1,A,F', "," * 20000, '"a",1,A,F"', 'a,"1,A,F"', '""', '"""', '""""', "a,1,A,F", "a,1,A,F",
]


def test_reasons(spark):
    rows = [(i, x, "clash", 1) for i, x in enumerate(LINES)]
    df = spark.createDataFrame(rows, "raw_id bigint, raw_line string, errors string, lane int")
    parsed = parse_lines(df, "raw_line", keep=["raw_id"]).cache()
    got = {r.raw_id: r.reason for r in rejected_rows(parsed, keep=["raw_id"]).collect()}
    assert got == {i: reason(x) for i, x in enumerate(LINES) if reason(x)}
    good = valid_rows(parsed, keep=["raw_id"]).orderBy("raw_id").collect()
    assert [r.raw_id for r in good] == [i for i, x in enumerate(LINES) if not reason(x)]
    named = {r.raw_id: r for r in good}
    assert named[12].read_name == 'a"b' and named[12].qual1 == '"' and named[12].lane == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw_id bigint, raw_line string")
    assert parse_lines(df, "raw_line", keep=["raw_id"]).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='",a1AF\r\n*', max_size=14), min_size=200, max_size=400))
def test_random_lines(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw_line string")
    got = {r.raw_id: r.reason for r in rejected_rows(parse_lines(df, "raw_line", keep=["raw_id"]), keep=["raw_id"]).collect()}
    assert got == {i: reason(x) for i, x in enumerate(lines) if reason(x)}


def test_round_trip_of_written_lines(spark):
    import io

    rows = [(f'q"{i},x'.replace(",x", ""), str(i % 8 + 1), "ACGT" * (i + 1), '"' * 4 * (i + 1)) for i in range(20)]
    lines = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw_line string")
    back = valid_rows(parse_lines(df, "raw_line", keep=["raw_id"]), keep=["raw_id"]).orderBy("raw_id").collect()
    assert [(r.read_name, str(r.lane), r.seq1, r.qual1) for r in back] == rows
