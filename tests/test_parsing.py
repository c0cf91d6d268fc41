import json
import re

from tessera.operators.parsing import loaded, read_lines, rejected
from tessera.plans.cleaning import FEEDS

SIZE = {"names": 6, "akas": 8, "principals": 6}


def brute(feed, line):
    """The reason by the format's own words, character by character."""
    if line is None:
        return "columns"
    s = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            i, out = i + 1, ""
            while True:
                if i >= len(s):
                    return "quoting"
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        out, i = out + '"', i + 2
                        continue
                    i += 1
                    break
                out, i = out + s[i], i + 1
            if i < len(s) and s[i] != "\t":
                return "quoting"
        else:
            j = s.find("\t", i)
            j = len(s) if j < 0 else j
            out, i = s[i:j], j
        fields.append(out)
        if i >= len(s):
            break
        i += 1
    if len(fields) != SIZE.get(feed):
        return "columns"
    full = lambda p, x: re.fullmatch(p, x, re.ASCII | re.S)
    year = lambda x: x == "\\N" or (full("[0-9]{4}", x) and 1800 <= int(x) <= 2026)

    def strings(x):
        try:
            v = json.loads(x, parse_constant=lambda _: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return False
        return isinstance(v, list) and all(isinstance(y, str) for y in v)

    if feed == "names":
        ok = full("nm[0-9]+", fields[0]) and year(fields[2]) and year(fields[3])
    elif feed == "akas":
        bad = any(c == "�" or c == "\x7f" or (c < " " and c not in "\t\n") for c in fields[2])
        ok = full("tt[0-9]+", fields[0]) and full("[0-9]+", fields[1]) and fields[2] not in ("", "\\N") and not bad and fields[7] in ("0", "1", "\\N")
    else:
        ok = full("tt[0-9]+", fields[0]) and full("[0-9]+", fields[1]) and full("nm[0-9]+", fields[2]) and (fields[5] == "\\N" or strings(fields[5]))
    return None if ok else "values"


def name(*f):
    return "names", "\t".join(f)


def aka(title, original="1", n="3", key="tt1"):
    return "akas", "\t".join([key, n, title, "DE", "\\N", "\\N", "\\N", original])


def principal(characters, n="3", person="nm2"):
    return "principals", "\t".join(["tt1", n, person, "actor", "\\N", characters])


CASES = [
    name("nm1", "A B", "1900", "\\N", "actor", "tt1"), name("nm1", "A", '"1900"', '"\\N"', "", ""), name("nm1", "A", "1799", "\\N", "x", "y"), name("nm1", "A", "19000", "\\N", "x", "y"),
    name("nm1", "A", "٢٠٠٠", "\\N", "x", "y"), name("tt1", "A", "1900", "\\N", "x", "y"), name("nm", "A", "1900", "\\N", "x", "y"), name("nm1", "A", "1900"), name("nm1\n", "A", "1900", "\\N", "x", "y"),
    name("nm1", "A", "2026", "2027", "x", "y"), name("nm1", "A\r", "1900", "\\N", "x", "y\r"), name("nm1", "A", "1900", "\\N", "x", '"y\r'), name("nm1", "A", "1900", "\\N", "x", '"y"\r'),
    aka("Title"), aka('"A ""B"" C"'), aka('"A\tB\nC"'), aka('50" x'), aka('"A" x'), aka('"A'), aka('"A""'), aka('""'), aka(""), aka("\\N"), aka("a�"), aka("a\x07"), aka("a\x7f"), aka("a\nb"),
    aka("T", "2"), aka("T", "\\N"), aka("T", "true"), aka("T", n="-1"), aka("T", n="\\N"), aka("T", key="tt１"), aka("T" * 300_000), aka('"' + 'a""' * 100_000 + '"'), aka('"' + 'a""' * 100_000),
    principal("\\N"), principal('["Self"]'), principal("[]"), principal(' [ "a" , "b\\n\\u00e9" ] '), principal('["a",]'), principal("['a']"), principal('["a", 1]'), principal('["a"'), principal('{"a": "b"}'),
    principal('["a\\x"]'), principal('["a\x01"]'), principal('"[""Self""]"'), principal('"[""a\tb""]"'), principal("[null]"), principal('["a"]', person="2"), principal("[" + ",".join(['"x"'] * 50_000) + "]"),
    ("names", ""), ("names", None), ("names", " "), (None, "a\tb"), ("other", "a"), ("names", "\t\t\t\t\t"),
]


def frame(spark, cases):
    return spark.createDataFrame([(i, f, x, "clash") for i, (f, x) in enumerate(cases)], "line_id long, feed string, line string, title string")


def test_reasons(spark):
    got = {r.line_id: r.reason for r in rejected(frame(spark, CASES), FEEDS).collect()}
    want = {i: brute(f, x) for i, (f, x) in enumerate(CASES)}
    assert got == {i: x for i, x in want.items() if x}


def test_valid_lines_come_out_typed_and_nothing_is_lost(spark):
    df = frame(spark, CASES)
    bad = rejected(df, FEEDS).count()
    good = [r for f in FEEDS for r in loaded(df, FEEDS, f.name).select("line_id").collect()]
    assert bad + len(good) == len(CASES) and len({r.line_id for r in good}) == len(good)
    a = {r.line_id: r for r in loaded(df, FEEDS, "akas").collect()}
    first = next(i for i, (f, _) in enumerate(CASES) if f == "akas")
    assert (a[first].titleId, a[first].ordering, a[first].title, a[first].language, a[first].isOriginalTitle) == (1, 3, "Title", None, True)
    assert a[first + 1].title == 'A "B" C' and a[first + 2].title == "A\tB\nC"


def test_raw_text_is_kept(spark):
    r = read_lines(frame(spark, [aka('"A'), aka("T"), ("names", None)]), FEEDS).orderBy("line_id").collect()
    assert r[0]._corrupt == aka('"A')[1] and r[0]._fields is None and r[1]._corrupt is None and r[2]._corrupt == ""


def test_empty(spark):
    assert rejected(frame(spark, []), FEEDS).count() == 0


def test_a_line_is_cut_once(spark):
    df = frame(spark, CASES)
    for out in (rejected(df, FEEDS), loaded(df, FEEDS, "names"), loaded(df, FEEDS, "akas")):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_valid_numbers_that_do_not_fit_are_told(spark):
    big = "9" * 30
    df = frame(spark, [principal("\\N", n=big, person=f"nm{big}"), principal("\\N")])
    a, b = loaded(df, FEEDS, "principals").orderBy("line_id").collect()
    assert (a.ordering, a.nconst, a.unfit) == (None, None, f"ordering={big}\tnconst=nm{big}") and b.unfit is None
