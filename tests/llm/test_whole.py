"""Inputs beyond what the operators once cut off: long chains, deep nesting, marks far into a text, every error."""

import ast
from datetime import datetime

import pytest

from codeweft.llm import provenance, queries
from codeweft.llm.parsing import check
from codeweft.llm.provenance import evidence

DEEP = 1_500
CHAIN = " else ".join(f"if (a == {k}) {{ f(); }}" for k in range(DEEP))


@pytest.mark.parametrize(
    ("path", "text"),
    [
        ("x.java", f"class A {{ void f() {{ {CHAIN} }} }}"), ("x.js", CHAIN), ("x.ts", CHAIN), ("x.go", "package a\nfunc f() {\n" + " else ".join(f"if a == {k} {{\n}}" for k in range(DEEP)) + "\n}\n"),
        ("x.java", "class A { int a = " + "b ? c : " * DEEP + "d; }"), ("x.js", "a = " + "b ? c : " * DEEP + "d;"), ("x.py", "a = " + "b if c else " * DEEP + "d\n"),
        ("x.java", "class A { int a = " + "(" * DEEP + "1" + ")" * DEEP + "; }"), ("x.ts", "[" * DEEP + "]" * DEEP), ("x.js", "f(" * DEEP + ")" * DEEP), ("x.go", "package a\nvar x = " + "(" * DEEP + "1" + ")" * DEEP + "\n"), ("x.py", "a = " + "[" * 200 + "]" * 200 + "\n"),
    ],
)
def test_long_chains_and_deep_nesting(path, text):
    assert check(path, text)[1] == []
    assert check(path, text + "\n)")[1]


def test_python_takes_200_brackets():
    assert check("x.py", "a = " + "(" * 201 + "1" + ")" * 201 + "\n")[1] == ["line 1: too many nested brackets"]


@pytest.mark.parametrize("mark", ["Code generated by protoc. DO NOT EDIT.", "Copyright 2019 The Foo Authors"])
def test_marks_late_in_the_opening_comment(mark):
    licence = [f"term {k} of the licence" for k in range(200)]
    assert evidence("a/b.go", "/*\n" + "\n".join(licence) + f"\n{mark}\n*/\npackage a\n")
    assert evidence("a/b.go", "".join(f"// {x}\n" for x in licence) + f"\n// {mark}\npackage a\n")
    assert evidence("a/b.go", "".join(f"// {x}\n" for x in licence) + f"package a\n\n// {mark}\n") is None


def test_inline_source_map():
    code = "".join(f"var a{k % 7} = b.c({k});\n" for k in range(400))
    inline = "//# sourceMappingURL=data:application/json;base64," + "eyJ2" * 1_000
    for end in (f"{inline}\n", f"{inline}\n\n// end\n" + "f();\n" * 100, f"d();{inline}\n{'f();' * 100}\n", f"/*{inline[2:]} */\n"):
        assert evidence("a/app.js", code + end) == "minified"
    assert evidence("a/app.js", code + 'd("//# sourceMappingURL=" + e);\nf("' + "x" * 500 + '");\ng();\n') is None


FIELDS_OK = ['f"{a}"', 'f"{a!r:>{w}}{b=}{{}}"', 'f"{a["b"]}{f"{c}"}"', 'f"{a, b}{(lambda: 1)}{ {1: 2}[1] }"', 'f"{a:%H:%M}{b != c}{d:=5}"', 'f"""{\na # c\n}\n"""', 'rf"\\{a}" "b" f"\\N{DIGIT ONE}{c}"', "f'{a:{b}.{c}}'"]
FIELDS_BAD = ['f"{a b}"', 'f"{foo(x}"', 'f"{}"', 'f"{a!x}"', 'f"{lambda x: 1}"', 'f"{a:{}}"', 'f"{a:{b c}}"', 'f"}"', 'f"{a = b}"', 'f"{1 +}"', 'f"{f"{a b}"}"', 'f"{a;b}"']


@pytest.mark.parametrize("text", FIELDS_OK + FIELDS_BAD)
def test_fields_of_formatted_strings(text):
    assert (not check("x.py", f"x = 1\ny = {text}\nz = 2\n")[1]) == (text in FIELDS_OK)
    if text in FIELDS_BAD:
        errors = check("x.py", f"x = 1\ny = {text}\nz = \n")[1]
        assert [e.split(":")[0] for e in errors] == ["line 2", "line 3"]


def test_fields_agree_with_the_interpreter():
    for text in FIELDS_OK + FIELDS_BAD:
        try:
            ast.parse(text)
            fine = True
        except SyntaxError:
            fine = False
        assert fine == (text in FIELDS_OK), text


@pytest.mark.parametrize(("path", "line"), [("x.py", "x = = 1\n"), ("x.js", "a b;\n"), ("x.ts", "a b;\n"), ("x.java", "void f() { x = ; }\n"), ("x.go", "func f() { a b }\n")])
def test_every_error_is_kept(path, line):
    begin, end = ("class A {\n", "}\n") if path == "x.java" else ("package a\n", "") if path == "x.go" else ("", "")
    errors = check(path, begin + line * 300 + end)[1]
    assert {e.split(":")[0] for e in errors} >= {f"line {k + bool(begin)}" for k in range(1, 301)}


def test_query_of_errors(spark, tmp_path):
    spark.createDataFrame([("r", "a.py", "x = = 1\n" * 120), ("r", "b.py", "x = 1\n")], "repo_id string, path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    spark.createDataFrame([("r", "a.py", None, True), ("r", "b.py", None, True)], "repo_id string, file_path string, parsed_at timestamp_ntz, success boolean").write.parquet(f"{tmp_path}/parse_results.parquet")
    [row] = queries.QUERIES["p1_errors"](spark, str(tmp_path)).collect()
    assert (row.file_path, row.language, row.first_cause, len(row.errors)) == ("a.py", "python", row.errors[0], 120) and row.first_cause.startswith("line 1:")


def test_shared_files_of_unknown_size(spark):
    f = [("a", "one.py", "1", None), ("b", "x/one.py", "1", 900), ("a", "two.py", "2", None), ("b", "y/two.py", "2", None), ("a", "small.py", "3", None), ("b", "z/small.py", "3", 20), ("a", "text.py", "4", None), ("b", "q/text.py", "4", None)]
    rows = [(*r, datetime(2025, 1, 2)) for r in f]
    # An earlier version of another path has the size of a hash.
    rows += [("a", "old.py", "5", None, datetime(2025, 1, 2)), ("b", "w/old.py", "5", None, datetime(2025, 1, 2)), ("c", "new.py", "5", 30, datetime(2025, 1, 1)), ("c", "new.py", "6", 30, datetime(2025, 1, 2))]
    files = spark.createDataFrame(rows, "repo_id string, path string, sha256 string, size_bytes long, indexed_at timestamp_ntz")
    want = {("a", "one.py"), ("b", "x/one.py"), ("a", "two.py"), ("b", "y/two.py"), ("a", "text.py"), ("b", "q/text.py")}
    assert {tuple(r) for r in provenance.shared_files(files).collect()} == want
    # A text tells that these are too small.
    sources = spark.createDataFrame([(r, p, "x = 1\n" if p.endswith("text.py") else "y = call(x)\n" * 40) for r, p, _, _ in f], "repo_id string, path string, content string")
    got = {(r.repo_id, r.path) for r in provenance.not_handwritten(files, sources).collect()}
    assert got == want - {("a", "text.py"), ("b", "q/text.py")}


@pytest.mark.parametrize("tail", ["if a: b", "for x in y:\n    z", "while a:\n    b", "def f(): pass", "class A: pass", "with a: b", "@a\ndef f(): pass", "match a:\n    case 1: pass", "y = 2", "match = 1", "y = "])
def test_long_lines_are_judged_like_short_ones(tail):
    short, long = f"x = 1; {tail}\n", "x = call(1, 2, 3); " * 60 + f"{tail}\n"
    assert bool(check("x.py", short)[1]) == bool(check("x.py", long)[1]) == (tail not in ("y = 2", "match = 1"))
